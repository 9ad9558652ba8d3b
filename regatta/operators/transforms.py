"""Robust scaling of features and transforms of the target."""

from __future__ import annotations

from dataclasses import dataclass
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.columns import col
from regatta.operators.quantiles import exact_quantiles

TARGET_TRANSFORMS = ("none", "log", "yeo-johnson")


def robust_fit(
    df: DataFrame, features: list[str], n_rows: int | None = None, **limits
) -> dict[str, tuple[float, float]]:
    """Exact median and interquartile range per feature; a zero range scales by 1."""
    values = {n: col(n).cast("double") for n in features}
    found = exact_quantiles(df, values, [0.25, 0.5, 0.75], n_rows=n_rows, **limits)
    out = {}
    for n, q in found.items():
        low, middle, high = q if q else (0.0, 0.0, 1.0)
        out[n] = (middle, (high - low) if high > low else 1.0)
    return out


def robust_columns(fitted: dict[str, tuple[float, float]]) -> dict[str, Column]:
    return {
        n: (col(n).cast("double") - F.lit(center)) / F.lit(scale)
        for n, (center, scale) in fitted.items()
    }


def robust_scale(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns(robust_columns(robust_fit(df, features)))


@dataclass(frozen=True)
class TargetTransform:
    """Forward and inverse expressions of the target; ``none`` is the identity."""

    kind: str = "none"
    power: float = 1.0
    mean: float = 0.0
    std: float = 1.0

    def forward(self, y: Column) -> Column:
        if self.kind == "none":
            return y
        if self.kind == "log":
            return F.log1p(y)
        return (yeo_johnson(y, self.power) - F.lit(self.mean)) / F.lit(self.std)

    def inverse(self, t: Column) -> Column:
        if self.kind == "none":
            return t
        if self.kind == "log":
            return F.expm1(t)
        return yeo_johnson_inverse(t * F.lit(self.std) + F.lit(self.mean), self.power)


def check_transform(kind: str) -> None:
    if kind not in TARGET_TRANSFORMS:
        raise ValueError(f"unknown target transformation: {kind}")


def yeo_johnson(y: Column, power: float) -> Column:
    """The two-sided power transform of Yeo and Johnson (2000)."""
    if abs(power) < 1e-12:
        positive = F.log1p(y)
    else:
        positive = (F.pow(y + 1, F.lit(power)) - 1) / power
    if abs(power - 2) < 1e-12:
        negative = -F.log1p(-y)
    else:
        negative = -(F.pow(1 - y, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(y >= 0, positive).otherwise(negative)


def yeo_johnson_inverse(t: Column, power: float) -> Column:
    """Values beyond the transform's range go to its limit."""
    zero = F.lit(0.0)
    if abs(power) < 1e-12:
        positive = F.expm1(t)
    else:
        positive = F.pow(F.greatest(t * power + 1, zero), F.lit(1 / power)) - 1
    if abs(power - 2) < 1e-12:
        negative = -F.expm1(-t)
    else:
        negative = 1 - F.pow(
            F.greatest(-(2 - power) * t + 1, zero), F.lit(1 / (2 - power))
        )
    return F.when(t >= 0, positive).otherwise(negative)


def _power_sql(power: float) -> str:
    """The transform of a column ``y`` as SQL text: grids of many powers build faster so."""
    up = "ln(1 + y)" if abs(power) < 1e-12 else f"(pow(y + 1, {power!r}D) - 1) / {power!r}D"
    rest = 2 - power
    down = "-ln(1 - y)" if abs(rest) < 1e-12 else f"-(pow(1 - y, {rest!r}D) - 1) / {rest!r}D"
    return f"CASE WHEN y >= 0 THEN {up} ELSE {down} END"


def yeo_johnson_table(
    df: DataFrame, target: str, powers: list[float], by: str | None = None
) -> DataFrame:
    """``g, power, n, jacobian, mean, variance, loglik`` of every power, in one pass."""
    y = F.col("y")
    group = (F.col(by) if by else F.lit(0)).alias("g")
    base = df.where(col(target).isNotNull()).select(group, col(target).cast("double").alias("y"))
    # one short aggregate over (power, value) pairs compiles and runs faster than a wide one
    pairs = ", ".join(f"struct({p!r}D AS power, {_power_sql(p)} AS t)" for p in powers)
    moments = (
        base.select("g", (F.signum(y) * F.log1p(F.abs(y))).alias("j"), F.expr(f"inline(array({pairs}))"))
        .groupBy("g", "power")
        .agg(F.count("*").alias("n"), F.sum("j").alias("jacobian"),
             F.avg("t").alias("mean"), F.var_pop("t").alias("variance"))
    )
    loglik = F.col("n") / -2 * F.ln("variance") + (F.col("power") - 1) * F.col("jacobian")
    return moments.withColumn("loglik", loglik)


def yeo_johnson_moments(
    df: DataFrame, target: str, powers: list[float], by: str | None = None
) -> dict:
    """Per group ``(count, jacobian, [(mean, squared deviations) per power])``."""
    out: dict = {}
    rows = yeo_johnson_table(df, target, powers, by).collect()
    for r in sorted(rows, key=lambda r: r["power"]):
        n, j, moments = out.setdefault(r["g"], (r["n"], r["jacobian"], []))
        moments.append((r["mean"], r["variance"] * n))
    return out


def _merged(groups: list[tuple]) -> tuple:
    """Moments of several groups together."""
    n = sum(g[0] for g in groups)
    moments = []
    for at in range(len(groups[0][2])):
        mean = sum(g[0] * g[2][at][0] for g in groups) / n
        moments.append((mean, sum(g[2][at][1] + g[0] * (g[2][at][0] - mean) ** 2 for g in groups)))
    return n, sum(g[1] for g in groups), moments


def _likelihood(n: int, jacobian: float, power: float, squares: float) -> float:
    return -n / 2 * log(squares / n) + (power - 1) * jacobian if squares > 0 else float("-inf")


def fit_yeo_johnson(df: DataFrame, target: str, by: str | None = None) -> dict:
    """Maximum-likelihood power: a wide grid, then finer ones around the parabola's vertex.

    With ``by`` there is one transform per group, learnt from all the *other* groups (the
    training rows of that fold), and ``"all"``; the moments of a complement come from the
    groups' own, so every round is one pass for all of them.
    """
    centers: dict = {}
    names: list = ["all"]
    steps, low, high, enclosed = [0.5, 0.1, 0.01], -3.0, 5.0, False
    while steps:
        step = steps[0]
        powers = [round(low + step * i, 9) for i in range(int(round((high - low) / step)) + 1)]
        found = yeo_johnson_moments(df, target, powers, by)
        if by:
            names = [*sorted(found), "all"]
        at_low = at_high = False
        for name in names:
            n, j, moments = _merged([g for k, g in found.items() if k != name])
            scores = [_likelihood(n, j, p, sq) for p, (_, sq) in zip(powers, moments)]
            top = max(range(len(powers)), key=scores.__getitem__)
            if scores[top] == float("-inf"):
                raise ValueError("the target is constant")
            centers[name] = powers[top]
            if top == 0 and scores[0] > scores[1]:
                at_low = True
            elif top == len(powers) - 1 and scores[top] > scores[top - 1]:
                at_high = True
            elif 0 < top < len(powers) - 1:
                left, middle, right = scores[top - 1 : top + 2]
                bend = left - 2 * middle + right
                if bend == float("-inf") and len(steps) == 1:
                    raise ValueError("the likelihood has no maximum at a power that can be worked out")
                if float("-inf") < bend < 0:
                    centers[name] += 0.5 * (left - right) / bend * step
        if (at_low or at_high) and not enclosed:  # looks four times as far, in steps as much wider
            steps.insert(0, 4 * step)
            low, high = 4 * low, 4 * high
        elif at_low or at_high:
            low, high = low - 4 * step * at_low, high + 4 * step * at_high
        else:
            enclosed = True
            steps.pop(0)
            if steps:
                low, high = min(centers.values()) - 2 * steps[0], max(centers.values()) + 2 * steps[0]
    powers = sorted(set(centers.values()))
    found = yeo_johnson_moments(df, target, powers, by)
    out = {}
    for name in names:
        n, _, moments = _merged([g for k, g in found.items() if k != name])
        mean, squares = moments[powers.index(centers[name])]
        out[name] = TargetTransform("yeo-johnson", centers[name], mean, sqrt(squares / n))
    return out


def fit_target_transform(df: DataFrame, target: str, kind: str, by: str | None = None) -> dict:
    """The transform of all rows under ``"all"`` and, with ``by``, one per group that was
    learnt without that group; the log form needs targets above -1."""
    check_transform(kind)
    if kind == "yeo-johnson":
        return fit_yeo_johnson(df, target, by)
    if kind == "log":
        lowest = df.agg(F.min(col(target).cast("double"))).first()[0]
        if lowest is not None and lowest <= -1:
            raise ValueError("the log transform needs every target above -1")
    out: dict = {"all": TargetTransform(kind)}
    if by:
        out.update({r[0]: TargetTransform(kind) for r in df.select(by).distinct().collect()})
    return out
