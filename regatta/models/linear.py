"""Ordinary least squares from sums of products.

One pass collects, per fold, the products of all column pairs. The sums of a training set
are the total minus the held-out fold's, so k cross-validation fits and the final fit all
come from the same pass; a second pass scores every row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.columns import col, total
from regatta.models.base import FittedModel, complete_rows
from regatta.models.partials import map_reduce, matrix

JVM_COLUMNS = 10  # up to here the products are plain SQL sums, beyond it numpy in tasks
RANK_TOLERANCE = 1e-10


@dataclass
class LinearModel(FittedModel):
    intercept: float = 0.0
    coefficients: list[float] = field(default_factory=list)

    def expression(self) -> Column:
        terms = [F.lit(float(self.intercept))]
        terms += [
            col(f).cast("double") * F.lit(float(c))
            for f, c in zip(self.features, self.coefficients)
        ]
        return total(terms)

    def raw(self, df: DataFrame, output: str) -> DataFrame:
        return df.withColumn(output, self.expression())

    def state(self):
        return {"intercept": np.array(self.intercept), "coefficients": np.array(self.coefficients)}


def product_sums(
    df: DataFrame, columns: dict[str, Column], by: str | None = None, shift: bool = True
) -> tuple[np.ndarray, dict]:
    """``(center, {group: S})`` with S the sums of products of ``[1, columns - center]``.

    Centering first keeps the sums accurate for columns far from zero. Rows with a missing value
    in any of the columns are left out.
    """
    names = list(columns)
    base = df.select(
        (F.col(by) if by else F.lit(0)).cast("bigint").alias("__g"),
        *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())],
    )
    fields = [f"c{i}" for i in range(len(names))]
    base = complete_rows(base, fields)
    center = np.zeros(len(names))
    if shift:
        means = base.agg(*[F.avg(f).alias(f) for f in fields]).first()
        center = np.array([means[f] or 0.0 for f in fields])
    if len(names) <= JVM_COLUMNS:
        return center, _sums_in_sql(base, fields, center)
    return center, _sums_in_tasks(base, fields, center)


def _sums_in_sql(base: DataFrame, fields: list[str], center: np.ndarray) -> dict:
    moved = base.select(
        "__g", *[(F.col(f) - F.lit(float(m))).alias(f) for f, m in zip(fields, center)]
    )
    d = len(fields)
    aggs = [F.count("*").cast("double").alias("s0_0")]
    for i in range(d):
        aggs.append(F.sum(fields[i]).alias(f"s0_{i + 1}"))
        for j in range(i, d):
            product = F.sum(F.col(fields[i]) * F.col(fields[j]))
            aggs.append(product.alias(f"s{i + 1}_{j + 1}"))
    out = {}
    for row in moved.groupBy("__g").agg(*aggs).collect():
        s = np.zeros((d + 1, d + 1))
        for i in range(d + 1):
            for j in range(i, d + 1):
                s[i, j] = s[j, i] = row[f"s{i}_{j}"]
        out[row["__g"]] = s
    return out


def _sums_in_tasks(base: DataFrame, fields: list[str], center: np.ndarray) -> dict:
    def summarize(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch, fields) - center
            x = np.hstack([np.ones((len(x), 1)), x])
            groups = matrix(batch, ["__g"])[:, 0].astype(np.int64)
            for g in np.unique(groups):
                part = x[groups == g]
                product = part.T @ part
                sums[int(g)] = product if int(g) not in sums else sums[int(g)] + product
        return sums

    return map_reduce(base, summarize, lambda a, b: a + b)


def solve(sums: np.ndarray, center: np.ndarray, n_features: int, target: int) -> tuple:
    """Intercept and coefficients of the least squares fit; collinear columns get the
    solution of smallest norm on standardised features. Column ``target`` is the response."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    a = cov[:n_features, :n_features]
    b = cov[:n_features, target]
    spread = np.sqrt(np.clip(np.diag(a), 0, None))
    usable = spread > 0
    scale = np.where(usable, spread, 1.0)
    values, vectors = np.linalg.eigh(a / np.outer(scale, scale))
    keep = values > RANK_TOLERANCE * max(values.max(initial=0.0), 1e-300)
    inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    coefs = np.where(usable, (inverse @ (b / scale)) / scale, 0.0)
    origin = center + mean
    intercept = origin[target] - coefs @ origin[:n_features]
    return float(intercept), [float(c) for c in coefs]


def fit_linear(
    df: DataFrame, features: list[str], target: str, transform, **_
) -> LinearModel:
    columns = {f: col(f) for f in features}
    columns["__target"] = transform.forward(col(target).cast("double"))
    center, sums = product_sums(df, columns)
    intercept, coefs = solve(sums[0], center, len(features), len(features))
    return LinearModel("LR", list(features), {}, transform, [], intercept, coefs)


def fit_linear_folds(
    df: DataFrame, features: list[str], target: str, transforms: dict, fold: str = "fold"
) -> dict:
    """Models per name in ``transforms``: fold numbers (trained without that fold) and
    ``"all"``, from one pass over the rows of ``df``."""
    columns = {f: col(f) for f in features}
    distinct = list(dict.fromkeys(transforms.values()))
    for i, t in enumerate(distinct):
        columns[f"__target{i}"] = t.forward(col(target).cast("double"))
    center, sums = product_sums(df, columns, by=fold)
    everything = sum(sums.values())
    out = {}
    for name, t in transforms.items():
        used = everything if name == "all" else everything - sums.get(name, 0)
        at = len(features) + distinct.index(t)
        intercept, coefs = solve(used, center, len(features), at)
        out[name] = LinearModel("LR", list(features), {}, t, [], intercept, coefs)
    return out
