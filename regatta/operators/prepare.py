"""From a raw table to a model-ready one.

The output columns depend on the data (sparse and constant columns go, categories appear),
so one aggregate over the de-duplicated rows takes every decision and the result is then a
single projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.columns import col, is_numeric, require_columns
from regatta.operators import clean, dedupe, encode
from regatta.operators import stats as S
from regatta.session import materialize, spread


@dataclass(frozen=True)
class PrepareConfig:
    target: str
    key_cols: tuple[str, ...] = ()
    features_to_drop: tuple[str, ...] = ()
    categorical_features: tuple[str, ...] = ()
    composite_parts: tuple[str, ...] | None = None  # set: target is their sum
    drop_leaky: bool = False
    sparse_threshold: float = 0.2
    categorical_fill: str = "median"  # numeric-coded categories: "median" or "mode"
    max_categories: int | None = None
    non_numeric: str = "error"  # undeclared text columns: "error", "drop" or "keep"
    dedupe: str = "digest"
    reuse: bool = True  # write the de-duplicated rows once before the passes over them


@dataclass
class Prepared:
    df: DataFrame
    target: str
    key_cols: list[str]
    features: list[str]
    n_rows: int
    steps: list[tuple] = field(default_factory=list)

    def audit(self) -> DataFrame:
        """``step, n_rows, n_cols, note`` after every step."""
        schema = "position int, step string, n_rows bigint, n_cols int, note string"
        return self.df.sparkSession.createDataFrame(
            [(i, *s) for i, s in enumerate(self.steps)], schema
        )

    def split_xy(self) -> tuple[DataFrame, DataFrame]:
        return split_xy(self.df, self.target, self.key_cols)


def split_xy(df: DataFrame, target: str, key_cols=()) -> tuple[DataFrame, DataFrame]:
    """Features and target as two tables that share the key columns."""
    require_columns(df, [target], "target")
    return df.drop(target), df.select(*[col(k) for k in key_cols], col(target))


def validate_inputs(df: DataFrame, config: PrepareConfig) -> tuple[str, ...]:
    """Check names before any job runs; returns the composite's parts, if it is one."""
    parts = config.composite_parts
    if parts is None and config.target == clean.COMPOSITE_TARGET:
        parts = tuple(clean.LEAKING_COLUMNS[clean.COMPOSITE_TARGET])
    if parts:
        require_columns(df, parts, "component")
    else:
        require_columns(df, [config.target], "target")
    require_columns(df, config.key_cols, "key")
    require_columns(df, config.categorical_features, "categorical feature")
    require_columns(df, config.features_to_drop, "feature to drop")
    if config.target in config.categorical_features:
        raise ValueError("the target cannot be categorical")
    if config.target in config.features_to_drop:
        raise ValueError("the target cannot be dropped")
    if config.categorical_fill not in ("median", "mode"):
        raise ValueError(f"unknown categorical_fill: {config.categorical_fill}")
    if config.non_numeric not in ("error", "drop", "keep"):
        raise ValueError(f"unknown non_numeric: {config.non_numeric}")
    return tuple(parts or ())


def prepare(df: DataFrame, config: PrepareConfig) -> Prepared:
    parts = validate_inputs(df, config)
    target, keys = config.target, list(config.key_cols)
    steps: list[tuple] = []

    cleaned = clean.clean_sentinels(df)
    if config.reuse:
        cleaned = spread(cleaned)
    present = clean.all_present(list(parts) or [target])
    counts = cleaned.agg(F.count("*").alias("n"), F.count_if(present).alias("kept")).first()
    steps.append(("load", counts["n"], len(df.columns), ""))

    if parts:
        rows = clean.composite_target(cleaned, target, list(parts))
    else:
        rows = clean.drop_missing_target(cleaned, target)
    steps.append(("drop_missing_target", counts["kept"], len(rows.columns), ""))

    removed = [n for n in config.features_to_drop if n not in keys]
    rows = clean.drop_columns(rows, removed)
    if config.drop_leaky:
        rows = clean.drop_leaky(rows, target)
    steps.append(("drop_columns", counts["kept"], len(rows.columns), ", ".join(removed)))

    rows = dedupe.drop_duplicate_rows(rows, keys, config.dedupe)
    if config.reuse:
        rows = materialize(rows)
    compared = [n for n in rows.columns if n not in keys]
    found = S.column_stats(rows, compared, config.categorical_features)
    n_rows = found[target].n_rows
    if n_rows == 0:
        raise ValueError("no rows left after dropping missing targets")
    if found[target].constant:
        raise ValueError(f"target {target} has a single value")
    steps.append(("drop_duplicate_rows", n_rows, len(rows.columns), ""))

    sparse = S.prune_sparse_columns(found, config.sparse_threshold, (target,))
    rows = rows.drop(*sparse)
    steps.append(("prune_sparse_columns", n_rows, len(rows.columns), ", ".join(sparse)))
    constant = [n for n in S.prune_constant_columns(found, (target,)) if n not in sparse]
    rows = rows.drop(*constant)
    steps.append(("prune_constant_columns", n_rows, len(rows.columns), ", ".join(constant)))

    kept = [n for n in rows.columns if n not in keys]
    cats = [n for n in config.categorical_features if n in kept]
    lost = [n for n in config.categorical_features if n not in kept]
    numeric = [n for n in kept if is_numeric(rows.schema[n].dataType)]
    other = [
        n for n in kept
        if n not in cats and n not in numeric
        and not isinstance(rows.schema[n].dataType, T.BooleanType)
    ]
    if other and config.non_numeric == "error":
        raise ValueError("columns are neither numeric nor declared categorical: " + ", ".join(other))
    if other and config.non_numeric == "drop":
        rows, kept = rows.drop(*other), [n for n in kept if n not in other]

    by_median = [
        n for n in numeric
        if n != target and found[n].n_missing
        and not (n in cats and config.categorical_fill == "mode")
    ]
    fills = S.medians(rows, by_median, n_rows)
    estimates = {n: found[n].n_distinct for n in cats}
    counted = S.value_counts(rows, cats, config.max_categories, estimates)
    fills.update(
        {n: S.mode_of(counted[n]) for n in cats if found[n].n_missing and n not in fills}
    )
    flags = [
        n for n in kept
        if n not in cats and n != target and found[n].n_missing and isinstance(rows.schema[n].dataType, T.BooleanType)
    ]
    fills.update(S.modes(rows, flags))
    steps.append(("impute", n_rows, len(rows.columns), ", ".join(sorted(fills))))

    def filled(name: str):
        c = col(name)
        if fills.get(name) is None:
            return c
        if name in numeric:
            return F.coalesce(c.cast("double"), F.lit(float(fills[name])))
        return F.coalesce(c, F.lit(fills[name]).cast(rows.schema[name].dataType))

    plain = [filled(n).alias(n) for n in kept if n not in cats]
    dummies = []
    for n in cats:
        values = {v for v, _ in counted[n]}
        if n in fills:
            values.add(fills[n])
        for v in sorted(values):
            name = f"{n}_{encode.label_of(v)}"
            dummies.append(encode.dummy(filled(n), n in numeric, v).alias(name))
    out = rows.select(*[col(k) for k in keys], *plain, *dummies)
    note = ", ".join(cats) + (f" (already removed: {', '.join(lost)})" if lost else "")
    steps.append(("one_hot", n_rows, len(out.columns), note))
    features = [n for n in out.columns if n not in keys and n != target]
    return Prepared(out, target, keys, features, n_rows, steps)
