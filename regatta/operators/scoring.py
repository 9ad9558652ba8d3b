"""Univariate feature scores and top-k selection."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.columns import chunks, col, require_columns
from regatta.operators.mutual_info import mutual_info_binned
from regatta.operators.neighbours import mutual_info_neighbours

FEATURES_PER_JOB = 100
SCORE_SCHEMA = "feature string, ordinal int, score double"


def _unpivoted(aggregated: DataFrame, names: list[tuple[str, int]], scores: list[Column]) -> DataFrame:
    """Names travel with their values, so nothing is glued by position."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.lit(i).alias("ordinal"), s.alias("score"))
            for (n, i), s in zip(names, scores)
        ]
    )
    return aggregated.select(F.inline(rows))


def f_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """``feature, ordinal, score`` with F = r^2 / (1 - r^2) * (n - 2), all in one pass.

    A constant feature scores 0 and a perfectly correlated one the largest double. Rows where
    the feature or the target is null do not count for that feature.
    """
    require_columns(df, [*features, target])
    y = col(target).cast("double")
    out = None
    for group in chunks(list(enumerate(features)), FEATURES_PER_JOB):
        aggs = []
        for i, n in group:
            x = _number(df, n)
            both = x.isNotNull() & y.isNotNull()
            aggs += [
                F.covar_pop(x, y).alias(f"c{i}"), F.count_if(both).alias(f"n{i}"),
                F.stddev_pop(F.when(both, x)).alias(f"s{i}"),
                F.stddev_pop(F.when(both, y)).alias(f"t{i}"),
            ]
        scores = []
        for i, _ in group:
            r = F.try_divide(F.col(f"c{i}"), F.col(f"s{i}") * F.col(f"t{i}"))
            ratio = F.try_divide(r * r, F.lit(1.0) - r * r)
            scores.append(
                F.when(r.isNull(), F.lit(0.0))
                .when((r * r >= 1.0) | ratio.isNull(), F.lit(sys.float_info.max))
                .otherwise(ratio * (F.col(f"n{i}") - 2))
            )
        part = _unpivoted(df.agg(*aggs), [(n, i) for i, n in group], scores)
        out = part if out is None else out.unionByName(part)
    return out


def _number(df: DataFrame, name: str) -> Column:
    return col(name).cast("double")


SCORERS = {
    "f_regression": f_regression,
    "mutual_info_regression": mutual_info_neighbours,
    "mutual_info_binned": mutual_info_binned,
}


def feature_scores(
    df: DataFrame, features: list[str], target: str, scoring: str = "f_regression"
) -> DataFrame:
    if scoring not in SCORERS:
        raise ValueError(f"unknown feature scoring: {scoring}")
    return SCORERS[scoring](df, features, target)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k largest scores; ties keep column order."""
    return scores.orderBy(F.desc_nulls_last("score"), "ordinal").limit(k)


def select_features(
    df: DataFrame,
    features: list[str],
    target: str,
    n_features: int = 0,
    scoring: str = "f_regression",
) -> list[str]:
    """Names of the best features in score order; 0 keeps all in column order."""
    if n_features < 0:
        raise ValueError("n_features must not be negative")
    if n_features == 0:
        return list(features)
    if n_features > len(features):
        raise ValueError(f"{n_features} features asked for, {len(features)} present")
    best = top_k(feature_scores(df, features, target, scoring), n_features)
    rows = best.collect()
    return [r["feature"] for r in rows]


def project_features(
    df: DataFrame, keys: list[str], target: str, selected: list[str]
) -> DataFrame:
    return df.select(*[col(n) for n in [*keys, target, *selected]])
