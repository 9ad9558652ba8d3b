"""What every regressor family shares."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.columns import col
from regatta.operators.transforms import TargetTransform

# The families on offer, and those whose features are robust-scaled.
FAMILIES = ("RF", "ET", "XGB", "LGB", "NN", "SVR", "LR")
SCALED_FAMILIES = ("NN", "SVR", "LR")
TREE_FAMILIES = ("RF", "ET", "XGB", "LGB")


VALUES_PER_ROW = 200_000  # of a saved array


@dataclass
class FittedModel:
    """A trained regressor. ``raw`` predicts on the transformed target's scale."""

    family: str
    features: list[str]
    params: dict[str, Any]
    transform: TargetTransform = field(default_factory=TargetTransform)
    ignored_params: list[str] = field(default_factory=list)

    def raw(self, df: DataFrame, output: str) -> DataFrame:
        raise NotImplementedError

    def decide(self, x: np.ndarray) -> np.ndarray:
        """``raw`` for rows of numbers in the order of the features."""
        raise NotImplementedError

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Adds the prediction on the target's own scale; row-parallel, no shuffle."""
        out = self.raw(df, output)
        if self.transform.kind == "none":
            return out
        return out.withColumn(output, self.transform.inverse(F.col(output)))

    # -- persistence -----------------------------------------------------------------
    def state(self) -> dict[str, np.ndarray]:
        """Arrays that make up the model."""
        raise NotImplementedError

    def header(self) -> dict:
        t = self.transform
        return {
            "family": self.family,
            "features": self.features,
            "params": self.params,
            "ignored_params": self.ignored_params,
            "transform": [t.kind, t.power, t.mean, t.std],
        }

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("header", [], 0, [], json.dumps(self.header()))]
        for name, values in self.state().items():
            values = np.asarray(values, dtype=float)
            flat = values.ravel()
            for part, at in enumerate(range(0, max(1, len(flat)), VALUES_PER_ROW)):
                piece = flat[at : at + VALUES_PER_ROW].tolist()
                rows.append((name, list(values.shape), part, piece, None))
        schema = "name string, shape array<int>, part int, data array<double>, header string"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[dict, dict[str, np.ndarray]]:
    header, parts, shapes = {}, {}, {}
    for r in spark.read.parquet(path).collect():
        if r["name"] == "header":
            header = json.loads(r["header"])
        else:
            parts.setdefault(r["name"], {})[r["part"]] = r["data"]
            shapes[r["name"]] = r["shape"]
    arrays = {
        n: np.concatenate([np.array(p[k], dtype=float) for k in sorted(p)]).reshape(shapes[n])
        for n, p in parts.items()
    }
    header["transform"] = TargetTransform(*header["transform"])
    return header, arrays


def require_positive(name: str, value) -> None:
    if value <= 0:
        raise ValueError(f"{name} must be positive")


def complete_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows that have a number in every one of these columns; a fit takes no others."""
    for name in names:
        df = df.where(col(name).isNotNull() & ~F.isnan(col(name).cast("double")))
    return df
