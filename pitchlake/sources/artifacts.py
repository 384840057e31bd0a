"""Versioned tables and model weights, and whether two versions are the same.

A version is a table under root/name/version, written once. Beside it stands its digest by group:
how many rows, and two sums of row hashes. Sums do not depend on the order of rows
or how they are dealt out, and count repeated rows; so two versions are compared a
row a group, without joining or sorting them, and only groups that differ are read again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.functions import evaluation

WEIGHTS = "name string, shape array<int>, values array<double>"
KINDS = ("n", "digest_a", "digest_b")


def digest(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, digest_a, digest_b): equal for tables with the same rows, as often each, in any order; columns count by name."""
    names = sorted(df.columns)
    # a negative zero is equal to zero, and hashes otherwise
    values = [(F.col(c) + F.lit(0.0)).cast(df.schema[c].dataType) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c in names]
    # nulls leave a hash as it is: which columns are null is hashed, too
    row = [*values, F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in names])]
    big = "decimal(38,0)"
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.lit(1), *row).cast(big)).alias("digest_a"), F.sum(F.xxhash64(F.lit(2), *row).cast(big)).alias("digest_b"))


def differing(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_a, n_b, same) of two digests, a row for every group that either has."""
    x, y = (d.select(*by, *[F.col(k).alias(f"{k}_{s}") for k in KINDS]) for d, s in ((a, "a"), (b, "b")))
    both = x.join(y, by, "full")
    same = F.coalesce((F.col("n_a") == F.col("n_b")) & (F.col("digest_a_a") == F.col("digest_a_b")) & (F.col("digest_b_a") == F.col("digest_b_b")), F.lit(False))
    return both.select(*by, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), same.alias("same"))


class Artifacts:
    """Versions of named tables under a root that Spark can write."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _at(self, name: str, version: str, part: str) -> str:
        return f"{self.root}/{name}/{version}/{part}"

    def save(self, df: DataFrame, name: str, version: str, by: list[str]) -> DataFrame:
        """Write a version, partitioned by those columns, and its digest by them; an error if it exists."""
        df.write.partitionBy(*by).parquet(self._at(name, version, "rows"))
        kinds = T.StructType([f for f in df.schema if f.name not in by] + [f for f in df.schema if f.name in by])
        saved = self.spark.read.schema(kinds).parquet(self._at(name, version, "rows")).select(*df.columns)
        digest(saved, by).write.parquet(self._at(name, version, "digest"))
        return saved

    def load(self, name: str, version: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name, version, "rows"))

    def compare(self, name: str, a: str, b: str, by: list[str]) -> DataFrame:
        """differing() of two versions, from their digests alone."""
        return differing(*(self.spark.read.parquet(self._at(name, v, "digest")) for v in (a, b)), by)

    def rows_that_differ(self, name: str, a: str, b: str, by: list[str]) -> DataFrame:
        """Rows that one version has more often than the other, marked `a` or `b`; reads only the groups whose digests differ."""
        groups = self.compare(name, a, b, by).filter(~F.col("same")).select(*by)
        x, y = (self.load(name, v).join(groups, by, "left_semi") for v in (a, b))
        return evaluation.diff(x, y)

    def save_weights(self, weights: dict[str, np.ndarray], name: str, version: str) -> None:
        """A model's arrays, an array a row."""
        rows = [(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in sorted(weights.items())]
        self.spark.createDataFrame(rows, WEIGHTS).coalesce(1).write.parquet(self._at(name, version, "rows"))

    def load_weights(self, name: str, version: str) -> dict[str, np.ndarray]:
        rows = self.spark.read.schema(WEIGHTS).parquet(self._at(name, version, "rows")).collect()  # as many as the model has arrays
        return {r.name: np.array(r["values"], dtype=np.float64).reshape(r["shape"]) for r in rows}
