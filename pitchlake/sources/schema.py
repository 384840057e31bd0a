"""The canonical tables, and checks on what is read into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TRACKING = T.StructType(
    [
        T.StructField("match_id", T.LongType()), T.StructField("period", T.IntegerType()), T.StructField("frame", T.LongType()),
        T.StructField("fps", T.IntegerType()), T.StructField("t_ms", T.LongType()), T.StructField("player_id", T.LongType()),
        T.StructField("team", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
    ]
)
MATCHES = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("fps", T.IntegerType()), T.StructField("has_shots", T.BooleanType()), T.StructField("pitch_length", T.DoubleType()), T.StructField("pitch_width", T.DoubleType())])
ROSTER = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("player_id", T.LongType()), T.StructField("team", T.StringType()), T.StructField("role", T.StringType()), T.StructField("is_gk", T.BooleanType())])
SHOTS = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("period", T.IntegerType()), T.StructField("frame", T.LongType()), T.StructField("team", T.StringType())])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns, cast to its types; a missing column is an error, further ones are dropped."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
