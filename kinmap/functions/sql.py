"""The engine's functions under SQL names: ``l2_distance``, ``vote_weight``, the aggregate ``vote_tally`` and the table function ``decode_features``."""

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType

from kinmap.sources.vectors import decode_set


@udtf(returnType="kp_idx bigint, vec array<double>")
class DecodeFeatures:
    """A row for each descriptor of a serialised set."""

    def eval(self, content: bytes) -> Iterator[tuple[int, list[float]]]:
        if content is not None:
            for i, row in enumerate(decode_set(bytes(content))):
                yield i, [float(x) for x in row]


@pandas_udf(DoubleType())
def vote_tally(position: pd.Series) -> float:
    """The sum of 1 / position over a group; its order does not matter."""
    return math.fsum(1.0 / position.dropna())


def register(spark: SparkSession) -> None:
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION l2_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"""
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vote_weight(position BIGINT) RETURNS DOUBLE RETURN 1.0D / position")
    spark.udf.register("vote_tally", vote_tally)
    spark.udtf.register("decode_features", DecodeFeatures)
