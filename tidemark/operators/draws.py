"""One draw a user and UTC day: the first one stands, later requests get it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import day_start


def first_of_day(requests: DataFrame) -> DataFrame:
    """The first request of each user and UTC day, by time, then id.  A partial aggregation, so a busy user costs a row a task."""
    row = F.struct(*[F.col(c) for c in requests.columns])
    firsts = requests.groupBy("userId", day_start(F.col("createdAt")).alias("__day")).agg(F.min_by(row, F.struct("createdAt", "id")).alias("e"))
    return firsts.select("e.*")


def answered(requests: DataFrame) -> DataFrame:
    """Every request with the id of the draw it gets and whether that was there already."""
    day = Window.partitionBy("userId", day_start(F.col("createdAt"))).orderBy("createdAt", "id")
    return requests.withColumn("draw_id", F.first("id").over(day)).withColumn("alreadyDrawn", F.row_number().over(day) > 1)
