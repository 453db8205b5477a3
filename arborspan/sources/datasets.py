"""Generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def make_plus(spark: SparkSession, n_samples: int = 1500, *, grid: int = 3, margin: float = 0.05, random_state: int | None = None) -> DataFrame:
    """``(row_id, x0, x1, y)``: points of a ``grid`` by ``grid`` square, away from
    cell borders by ``margin``; ``y`` is 1 in the middle column and the middle row.

    Points are uniform in uniform cells, by a hash of the seed and the row number.
    """
    if n_samples < 1 or grid < 1 or not 0 <= margin < 0.5:
        raise ValueError("n_samples and grid must be positive and margin in [0, 0.5)")
    seed = 42 if random_state is None else int(random_state)
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("row_id")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rows = spark.range(n_samples).withColumnRenamed("id", "row_id")
    rows = rows.withColumn("c0", F.floor(unit(0) * grid)).withColumn("c1", F.floor(unit(1) * grid))
    inside = lambda k: F.lit(margin) + unit(k) * F.lit(1 - 2 * margin)
    plus = (F.col("c0") == grid // 2) | (F.col("c1") == grid // 2)
    return rows.select("row_id", (F.col("c0") + inside(2)).alias("x0"), (F.col("c1") + inside(3)).alias("x1"), plus.cast("int").alias("y"))
