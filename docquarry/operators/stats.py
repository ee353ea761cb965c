"""Reports over an index, and timing of searches."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tier_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("index_tier").agg(F.count("*").alias("n"))


def demotion_counts(documents: DataFrame) -> DataFrame:
    return documents.where("demotion_reason IS NOT NULL").groupBy("demotion_reason").agg(F.count("*").alias("n"))


def corpus_bytes(files: DataFrame) -> DataFrame:
    """One row: the size of all files, skipped ones too."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def nearest_rank(values: DataFrame, column: str, percents: Sequence[float]) -> DataFrame:
    """``percent, value``: ``sorted[round(percent/100 * (n-1))]``, halves away from zero; 0 without values.

    Values are counted first and ranked by running sums within ranges, so no task gets all rows.
    """
    from pyspark.sql import Window

    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()).cache()
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))  # one row a partition
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value")) + F.col("before")
    ranks = ranged.join(F.broadcast(before), "part").select("value", (upto - F.col("n")).alias("low"), upto.alias("high"), "total")
    wanted = values.sparkSession.createDataFrame([(float(p),) for p in percents], "percent double")
    at = F.round(F.col("percent") / 100 * (F.col("total") - 1))
    found = ranks.join(F.broadcast(wanted), (at >= F.col("low")) & (at < F.col("high"))).select("percent", F.col("value").cast("double").alias("value"))
    return wanted.join(found, "percent", "left").select("percent", F.coalesce("value", F.lit(0.0)).alias("value"))


def nearest_rank_py(values: Sequence[float], p: float) -> float:
    if not values:
        return 0.0
    return sorted(values)[math.floor(p / 100 * (len(values) - 1) + 0.5)]


def throughput(documents: int, seconds: float) -> float:
    """Documents a second; 0 where no time passed."""
    return documents / seconds if seconds > 0 else 0.0


#: Milliseconds within which 95 of 100 searches should end.
TARGET_MS = 1000


def latencies(run: Callable[[str], object], queries: Sequence[str], repeat: int = 20) -> dict[str, float | bool]:
    """Times of every query, each ``repeat`` times, the first included: the median, the 95th of 100, whether
    that is in time, and the slowest first run."""
    times = []
    for _ in range(repeat):
        for query in queries:
            began = time.perf_counter()
            run(query)
            times.append((time.perf_counter() - began) * 1000)
    p95 = nearest_rank_py(times, 95)
    return {"runs": len(times), "p50_ms": nearest_rank_py(times, 50), "p95_ms": p95, "first_ms": max(times[: len(queries)], default=0.0), "passed": p95 <= TARGET_MS}
