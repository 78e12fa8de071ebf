"""ST2: running skill statistics over the two feeds.

A tagged union of both streams is grouped by skill (state grows with the
number of skills only; no watermark, as the service keeps counting forever).
Update mode emits changed skills per batch into a change log; readers take the
latest row per skill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.stats import correction_rate
from .common import read_changelog, write_batch


def start_stats(spark: SparkSession, invocations_src: str, corrections_src: str, sink: str, checkpoint: str,
                available_now: bool = True, max_files_per_trigger: int | None = None):
    def reader():
        r = spark.readStream.schema("skill_name string")
        return r.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else r

    inv = reader().parquet(invocations_src)
    cor = reader().parquet(corrections_src)
    tagged = (inv.select("skill_name", F.lit(1).alias("inv"), F.lit(0).alias("cor"))
              .unionByName(cor.select("skill_name", F.lit(0).alias("inv"), F.lit(1).alias("cor"))))
    agg = tagged.groupBy("skill_name").agg(F.sum("inv").cast("long").alias("invocation_count"),
                                           F.sum("cor").cast("long").alias("correction_count"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, sink, batch_id)

    w = (agg.writeStream.outputMode("update").foreachBatch(per_batch).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_stats(spark: SparkSession, sink: str) -> DataFrame:
    cur = read_changelog(spark, sink, ["skill_name"],
                         "skill_name string, invocation_count long, correction_count long")
    return cur.withColumn("correction_rate", correction_rate(F.col("correction_count"), F.col("invocation_count")))
