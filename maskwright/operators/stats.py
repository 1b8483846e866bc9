"""Aggregates over the task log; none of them shows an original value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.constants import STATUSES

ZONE = "Asia/Shanghai"


def local_day(created) -> F.Column:
    return F.to_date(F.from_utc_timestamp(created, ZONE))


def scalar_counts(entity_counts: DataFrame, examples: DataFrame, labels: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: entities (the sum over maps ``counts``, a null map or number none), training_examples, active_labels, training_documents.

    Each table is aggregated by itself and the four rows are summed; empty tables count 0, rows that repeat count each.
    """
    numbers = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    parts = [entity_counts.agg(F.sum(numbers).alias("entities")), examples.agg(F.count("*").alias("training_examples")), labels.agg(F.count_if("active").alias("active_labels")), documents.agg(F.count("*").alias("training_documents"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in out.columns])


def status_distribution(tasks: DataFrame) -> DataFrame:
    """Every status in its declared order, zeros included."""
    spark = tasks.sparkSession
    spine = spark.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "pos int, status string")
    counts = tasks.groupBy("status").agg(F.count("*").alias("n"))
    return spine.join(counts, "status", "left").select("pos", "status", F.coalesce("n", F.lit(0)).alias("n"))


def daily_spine(tasks: DataFrame, days: int = 7) -> DataFrame:
    """The last ``days`` local days up to the newest task, zeros included."""
    day = tasks.select(local_day("created_at").alias("day"))
    span = day.agg(F.max("day").alias("last")).select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    counts = day.groupBy("day").agg(F.count("*").alias("n"))
    return span.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def review_totals(tasks: DataFrame) -> DataFrame:
    names = ("candidate_count", "selected_count", "rejected_count", "corrected_count", "added_count")
    return tasks.agg(*[F.coalesce(F.sum(F.coalesce(n, F.lit(0))), F.lit(0)).cast("long").alias(n) for n in names], F.count_if(F.col("reviewed")).alias("reviewed_tasks"))


def durations(tasks: DataFrame) -> DataFrame:
    good = tasks.filter("duration_ms >= 0")
    return good.agg(F.round(F.avg("duration_ms") / 1000, 3).alias("avg_s"), F.round(F.max("duration_ms") / 1000, 3).alias("max_s"), F.count("*").alias("n"))


def rates(tasks: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status").isin("completed", "restored"))
    share = lambda a, b: F.when(b > 0, F.round(100.0 * a / b, 1)).otherwise(F.lit(0.0))
    return tasks.agg(share(done, F.count("*")).alias("completion_rate"), share(F.sum("selected_count"), F.sum("candidate_count")).alias("acceptance_rate"))
