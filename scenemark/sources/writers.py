"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK-1."""
    df.write.mode("overwrite").json(path)


def write_scores(detail: DataFrame, summary: DataFrame, path: str) -> None:
    """SNK-2: header, summary row(s), then the detail rows in order.  Score tables have one
    row per feature or model, so they are written as a single sorted file."""
    rows = summary.withColumn("_s", F.lit(0)).unionByName(detail.withColumn("_s", F.lit(1)))
    order = ["_s"] + (["ord"] if "ord" in rows.columns else [])
    rows.orderBy(*order).drop("_s", "ord").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_questions(questions: DataFrame, path: str) -> None:
    """SNK-3: one folder per perspective."""
    questions.write.mode("overwrite").partitionBy("perspective").json(path)
