"""The library's tables as read from the driver's: attempts, inventory, sessions and others, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that all time windows are anchored at.
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt_id, user_id, question_id, ts, correctness (null: ungraded), test_linked."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    grade = F.when(F.col("event_type") == "purchase", "richtig").when(F.col("event_type") == "click", "teilweise").when(F.col("event_type") == "error", "falsch")
    return e.select(
        F.col("event_id").alias("attempt_id"), "user_id", k.alias("question_id"), "ts", grade.alias("correctness"), (F.col("event_type") == "signup").alias("test_linked"), (F.col("event_type") == "view").alias("viewed")
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, module, exam, kind, text of each question that occurs."""
    k = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("question_id")).distinct()
    return k.select("question_id", (F.col("question_id") % 3).alias("module"), (F.col("question_id") % 5).alias("exam"), F.when(F.col("question_id") % 4 == 0, "multi_part").otherwise("multiple_choice").alias("kind"))


#: The same in SQL, for the oracle.
SQL = """WITH attempts AS (SELECT event_id AS attempt_id, user_id, CAST(props->>'$.k' AS INT) AS question_id, ts,
  CASE event_type WHEN 'purchase' THEN 'richtig' WHEN 'click' THEN 'teilweise' WHEN 'error' THEN 'falsch' END AS correctness,
  event_type = 'signup' AS test_linked, event_type = 'view' AS viewed FROM events),
inventory AS (SELECT DISTINCT question_id, question_id % 3 AS module, question_id % 5 AS exam, CASE WHEN question_id % 4 = 0 THEN 'multi_part' ELSE 'multiple_choice' END AS kind FROM attempts),
formal AS (SELECT attempt_id, user_id, question_id, ts, correctness FROM attempts WHERE correctness IS NOT NULL AND NOT test_linked AND ts <= TIMESTAMP '2024-01-31 00:00:00'),
latest AS (SELECT * FROM formal QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY ts DESC, attempt_id DESC) = 1)
"""
