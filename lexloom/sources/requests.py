"""Requests as rows: parsed from JSON and checked, rejected ones kept with their error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import strip

SCHEMA = "question string, query string, facts string, act_name string, language string, user_type string, conversation_id string, filters map<string,string>, top_k int"
#: Field, least and greatest length, of each kind of request.
LIMITS = {"chat": ("question", 1, 4000), "search": ("query", 1, 2000), "analyze": ("facts", 5, 5000), "summary": ("act_name", 1, 500)}


def parse(df: DataFrame, body: str, kind: str) -> DataFrame:
    """Add the request's fields with their defaults, and error, null for a valid request."""
    field, least, most = LIMITS[kind]
    out = df.withColumn("_r", F.from_json(body, SCHEMA)).select("*", "_r.*").drop("_r")
    text = F.col(field)
    checks = [
        (text.isNull(), "missing"),
        (F.length(text) < least, "too short"),
        (F.length(text) > most, "too long"),
        (~F.coalesce(F.col("top_k"), F.lit(8)).between(1, 50), "top_k out of range"),
    ]
    if kind == "chat":
        checks.append((F.length(strip(text)) < 3, "too short"))
    error = None
    for broken, message in checks:
        error = F.when(broken, f"{field}: {message}") if error is None else error.when(broken, f"{field}: {message}")
    return out.withColumns({"user_type": F.coalesce("user_type", F.lit("general")), "top_k": F.coalesce("top_k", F.lit(8)), "error": error})
