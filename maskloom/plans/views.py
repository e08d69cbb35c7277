"""Input views that several queries share, as SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import spread, table


def _pad(x: str, n: int, c: str = "0") -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '{c}')"


def _upper(x: str) -> str:
    return f"chr(CAST(65 + ({x}) % 26 AS INT))"


K = "c_custkey"
TEXT = ", ".join([
    "'Ref '", _upper(K), _upper(f"{K} * 7"), "'CDE'", _pad(f"{K} % 10000", 4), _upper(f"{K} * 3"),
    "' call +91 9'", _pad(f"({K} * 7919) % 1000000000", 9), "' card 4'", _pad(f"({K} * 104729) % 1000000000", 15, "1"),
    "' id '", _pad(f"({K} * 9176) % 10000", 4, "2"), "' 1234 '", _pad(f"({K} * 31) % 10000", 4, "3"),
    "' ssn '", _pad(f"{K} % 1000", 3), "'-12-'", _pad(f"{K} % 10000", 4),
    "' mail u'", f"CAST({K} AS STRING)", "'@'", f"CASE WHEN {K} % 2 = 0 THEN 'gmail.com' ELSE 'corp.co.in' END",
    "' ifsc HDFC0'", _pad(f"({K} * 17) % 1000000", 6), "' gst '", _pad(f"{K} % 100", 2), "'ABCDE'", _pad(f"{K} % 10000", 4), "'F1Z5'",
    "' voter ABC'", _pad(f"({K} * 13) % 10000000", 7), "' ein '", _pad(f"{K} % 100", 2, "1"), "'-'", _pad(f"({K} * 77) % 10000000", 7),
    "' ni AB'", _pad(f"({K} * 31) % 1000000", 6), "'C iban GB82WEST'", _pad(K, 14), "' host 10.'", f"CAST({K} % 256 AS STRING)", "'.0.'", f"CAST({K} % 100 AS STRING)",
    "' v6 2001:db8:0:0:0:0:0:'", f"CAST({K} % 9999 AS STRING)", "' see https://example.com/p/'", f"CAST({K} AS STRING)",
    f"CASE {K} % 3 WHEN 0 THEN ' the PASSWORD and api_key' WHEN 1 THEN ' internal only, bank account' ELSE ' nothing' END", "' at HDFC Bank near Pune'",
])
#: One prompt for each customer; ten customers share a session.
PROMPTS = f"SELECT CAST({K} AS BIGINT) AS doc_id, CAST(({K} - {K} % 10) / 10 AS BIGINT) AS session_id, concat({TEXT}) AS text FROM customer"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROMPTS.replace("FROM customer", "FROM {customer}"), customer=spread(table(spark, sf_dir, "customer").select("c_custkey")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a null text is empty."""
    return spread(table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') AS text"))
