"""Sources and sinks: session files and fact tables in Markdown, inbox folders, JSON results with redaction, idempotent tables."""

from __future__ import annotations

import sys
import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package installed

# The layout of a session block.
SESSION = "struct<sessionId:string,messages:array<struct<role:string,content:string>>>"
_BLOCK = r"(?s)```context-session\s*\n(.*?)\n```"
_SECRET = r"(?i)\b(api[_-]?key|token|secret|password|authorization)(\"?\s*[:=]\s*\"?)([^\s\",;]+)"


def session_messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, batch_id, session_id, position, role, content) of the session blocks of Markdown documents. Blocks that are no JSON give none."""
    x = df.select(F.col(key), F.regexp_extract(text, r"(?m)^batch_id:[ \t]*(\S+)", 1).alias("batch_id"), F.explode(F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(1))).alias("_b"))
    x = x.withColumn("_s", F.from_json("_b", SESSION))
    x = x.select(key, "batch_id", F.col("_s.sessionId").alias("session_id"), F.posexplode("_s.messages").alias("position", "_m"))
    return x.select(key, "batch_id", "session_id", "position", "_m.role", "_m.content")


def fact_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line, fact_text, fact_type, confidence) of Markdown tables that begin with factText and factType; a table without a third column has null confidence."""
    x = df.where(F.col(text).contains("| factText | factType |")).select(F.col(key), F.posexplode(F.split(text, r"\r?\n")).alias("line", "_l"))
    x = x.where(F.col("_l").rlike(r"^\|.*\|\s*$") & ~F.col("_l").rlike(r"^\|\s*(factText\s*\||-{3})")).withColumn("_c", F.split(F.regexp_replace(F.trim("_l"), r"^\||\|$", ""), r"\|"))
    cell = lambda i: F.trim(F.get("_c", F.lit(i)))
    return x.where(F.size("_c") >= 2).select(key, "line", cell(0).alias("fact_text"), cell(1).alias("fact_type"), cell(2).alias("confidence"))


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """The files of an inbox, first level: (path, idempotency_key, text). .docx texts are taken out of the archive; unreadable ones are null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,json,docx}").load(folder)
    stamp = F.concat_ws(":", "path", F.unix_millis("modificationTime"), "length").alias("idempotency_key")
    text = F.when(F.lower("path").endswith(".docx"), docx_text(F.col("content"))).otherwise(F.decode("content", "UTF-8"))
    return files.select("path", stamp, text.alias("text"))


@F.pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """The paragraphs of Word files, a line each; null for anything else."""

    def one(data: bytes) -> str | None:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(BytesIO(data)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        return "\n".join("".join(t.text or "" for t in p.iter(f"{name}t")) for p in root.iter(f"{name}p"))

    return content.map(one)


def redacted(text: Column) -> Column:
    """Secrets after names like token= or password: replaced by [redacted]; user info in URLs as well."""
    return F.regexp_replace(F.regexp_replace(text, _SECRET, "$1$2[redacted]"), r"://[^/\s:@]+:[^/\s@]+@", "://[redacted]@")


def write_results(df: DataFrame, path: str, commit_id: str, texts: list[str]) -> None:
    """A JSON-lines artifact with one row for each commit id and redacted texts; Spark's committer makes it appear whole or not at all."""
    out = df.dropDuplicates([commit_id])
    for c in texts:
        out = out.withColumn(c, redacted(F.col(c)))
    out.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """JSON-lines results, the last row of each key."""
    x = spark.read.schema(schema).json(path)
    rest = [c for c in x.columns if c != key]
    return x.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with the rows of new merged in by key: the row that is last by order wins, new ones on a tie."""
    x = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in x.columns if c not in (key, "_n")]
    return x.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "_n")).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
