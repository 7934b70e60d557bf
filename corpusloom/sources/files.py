"""JSON Lines in and out, vocabulary files, and reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import first_text


def read_jsonl(spark: SparkSession, paths: str | list[str], fields: tuple[str, ...] = ("text", "content")) -> DataFrame:
    """(path, text) of each record: blank and malformed lines are skipped, the first non-empty field is the text."""
    schema = ", ".join(f"{f} string" for f in fields)
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")
    parsed = lines.select("path", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select("path", first_text(*(F.col(f"r.{f}") for f in fields)).alias("text")).where("text is not null")


def read_split(spark: SparkSession, folder: str, split: str, limit: int | None = None, order: str = "id") -> DataFrame:
    """The JSON Lines of one split of a folder; with ``limit`` its first rows by ``order``."""
    rows = spark.read.json(os.path.join(folder, f"{split}.jsonl"))
    return rows if limit is None else rows.orderBy(order).limit(limit)


def read_shards(spark: SparkSession, folders: list[str], **how) -> DataFrame:
    """The records of several folders with each folder's rank; hidden files and state files are left out, no folders give no rows."""
    out = None if folders else spark.createDataFrame([], "path string, text string, dir_rank int")
    for rank, folder in enumerate(folders):
        part = read_jsonl(spark, [os.path.join(folder, "*.jsonl")], **how).withColumn("dir_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    return out.where(~F.rlike("path", F.lit(r"/\.[^/]*$|\.state\.json$")))


def profile(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: records, estimated tokens and bytes of a stored source."""
    from ..operators.ingest import estimated_tokens

    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(estimated_tokens(F.col(text))), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("n_bytes"))


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a line, UTF-8 as it is; with ``by``, one folder for each value (as for splits)."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def json_bytes(df: DataFrame, text: str = "text") -> DataFrame:
    """(n_docs, n_bytes) of the records {"text": ...} as JSON Lines with a blank after the colon and a newline."""
    return df.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(F.col(text).alias("text")))) + 2), F.lit(0)).cast("long").alias("n_bytes"))


def vocabulary_lines(vocab: DataFrame, by: str = "lang") -> DataFrame:
    """(lang, token_id, line): pieces in order of their ids, newlines and carriage returns escaped."""
    line = F.replace(F.replace(F.replace("piece", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return vocab.select(by, "token_id", line.alias("line")).orderBy(by, "token_id")


def as_markdown(rows: list[dict]) -> str:
    """A table with a heading row; columns are those of the first row, cells keep no line breaks or bars."""
    if not rows:
        return ""
    cell = lambda v: "" if v is None else str(v).replace("\n", " ").replace("|", "\\|")
    heads = list(rows[0])
    lines = [heads, ["-"] * len(heads), *([r.get(h) for h in heads] for r in rows)]
    return "".join("| " + " | ".join(map(cell, line)) + " |\n" for line in lines)


def as_text(rows: list[dict]) -> str:
    """Name and value of each column on a line, an empty line between rows."""
    return "\n".join("".join(f"{k}: {v}\n" for k, v in r.items()) for r in rows)


def write_report(rows: DataFrame, path: str, most: int = 10_000, form: str = "json") -> None:
    """A report table as one JSON, text or markdown file, put in place at once; more rows than a report has are refused."""
    found = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    content = {"json": lambda x: json.dumps(x, ensure_ascii=False, default=str), "text": as_text, "markdown": as_markdown}[form](found)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(path + ".tmp", path)


def read_config(path: str) -> dict:
    """A configuration file: JSON, or YAML where a reader for it is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: no YAML reader is installed; use JSON") from e
        return yaml.safe_load(f) or {}


def merged_config(*configs: dict) -> dict:
    """Later values win, key by key and level by level."""
    out: dict = {}
    for c in configs:
        for k, v in c.items():
            out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
