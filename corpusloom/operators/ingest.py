"""Ingest of prioritised sources under a budget, progress records, and versions of stored files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_total


def first_text(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def estimated_tokens(text: Column) -> Column:
    """A tenth of the bytes, one at least; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.greatest(F.lit(1), F.floor(F.octet_length(text) / 10))).cast("long")


def ordered_sources(manifest: DataFrame, name: str = "name") -> DataFrame:
    """(name, rank) by priority, 99 where it is missing; ties by name, as a table has no file order."""
    return manifest.select(name, F.row_number().over(Window.orderBy(F.coalesce("priority", F.lit(99)), name)).alias("rank"))


def within_budget(docs: DataFrame, manifest: DataFrame, source: str, key: str, amount: Column, budget: int) -> DataFrame:
    """The documents taken source by source in order until the budget is met; the one that crosses it is taken.

    Whole sources are decided by their sums (one row for each source); only the crossing source needs a running
    total over its rows, which is a prefix sum over partitions.
    """
    ranks = ordered_sources(manifest).withColumnRenamed("name", source)
    rows = docs.join(F.broadcast(ranks), source).withColumn("_a", amount.cast("long"))
    sums = rows.groupBy("rank").agg(F.sum("_a").alias("_s"))
    starts = sums.withColumn("_b", F.sum("_s").over(Window.orderBy("rank")) - F.col("_s"))
    whole = starts.where(F.col("_b") + F.col("_s") < budget).select("rank")
    crossing = starts.where((F.col("_b") < budget) & (F.col("_b") + F.col("_s") >= budget)).select("rank", "_b")
    part = running_total(rows.join(F.broadcast(crossing), "rank"), [key], F.col("_a"), "_before").where(F.col("_b") + F.col("_before") < budget)
    return rows.join(F.broadcast(whole), "rank").select(*docs.columns, "rank").union(part.select(*docs.columns, "rank"))


def totals(docs: DataFrame, source: str, text: str, target: int) -> DataFrame:
    """Rows, tokens and bytes of each source, the tokens missing to the target over all, and whether it is reached."""
    by = docs.groupBy(source).agg(F.count("*").alias("n_rows"), F.sum(estimated_tokens(F.col(text))).alias("tokens"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("n_bytes"))
    # one row for each source
    every = F.sum("tokens").over(Window.partitionBy())
    return by.select(source, "n_rows", "tokens", "n_bytes", F.greatest(F.lit(0), F.lit(target) - every).alias("missing"), (every >= target).alias("reached"))


def latest_records(log: DataFrame, name: str = "name", run: str = "run_no", at: str = "logged_at") -> DataFrame:
    """The last progress record of each run of each source, repeated deliveries once."""
    cols = [c for c in log.columns if c not in (name, run)]
    last = log.groupBy(name, run).agg(F.max_by(F.struct(*cols), F.struct(at, F.coalesce("raw_records_seen", F.lit(-1)))).alias("r"))
    return last.select(name, run, "r.*")


def resume_points(log: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status, raw_records_seen, tokens): where each source goes on; not_started without a record."""
    last = latest_records(log)
    newest = last.groupBy("name").agg(F.max_by(F.struct("status", "raw_records_seen", "tokens"), "run_no").alias("r"))
    rows = manifest.select("name").join(newest, "name", "left")
    return rows.select("name", F.coalesce("r.status", F.lit("not_started")).alias("status"), F.coalesce("r.raw_records_seen", F.lit(0)).alias("raw_records_seen"), F.coalesce("r.tokens", F.lit(0)).alias("tokens"))


def without_skipped(manifest: DataFrame, skipped: list[str], name: str = "name") -> DataFrame:
    """The sources whose name isn't on the skip list; an empty list skips none."""
    return manifest.where(F.col(name).isNull() | ~F.col(name).isin(*skipped)) if skipped else manifest


def after_records(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The records after the first n by ``order``, as a scan that goes on where it stopped."""
    from .ordered import row_index

    return row_index(df, order, "_at").where(F.col("_at") >= n).drop("_at")


def complete_files(manifest: DataFrame, listing: DataFrame, name: str = "name", size: str = "n_bytes", status: str = "status", done: str = "complete") -> DataFrame:
    """(name, usable): whether a record says the file is done and the file has the recorded size; null sizes are never equal."""
    last = manifest.select(name, status, F.col(size).alias("_want"))
    both = last.join(listing.select(name, F.col(size).alias("_have")), name, "left")
    return both.groupBy(name).agg(F.max(F.coalesce((F.col(status) == done) & (F.col("_want") == F.col("_have")), F.lit(False))).alias("usable"))


def newest_file(listing: DataFrame, by: list[str], path: str = "path", patterns: tuple[str, ...] = (r"step_([0-9]+)", r"checkpoint[_-]([0-9]+)"), pointers: DataFrame | None = None) -> DataFrame:
    """(by, path, step): the file that each group's pointer names, else the one of its greatest step.

    The step is read by the first pattern that fits; a pointer (by, path) to a file that isn't listed is ignored;
    groups with neither have no row.
    """
    found = F.coalesce(*(F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in patterns)).cast("long")
    rows = listing.withColumn("_s", found).withColumn("_p", F.lit(0))
    if pointers is not None:
        named = pointers.select(*by, path).distinct().withColumn("_named", F.lit(1))
        rows = rows.join(named, [*by, path], "left").withColumn("_p", F.coalesce("_named", F.lit(0)))
    rows = rows.where((F.col("_s").isNotNull()) | (F.col("_p") == 1))
    best = F.struct("_p", F.coalesce("_s", F.lit(-1)), path)
    return rows.groupBy(*by).agg(F.max_by(path, best).alias(path), F.max_by("_s", best).alias("step"))


def availability(languages: DataFrame, variants: DataFrame, newest: DataFrame) -> DataFrame:
    """Every language and variant with its newest file, or none. Both lists are fixed and short."""
    return languages.crossJoin(variants).join(newest, [*languages.columns, *variants.columns], "left")


# Words of refused requests, and of the wait they ask for.
DAY_WORDS, MINUTE_WORDS = r"(?i)per day|\brpd\b|\btpd\b|daily", r"(?i)per minute|\brpm\b|\btpm\b"
WAIT_WORDS = r"(?i)try again in\s+((?:[0-9]+h)?\s*(?:[0-9]+m)?\s*(?:[0-9.]+s)?)"


def limit_scope(message: Column) -> Column:
    """Whether a refused request ran into a limit of the day or of the minute; the day is looked for first."""
    return F.when(F.rlike(message, F.lit(DAY_WORDS)), "day").when(F.rlike(message, F.lit(MINUTE_WORDS)), "minute").otherwise("unknown")


def wait_seconds(message: Column) -> Column:
    """Seconds of a hint like "try again in 1h2m3.4s"; null without one."""
    hint = F.regexp_extract(message, WAIT_WORDS, 1)
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(hint, rf"([0-9.]+){unit}", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(F.rlike(hint, F.lit("[0-9]")), part("h") * 3600 + part("m") * 60 + part("s"))
