"""Incremental ingest with Structured Streaming: resumable reads, deduplication by URL and by content, a budget."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedup
from ..operators.ingest import estimated_tokens


def read_pages(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Stored records as a stream; the checkpoint of the query that reads it remembers which files are done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def once_per_url(pages: DataFrame, at: str, url: str = "url", within: str | None = "30 days") -> DataFrame:
    """Each URL once within the watermark, so the state stays bounded; later repetitions count as new.

    With ``within`` None each URL once for ever: the state then has a row for each URL and belongs into a state
    store on disk (spark.sql.streaming.stateStore.providerClass).
    """
    if within is None:
        return pages.dropDuplicates([url])
    return pages.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark([url])


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, or none of its rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def start_near_dedup(docs: DataFrame, out: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Writes the documents of each micro-batch that share no band with one kept before, in this or an earlier batch.

    The bands of kept documents are a table of their own under out/bands; a batch that is repeated after a
    failure finds its own rows there by batch number and replaces them.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _stored(spark, f"{out}/bands", "band int, band_key long, batch int").where(F.col("batch") < number)
        rows = batch.persist()
        sigs = dedup.signatures(rows, key, text)
        keep = dedup.greedy_keep(sigs, key, known)
        short = rows.join(sigs.select(key), key, "left_anti").select(key)
        kept = rows.join(keep.union(short), key, "left_semi")
        kept.write.mode("overwrite").parquet(f"{out}/docs/batch={number}")
        dedup.bands(sigs.join(keep, key, "left_semi"), key).select("band", "band_key").write.mode("overwrite").parquet(f"{out}/bands/batch={number}")
        rows.unpersist()

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_budgeted(docs: DataFrame, out: str, checkpoint: str, budget: int, text: str = "text") -> StreamingQuery:
    """Appends micro-batches until the estimated tokens written reach the budget; the batch that crosses it is written.

    Beside out, out_sums has one row for each batch, so that no batch reads the texts of those before.
    """
    totals = out.rstrip("/") + "_sums"

    def step(batch: DataFrame, number: int) -> None:
        sums = _stored(batch.sparkSession, totals, "tokens long, batch int").where(F.col("batch") < number)
        done = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        if done < budget:
            rows = batch.persist()
            rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
            rows.agg(F.coalesce(F.sum(estimated_tokens(F.col(text))), F.lit(0)).cast("long").alias("tokens")).write.mode("overwrite").parquet(f"{totals}/batch={number}")
            rows.unpersist()

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
