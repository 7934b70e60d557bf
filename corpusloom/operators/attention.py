"""Statistics of attention weights, as a long table (layer, sequence, head, q, k, w), and causal attention itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def causal(vectors: DataFrame, sequence: str, position: str, vector: str, heads: int) -> DataFrame:
    """(sequence, head, q, k, w): softmax of scaled products of each position with itself and those before it.

    Each head has an equal part of the vector.  Weights are quadratic in a sequence's length by nature, which a
    model's context bounds; sequences are joined by their own key only.
    """
    size = (F.size(vector) / heads).cast("int")
    head = F.explode(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.struct(h.alias("head"), F.slice(vector, h * size + 1, size).alias("v"))))
    parts = vectors.select(F.col(sequence).alias("sequence"), F.col(position).alias("pos"), head.alias("h")).select("sequence", "pos", "h.*")
    q = parts.select("sequence", "head", F.col("pos").alias("q"), F.col("v").alias("a"))
    k = parts.select("sequence", "head", F.col("pos").alias("k"), F.col("v").alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    scores = q.join(k, ["sequence", "head"]).where("k <= q").select("sequence", "head", "q", "k", (dot / F.sqrt(F.size("a").cast("double"))).alias("s"))
    w = Window.partitionBy("sequence", "head", "q")
    e = F.exp(F.col("s") - F.max("s").over(w))
    return scores.select("sequence", "head", "q", "k", e.alias("e")).select("sequence", "head", "q", "k", (F.col("e") / F.sum("e").over(w)).alias("w"))


def entropy(weights: DataFrame, *by: str) -> DataFrame:
    """Mean entropy over all queries of each head; weights under 1e-10 count as that."""
    p = F.greatest("w", F.lit(1e-10))
    per = weights.groupBy(*by, "sequence", "q").agg((-F.sum(p * F.ln(p))).alias("h"))
    return per.groupBy(*by).agg(F.round(F.avg("h"), 4).alias("entropy"))


def distance(weights: DataFrame, *by: str) -> DataFrame:
    """Mean distance attended to, over all queries of each head."""
    per = weights.groupBy(*by, "sequence", "q").agg(F.sum(F.col("w") * F.abs(F.col("q") - F.col("k"))).alias("d"))
    return per.groupBy(*by).agg(F.round(F.avg("d"), 2).alias("distance"))


def stats(weights: DataFrame, *by: str) -> DataFrame:
    """Entropy and distance of each head together, so that the weights are made once."""
    p = F.greatest("w", F.lit(1e-10))
    per = weights.groupBy(*by, "sequence", "q").agg((-F.sum(p * F.ln(p))).alias("h"), F.sum(F.col("w") * F.abs(F.col("q") - F.col("k"))).alias("d"))
    return per.groupBy(*by).agg(F.round(F.avg("h"), 4).alias("entropy"), F.round(F.avg("d"), 2).alias("distance"))


def over_samples(values: DataFrame, by: list[str], value: str, places: int = 4) -> DataFrame:
    """Average over samples of the rounded values."""
    return values.groupBy(*by).agg(F.round(F.avg(F.round(value, places)), places).alias(value))


def shift(before: DataFrame, after: DataFrame, value: str, places: int = 4) -> DataFrame:
    """Change of each head, its layer's and the overall mean, and its rank from both ends."""
    b = before.select("layer", "head", F.col(value).alias("was"))
    rows = after.join(b, ["layer", "head"]).select("layer", "head", F.round(F.col(value) - F.col("was"), places).alias("change"))
    # heads of one model: a bounded table
    every, layer = Window.partitionBy(), Window.partitionBy("layer")
    return rows.select(
        "layer", "head", "change", F.round(F.avg("change").over(layer), places).alias("layer_mean"), F.round(F.avg("change").over(every), places).alias("overall"),
        F.row_number().over(Window.orderBy(F.desc("change"), "layer", "head")).alias("from_top"), F.row_number().over(Window.orderBy("change", "layer", "head")).alias("from_bottom"),
    )
