"""Vectors of texts from vectors of their parts: mean pooling, unit length, and what a similarity adds to a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: how much a similarity adds at most, and from which on
WEIGHT, LEAST = 25, 0.55


def unit(vector: Column) -> Column:
    """The vector at length 1; one of length 0 as it is."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(x))


def mean_pooled(rows: DataFrame, key: str, vector: str, dimensions: int, counts: Column | None = None) -> DataFrame:
    """key, vector (unit length) and n: the mean of the vectors of each key. counts: which rows count (an attention mask).

    Sums of components are aggregated in each task before the shuffle, whatever a key has. Null vectors and those of other
    than `dimensions` components are left out; a null component counts as 0.
    """
    own = F.col(vector).cast("array<double>")
    kept = rows.filter(F.size(own) == dimensions)
    if counts is not None:
        kept = kept.filter(counts)
    sums = kept.select(F.col(key), own.alias("v")).groupBy(key).agg(F.count("*").alias("n"), *(F.sum(F.coalesce(F.get("v", F.lit(k)), F.lit(0.0))).alias(f"s{k}") for k in range(dimensions)))
    mean = F.array(*(F.col(f"s{k}") / F.col("n") for k in range(dimensions)))
    return sums.select(key, mean.alias("vector"), "n").select(key, unit(F.col("vector")).alias("vector"), "n")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; of unit vectors their cosine. 0 where one is null."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), F.lit(0.0))


def similarity_bonus(similarity: Column, weight: float = WEIGHT, least: float = LEAST) -> Column:
    """Whole points: weight times a similarity of `least` and more, else 0."""
    s = F.coalesce(similarity, F.lit(0.0))
    return F.when(s >= least, (s * weight).cast("int")).otherwise(0)


def with_similarity(scored: DataFrame, parts: DataFrame, sites: DataFrame, doc: str, dimensions: int, weight: float = WEIGHT, least: float = LEAST) -> DataFrame:
    """scored pairs (doc, id, score, reasons, ...) with the bonus of similar texts added and EMBEDDING_MATCH among the reasons.

    parts: doc, vector of the parts of each document's delivery block; sites: id, vector of the parts of each site's address. Both are pooled.
    """
    a = mean_pooled(parts, doc, "vector", dimensions).select(doc, F.col("vector").alias("_a"))
    b = mean_pooled(sites, "id", "vector", dimensions).select("id", F.col("vector").alias("_b"))
    rows = scored.join(a, doc, "left").join(b, "id", "left").withColumn("_bonus", similarity_bonus(dot(F.col("_a"), F.col("_b")), weight, least))
    reasons = F.when(F.col("_bonus") > 0, F.array_append("reasons", F.lit("EMBEDDING_MATCH"))).otherwise(F.col("reasons"))
    return rows.withColumns({"score": F.col("score") + F.col("_bonus"), "reasons": reasons}).select(scored.columns)
