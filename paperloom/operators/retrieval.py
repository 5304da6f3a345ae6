"""Lexical and vector retrieval, fusion and the evidence gate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def term_weights(words: DataFrame, array: str, terms: list[str]) -> DataFrame:
    """``term, idf`` with ``idf = ln((N + 1) / (df + 0.5))``: one pass, a row a term."""
    held = [F.count_if(F.array_contains(array, t)).alias(f"n{i}") for i, t in enumerate(terms)]
    counts = words.agg(F.count("*").alias("all"), *held)
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.log((F.col("all") + 1) / (F.col(f"n{i}") + 0.5)).alias("idf")) for i, t in enumerate(terms)])
    return counts.select(F.inline(rows))


def term_coverage(words: DataFrame, id: str, array: str, terms: list[str]) -> DataFrame:
    """Share of the query's idf that a row's words hold.  The weights are one row, and so broadcast."""
    weights = term_weights(words, array, terms).agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("__idf"))
    joined = words.crossJoin(F.broadcast(weights))
    total = sum((F.element_at("__idf", t) for t in terms), F.lit(0.0))
    held = sum((F.when(F.array_contains(array, t), F.element_at("__idf", t)).otherwise(0.0) for t in terms), F.lit(0.0))
    return joined.withColumn("coverage", held / total).drop("__idf")


def cosine(a: Column, b: Column) -> Column:
    """Null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, tie: str, block_bytes: int = 32 << 20) -> DataFrame:
    """Exact top-k rows by cosine for each query (``query, q``), ties by ``tie``: ``query, tie, similarity, rank``.

    The queries are taken in blocks of about ``block_bytes`` (at most twice that, but one query
    at least), which go to every task; a pass a block multiplies matrices, each batch returns
    at most ``k`` rows a query, and the block's result is written before the block is let go:
    the driver holds one block at a time.  Zero vectors, nulls and vectors of another length
    are near nothing.
    """
    asked = queries.select(F.col("query").cast("long").alias("query"), F.col("q").cast("array<double>").alias("q")).where("q IS NOT NULL")
    rows = vectors.select(F.col(tie).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
    total = asked.agg(F.sum(8 * (F.size("q") + 1))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "id"))
    parts = []
    for i in range(n):
        chosen = asked.where(F.pmod(F.xxhash64("query"), F.lit(n)) == i).toArrow().combine_chunks()
        shared = vectors.sparkSession.sparkContext.broadcast((chosen["query"].to_pylist(), chosen["q"].to_pylist()))
        found = rows.mapInArrow(lambda it, shared=shared: _near(it, *shared.value, k), "query long, id long, similarity double")
        parts.append(stored(found.withColumn("rank", place).where(F.col("rank") <= k), "nearest"))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts).select("query", F.col("id").alias(tie), "similarity", "rank")


def _near(batches: Iterator[pa.RecordBatch], names: list[int], asked: list[list[float]], k: int) -> Iterator[pa.RecordBatch]:
    names, lengths = np.array(names, dtype=np.int64), np.array([len(q) for q in asked])
    for batch in batches:
        vectors = batch["v"].to_pylist()
        own = np.array([len(v) for v in vectors])
        for d in np.unique(lengths):
            at, of = np.flatnonzero(own == d), np.flatnonzero(lengths == d)
            if not d or not len(at):
                continue
            ids = batch["id"].to_numpy()[at]
            m, q = (np.array([[np.nan if x is None else x for x in v] for v in rows], dtype=float) for rows in ([vectors[i] for i in at], [asked[i] for i in of]))
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = (m / np.sqrt((m * m).sum(axis=1, keepdims=True))) @ (q / np.sqrt((q * q).sum(axis=1, keepdims=True))).T
            rounded = np.where(np.isfinite(scores), np.round(scores, 12), -np.inf)
            for j in range(len(of)):
                best = np.lexsort((ids, -rounded[:, j]))[:k] if len(at) <= k else _best(rounded[:, j], ids, k)
                best = best[np.isfinite(rounded[best, j])]
                if len(best):
                    yield pa.record_batch({"query": np.full(len(best), names[of[j]]), "id": ids[best], "similarity": scores[best, j]})


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    near = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def fuse(a: DataFrame, b: DataFrame, keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (``rank``): score, then best single rank, then the first ranking's."""
    far = F.lit(2**31)
    both = a.select(*keys, F.col("rank").alias("ra")).join(b.select(*keys, F.col("rank").alias("rb")), keys, "full")
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    scored = both.withColumn("score", part("ra") + part("rb"))
    order = [F.desc("score"), F.least(F.coalesce("ra", far), F.coalesce("rb", far)), F.coalesce("ra", far), F.coalesce("rb", far)]
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(*order, keys[-1])))


def evidence_gate(top: DataFrame, query: str, coverage: str, similarity: str, least_coverage: float = 0.25, least_similarity: float = 0.5) -> DataFrame:
    """Whether the best rows of a query are evidence enough: ``answerable``."""
    best = top.groupBy(query).agg(F.max(coverage).alias("__c"), F.max(similarity).alias("__s"))
    return best.select(query, ((F.coalesce("__c", F.lit(0.0)) >= least_coverage) | (F.coalesce("__s", F.lit(0.0)) >= least_similarity)).alias("answerable"))


def trigrams(text: Column) -> Column:
    """Distinct letter triples of padded words, as PostgreSQL's trigram search has them."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+", -1), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
