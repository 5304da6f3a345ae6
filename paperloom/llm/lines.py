"""Line dedup: lines found in many documents are dropped everywhere (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, free_names, materialize, with_columns


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column) -> Column:
    """A document's line keys: stripped of ASCII white space, A-Z lower-cased."""
    return F.transform(_lines(ascii_lower(F.coalesce(text, F.lit("")))), lambda x: F.btrim(x, F.lit(ASCII_SPACE)))


def _hashes(key: Column) -> list[Column]:
    """128 bits: two 64-bit hashes of different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Hashes ``h1, h2`` of the keys that at least ``min_docs`` documents hold.

    A key counts once a document, so the count is one partial and one final sum: a line in
    a third of all documents is summed up before the shuffle.
    """
    keys = F.array_distinct(F.filter(_keys(F.col(text)), lambda k: F.length(k) >= min_chars))
    return (
        docs.select(F.explode(keys).alias("key"))
        .select(*_hashes(F.col("key")))
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drops from every document the lines whose key at least ``min_docs`` documents hold.

    Lines are exploded, normalised and hashed; hashes of at least ``min_docs`` documents are
    found by a partial sum; the positions of hit lines go back to their document, which is
    cut there and reassembled in order.  Only hashes and positions are exploded and
    shuffled; a text moves once, whole, to meet its positions.  The table of frequent hashes
    is written first, so that Catalyst broadcasts it only if its measured size allows and
    otherwise joins it by hash, with skewed partitions split by AQE.

    Every row is a document, repeated rows too.  Null and empty texts are one empty line.
    Keys shorter than ``min_chars`` code points stay.  Returns the columns of ``docs`` with
    the new text, then ``n_lines`` (before) and ``n_dropped``; columns of these names in
    ``docs`` give way, all others stay, whatever their names.  A null text stays null, rows
    with a null id are cut like others.  An empty table gives an empty table.
    """
    ID, DIGEST, DROP, LINES, HIT_ID, HIT_DIGEST = free_names(docs, "line_id", "line_digest", "line_drop", "lines", "hit_id", "hit_digest")
    frequent = materialize(frequent_lines(docs, text, min_docs, min_chars), "frequent-lines").select("h1", "h2")
    column, key = F.col(f"`{text}`"), F.col(f"`{id}`")
    hits = (
        docs.select(key.alias(ID), F.xxhash64(column).alias(DIGEST), F.posexplode(_keys(column)).alias("pos", "key"))
        .where(F.length("key") >= min_chars)
        .select(ID, DIGEST, "pos", *_hashes(F.col("key")))
        .join(frequent, ["h1", "h2"], "left_semi")
        .groupBy(ID, DIGEST).agg(F.sort_array(F.collect_set("pos")).alias(DROP))
    )
    hits = hits.select(F.col(ID).alias(HIT_ID), F.col(DIGEST).alias(HIT_DIGEST), DROP).hint("shuffle_hash")
    marked = docs.withColumns({ID: key, DIGEST: F.xxhash64(column)})
    cut = (
        marked.join(hits, F.col(ID).eqNullSafe(F.col(HIT_ID)) & (F.col(DIGEST) == F.col(HIT_DIGEST)), "left")
        .withColumns({LINES: _lines(column), DROP: F.coalesce(DROP, F.array().cast("array<int>"))})
    )
    kept = F.zip_with(
        F.concat(F.array(F.lit(-1)), DROP), F.concat(F.col(DROP), F.array(F.size(LINES))),
        lambda after, before: F.slice(F.col(LINES), after + 2, before - after - 1),
    )
    out = with_columns(cut, {
        text: F.when(column.isNotNull(), F.array_join(F.flatten(kept), "\n")),
        "n_lines": F.size(LINES).cast("long"), "n_dropped": F.size(DROP).cast("long"),
    })
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[f"`{c}`" for c in names], "n_lines", "n_dropped")
