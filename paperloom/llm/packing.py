"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bins:
    """Bins of one capacity; a tournament tree over their free space finds the first that fits."""

    def __init__(self, capacity: int, most: int):
        self.size = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)
        self.capacity = capacity

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room, and the offset there."""
        node, tree = 1, self.tree
        while node < self.size:
            node *= 2
            if tree[node] < length:
                node += 1
        offset = self.capacity - tree[node]
        bin = node - self.size
        tree[node] -= length
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left > right else right
            if tree[node] == most:
                break
            tree[node] = most
        return bin, offset


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each length; equal lengths in their given order."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, placed = Bins(capacity, max(1, len(lengths))), [(0, 0)] * len(lengths)
    for i in order:
        placed[i] = bins.place(lengths[i])
    return placed


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, group_docs: int = 4096, id: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    A document's ids, with ``end_id`` at their end, are cut into full pieces and a rest.
    Each row has a number, and lengths, checksums and numbers are written to the shared
    folder once, so that a task that runs again meets the same rows.  They are dealt at
    random (by a hash of the number, not of content, so that no key makes a group large) to
    groups of about ``group_docs`` documents.  Each group packs on its own by first-fit
    decreasing, over rests only, as full pieces fill a sequence.  Texts and ids stay in the
    scan's tasks.

    ``sequence_lengths`` says how far each sequence is padded.  Null and empty texts are
    just ``end_id``; a text however long is cut, never shortened.  Every row is a document,
    repeated rows and null ids too, ties in length in the order of the scan.  Other columns
    are ignored, whatever their names.  Returns a row a piece: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset``.  An empty table gives no pieces.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    cut = materialize(rows.mapInArrow(lambda it: _cut(it, tokenizer, end_id, capacity), "nr long, doc_id long, doc_tokens long, crcs binary"), "pieces")
    groups = max(1, -(-cut.count() // group_docs))  # of the files' footers
    return cut.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "nr"), F.lit(groups)).cast("int")).groupBy("grp").applyInPandas(lambda pdf: _pack_group(pdf, capacity), PIECE)


def sequence_lengths(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``sequence_id, tokens, padded``: sequences are padded to ``capacity``, except those whose tokens are a power of two."""
    tokens = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    return tokens.withColumn("padded", F.when(F.bit_count("tokens") == 1, F.col("tokens")).otherwise(F.lit(capacity).cast("long")))


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encode, end, nr = encoder(tokenizer), array("I", [end_id]).tobytes(), TaskContext.get().partitionId() << 40
    for batch in batches:
        tokens, crcs = [], []
        for text in batch["text"].to_pylist():
            ids = memoryview((encode(text) if text else b"") + end)
            tokens.append(len(ids) // 4)
            crcs.append(array("I", [zlib.crc32(ids[i : i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)]).tobytes())
        yield pa.record_batch({
            "nr": pa.array(np.arange(nr, nr + len(batch), dtype=np.int64)), "doc_id": batch["doc_id"], "doc_tokens": pa.array(tokens, pa.int64()), "crcs": pa.array(crcs, pa.binary()),
        })
        nr += len(batch)


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values("nr")
    tokens = pdf["doc_tokens"].to_numpy()
    pieces = -(-tokens // capacity)
    doc = np.repeat(np.arange(len(pdf)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
    length = np.minimum(capacity, tokens[doc] - start)
    full = length == capacity
    sequence, offset = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64)
    sequence[full] = np.arange(full.sum())
    placed = np.array(first_fit_decreasing(length[~full].tolist(), capacity), dtype=np.int64).reshape(-1, 2)
    sequence[~full], offset[~full] = placed[:, 0] + full.sum(), placed[:, 1]
    ids = pdf["doc_id"].convert_dtypes() if pdf["doc_id"].isna().any() else pdf["doc_id"]
    return pd.DataFrame({
        "doc_id": ids.iloc[doc].to_numpy(), "start": start, "length": length, "ids_crc32": np.frombuffer(b"".join(pdf["crcs"]), np.uint32).astype(np.int64),
        "doc_tokens": tokens[doc], "sequence_id": (np.int64(pdf["grp"].iloc[0]) << 40) + sequence, "offset": offset,
    })
