"""Tokenisation with the tokenizers library, and a binary store of token ids with Elias-Fano boundaries."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path

#: Words whose ids a worker remembers.
REMEMBERED = 600_000

#: The characters whose class is the same for every Unicode version, and the
#: pre-tokenisation of byte-level BPE over them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
PLAIN = re.compile(rf"[\t-\r -~{LETTERS}]*")
WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")

#: Byte-level BPE writes a byte as a character: printable ones of Latin-1 as themselves, the
#: others as the characters from 256 on, in order.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


class ByteBpe(dict):
    """Encodes texts to little-endian 32-bit ids with a tokenizers file of byte-level BPE.

    Merges never cross the words of the pre-tokenisation, so a text's ids are those of its
    words, and a worker asks the library once for each distinct word.  Texts with
    characters outside ``PLAIN``, and those that hold the string of an added token, which the
    library finds before it splits words, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        split = str(self.library.pre_tokenizer)
        self.merge = self.library.model.tokenize
        self.by_word = self.library.normalizer is None and "ByteLevel(add_prefix_space=False" in split and "use_regex=True" in split
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.holds_added = re.compile("|".join(added)).search if added else lambda text: None

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(BYTES))]).tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        if self.by_word and PLAIN.fullmatch(text) and not self.holds_added(text):
            return b"".join(map(self.__getitem__, WORDS.findall(text)))
        return self.whole(text)


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


# ------------------------------------------------------------------------------ Elias-Fano

#: A sample of select for every so many ones.
SAMPLE = 256
HEADER = struct.Struct("<4sIIQBQ")


def elias_fano(values: np.ndarray) -> bytes:
    """A non-decreasing sequence in about ``2 + log2(last / n)`` bits a value.

    The low bits of each value are stored as they are; the high parts as unary gaps, with
    the 32-bit place of every ``SAMPLE``-th one for select.
    """
    values = np.asarray(values, dtype=np.uint64)
    n, last = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (last // max(1, n)).bit_length() - 1)
    lows = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = int(ones[-1]) + 1 if n else 0
    if bits >= 1 << 32:
        raise ValueError("too many values for one sequence")
    highs = np.zeros(bits, dtype=np.uint8)
    highs[ones] = 1
    low_bytes, high_bytes = (np.packbits(x.ravel(), bitorder="little").tobytes() for x in (lows, highs))
    return HEADER.pack(b"EF02", SAMPLE, n, bits, low, len(low_bytes)) + low_bytes + high_bytes + ones[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """Reads what ``elias_fano`` wrote: single values by select, or a run of them."""

    def __init__(self, data: bytes):
        magic, self.sample, self.n, bits, self.low, n_low = HEADER.unpack_from(data)
        if magic != b"EF02":
            raise ValueError("not an Elias-Fano sequence")
        at = HEADER.size
        self.lows = np.frombuffer(data, np.uint8, n_low, at)
        self.highs = np.frombuffer(data, np.uint8, (bits + 7) // 8, at + n_low)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // self.sample), at + n_low + len(self.highs))

    def _lows(self, i: int, j: int) -> np.ndarray:
        if not self.low:
            return np.zeros(j - i, dtype=np.uint64)
        first, last = i * self.low, j * self.low
        bits = np.unpackbits(self.lows[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 :][: last - first]
        return bits.reshape(j - i, self.low).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))

    def run(self, i: int, j: int) -> np.ndarray:
        """Values i to j, without j: reads only the bits from the sample before i on."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, dtype=np.uint64)
        start = i // self.sample
        after = -(-j // self.sample)
        first = int(self.samples[start])
        end = int(self.samples[after]) + 1 if after < len(self.samples) else len(self.highs) * 8
        ones = first + np.flatnonzero(np.unpackbits(self.highs[first // 8 : (end + 7) // 8], bitorder="little")[first % 8 :])
        ones = ones[i - start * self.sample :][: j - i]
        return ((ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low)) | self._lows(i, j)

    def select(self, i: int) -> int:
        return int(self.run(i, i + 1)[0])

    def first_at_least(self, value: int) -> int:
        """How many values are smaller, by select."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.select(middle) < value:
                low = middle + 1
            else:
                high = middle
        return low


# ----------------------------------------------------------------------------- token store

STORE = "shard int, part int, n_docs long, n_ids long, first_id long, last_id long, width int, doc_ids binary, boundaries binary, ids binary"
#: Before the ids of a segment's documents: how many are null, and the smallest other one.
DOC_IDS = struct.Struct("<Iq")


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text", shards: int | None = None, segment_ids: int = 1 << 20) -> None:
    """Writes the ids of all documents, in ascending order of ``id``, as a binary store at ``path``.

    The rows are dealt to shards by ranges of ``id`` and sorted there, so that texts move
    once and ids never.  A shard is a run of segments of about ``segment_ids`` ids each (one
    long document may exceed that), so a task holds one segment at a time.  A segment is
    one row of the store: its concatenated ids as little-endian unsigned integers of
    ``width`` bytes (2 where they fit, else 4), and, both in Elias-Fano form, whose select
    answers in near-minimal space, the boundaries of its documents and their ids.  Spark's
    committer writes the files, so a lost executor leaves no half-written segment.

    Each document's ids end with ``end_id``.  Null texts are empty.  Null ids come first;
    rows of one id, null or not, are ordered by a hash of their text (null texts first), and
    however many there are, they are dealt to several shards.  Other columns are ignored, whatever their names.
    An empty table makes an empty store.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("id").asc_nulls_first(), F.col("digest").asc_nulls_first(), F.col("split")]
    ordered = rows.withColumns({"digest": F.when(F.col("text").isNotNull(), F.xxhash64("text")), "split": F.spark_partition_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.select("id", "text").mapInArrow(lambda it: _segments(it, tokenizer, end_id, segment_ids), STORE).write.parquet(path)


def _segments(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, segment_ids: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(tokenizer), array("I", [end_id]).tobytes()
    shard, part, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids.append((encode(text) if text else b"") + end)
            doc_ids.append(doc_id)
            size += len(ids[-1]) // 4
            if size >= segment_ids:
                yield _segment(shard, part, doc_ids, ids)
                part, doc_ids, ids, size = part + 1, [], [], 0
    if doc_ids:
        yield _segment(shard, part, doc_ids, ids)


def _segment(shard: int, part: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
    bounds = np.cumsum([0, *[len(x) // 4 for x in ids]])
    known = [x for x in doc_ids if x is not None]  # null ones come first
    least = known[0] if known else 0
    head = DOC_IDS.pack(len(doc_ids) - len(known), least) + elias_fano(np.array([x - least for x in known], dtype=np.uint64))
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if flat.max() < 1 << 16 else 4
    row = {
        "shard": shard, "part": part, "n_docs": len(ids), "n_ids": int(bounds[-1]), "first_id": known[0] if known else None, "last_id": known[-1] if known else None,
        "width": width, "doc_ids": head, "boundaries": elias_fano(bounds), "ids": flat.astype(f"<u{width}").tobytes(),
    }
    kinds = {"shard": pa.int32(), "part": pa.int32(), "width": pa.int32(), "doc_ids": pa.binary(), "boundaries": pa.binary(), "ids": pa.binary()}
    return pa.record_batch({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()})


def _doc_ids(head: bytes) -> tuple[int, int, EliasFano]:
    """How many documents without an id come first, and the others' ids: the smallest, and how far each is above it."""
    nulls, least = DOC_IDS.unpack_from(head)
    return nulls, least, EliasFano(head[DOC_IDS.size :])


def lookup(store: DataFrame, asked: list[int]) -> DataFrame:
    """``doc_id, ids`` (little-endian, 32 bits each) of the documents of some ids, repeated ones all.

    Only segments that may hold one are read; there select finds the document and its two
    boundaries, without unpacking either sequence.  Ids that no document has give no row.
    """
    asked = sorted(set(asked))
    near = F.exists(F.lit(asked).cast("array<long>"), lambda x: (F.col("first_id") <= x) & (F.col("last_id") >= x))
    return store.where(near).select("width", "doc_ids", "boundaries", "ids").mapInArrow(lambda it: _looked_up(it, asked), "doc_id long, ids binary")


def _looked_up(batches: Iterator[pa.RecordBatch], asked: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            nulls, least, doc_ids = _doc_ids(row["doc_ids"])
            bounds, flat, found = EliasFano(row["boundaries"]), np.frombuffer(row["ids"], f"<u{row['width']}"), []
            for x in asked:
                at = doc_ids.first_at_least(x - least) if x >= least else doc_ids.n
                while at < doc_ids.n and doc_ids.select(at) == x - least:
                    first, last = bounds.select(nulls + at), bounds.select(nulls + at + 1)
                    found.append((x, flat[first:last].astype("<u4").tobytes()))
                    at += 1
            if found:
                yield pa.record_batch({"doc_id": pa.array([x for x, _ in found], pa.int64()), "ids": pa.array([ids for _, ids in found], pa.binary())})


def read_token_store(store: DataFrame) -> DataFrame:
    """Documents of a store: ``doc_id, start, n_tokens, ids_crc32``, in as many tasks as files.

    ``start`` counts the ids of all documents before it: totals by shard, then by segment,
    then the boundary that select returns.  Only the counts of segments are summed over; they
    are written first, so that Catalyst broadcasts them if small and the ids stay in place.
    """
    counts = store.select("shard", "part", "n_ids")
    by_shard = counts.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.withColumn("within", within).join(by_shard.withColumn("before", before), "shard").select("shard", "part", (F.col("before") + F.col("within")).alias("base"))
    segments = store.select("shard", "part", "width", "doc_ids", "boundaries", "ids")
    read = segments.join(materialize(bases, "segment-bases"), ["shard", "part"]).select("base", "width", "doc_ids", "boundaries", "ids")
    return read.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            nulls, least, known = _doc_ids(row["doc_ids"])
            doc_ids = np.concatenate([np.zeros(nulls, dtype=np.int64), (known.run(0, known.n) + np.uint64(least % (1 << 64))).astype(np.int64)])
            bounds = EliasFano(row["boundaries"]).run(0, len(doc_ids) + 1).astype(np.int64)
            ids = memoryview(np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4").tobytes())
            crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.record_batch({
                "doc_id": pa.array(doc_ids, mask=np.arange(len(doc_ids)) < nulls), "start": row["base"] + bounds[:-1],
                "n_tokens": np.diff(bounds), "ids_crc32": np.array(crc, dtype=np.int64),
            })


def token_offsets(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Writes a store to the shared folder and reads it back."""
    path = scratch_path(docs.sparkSession, "token-store")
    write_token_store(docs, path, tokenizer, end_id, **options)
    return read_token_store(docs.sparkSession.read.parquet(path))
