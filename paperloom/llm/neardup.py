"""MinHash near-dedup by an LSH forest: sorted signature orders, longest-common-prefix neighbours, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize
from .graph import components, extended, spanning_links

#: Trees of the forest, hashes of each sorted order, and the shared prefix that makes a region.
TREES, DEPTH, LEAST = 16, 8, 4
#: Neighbours on each side that are candidates; regions no larger are covered by them.
NEAR = 3
#: Prefixes by which wide regions are made whole, the narrow ones first; the last is ``LEAST``.
DESCENT = (6, LEAST)
#: Sets of a region compared at a time, and their bytes; columns of their incidence matrix held at a time.
CHUNK, CHUNK_BYTES, COLUMNS = 256, 4 << 20, 2048

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``words`` words.

    Words are runs of other than ASCII white space, A-Z lower-cased.  Fewer words make one
    shingle of all; no words make none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    k = min(words, len(hashes))
    n = len(hashes) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(total)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> bytes:
    """Big-endian 32-bit minima, one a multiplier, so that bytes sort as hashes do."""
    low = np.full(len(multipliers), _MASK)
    for i in range(0, len(shingles), 512):
        low = np.minimum(low, (shingles[i : i + 512, None] * multipliers).min(axis=0))
    return (_mixed(low) >> np.uint64(32)).astype(">u4").tobytes()


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    multipliers = _multipliers(TREES * DEPTH)
    for batch in batches:
        size, digest, sign = [], [], []
        for text in batch["text"].to_pylist():
            s = shingle_set(text, words)
            size.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sign.append(signature(s, multipliers) if len(s) else None)
        yield pa.record_batch({"id": batch["id"], "n": pa.array(size, pa.int64()), "digest": pa.array(digest, pa.binary()), "sig": pa.array(sign, pa.binary())})


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Groups documents whose shingle sets have ``100 * intersection >= percent * union``.

    Equal sets are one class, however many documents hold them; only the smallest id of a
    class goes on.  Each class has ``TREES`` keys of ``DEPTH`` MinHash values; the forest is
    the classes sorted by each key (a range shuffle with the id as the last sort key, so no
    common prefix makes a task large).  Neighbours in an order that share a prefix of at
    least ``LEAST`` values are candidates: in a dense region neighbours share the longest
    prefixes, so the depth follows the region.  Candidates are confirmed on full sets, first
    those next to each other in a few orders; what these links already join needs no more
    confirmation, which leaves little of a large group.

    Then regions wider than the neighbours' reach are made whole, where they still hold several
    components: first those of long prefixes, where most of a dense group meets, then, with
    the components joined so far, those of ``LEAST`` values.  Members of a region that belong
    to one large component, the others, and sizes too far apart to be alike, are dealt to
    chunks of their own (``chunk`` sets or 4 MB at most, but for a longer text); chunks of the same
    component and of unlike sizes never meet.  Two chunks that meet do so inside a task, on
    full sets, and only a spanning forest of the links found there leaves it.  So every pair
    that shares a prefix of ``LEAST`` values in some order is linked or refused by its full
    sets, or already connected.  A pair at 85 % shares no such prefix with a chance of 7 in a
    million, at 80 % of 2 in 10,000; that is the only loss.

    Null ids and texts without words link with nothing.  Rows of one id are one document:
    with different texts, ``n_shingles`` is of the row, and what one of them links with, all do.
    Returns a row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``;
    other columns are ignored, whatever their names.  An empty table gives an empty table.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    signed = materialize(rows.mapInArrow(lambda it: _signed(it, words), "id long, n long, digest binary, sig binary"), "signatures")
    named = signed.where("digest IS NOT NULL AND id IS NOT NULL")
    classes = materialize(named.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    forest = materialize(_forest(classes, percent), "forest")
    pairs = materialize(forest.where("b IS NOT NULL").groupBy("a", "b").agg(F.max("first").alias("first")), "candidates")

    # Several texts of one id: their classes are linked by the id.
    several = named.groupBy("id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).where("d1 <> d2").select(F.col("id").alias("of"))
    own = materialize(named.join(several, F.col("id") == F.col("of"), "left_semi").select("id", F.col("digest").alias("d")), "own-texts")
    own = own.join(classes.select("digest", "rep"), F.col("d") == F.col("digest")).select(F.col("id").alias("a"), F.col("rep").alias("b"))

    confirm = _Confirm(rows, percent, words)
    group = materialize(components(confirm(pairs.where("first")).unionByName(own), "a", "b"), "components")
    group = extended(group, confirm(_across(pairs.where("NOT first").select("a", "b"), group)), "a", "b")
    for depth in DESCENT:
        links = _wide_regions(forest, rows, group, percent, words, chunk, depth)
        if links is not None:
            group = extended(group, links, "a", "b")

    of_class = classes.join(group, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("c"))
    out = signed.drop("sig").join(of_class, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _forest(classes: DataFrame, percent: int) -> DataFrame:
    """Neighbour pairs ``a, b`` of the sorted orders, and the members of the regions (b null)."""
    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = classes.select("rep", "n", F.posexplode(F.array(*[F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH) for t in range(TREES)])).alias("tree", "key"))
    order = keys.select("tree", "key", "rep", "n").repartitionByRange(parts, "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    return order.mapInArrow(lambda it: _neighbours(it, percent), "tree int, prefix binary, a long, n long, b long, first boolean, edge boolean")


def _neighbours(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Compares each row of a sorted partition with the ``NEAR`` rows before it."""
    held: tuple | None = None  # the last rows of what came before
    pending: pa.RecordBatch | None = None

    def rows(batch: pa.RecordBatch) -> tuple:
        key = np.frombuffer(b"".join(batch["key"].to_pylist()), ">u4").reshape(len(batch), DEPTH)
        return batch["tree"].to_numpy(), key, batch["rep"].to_numpy(), batch["n"].to_numpy()

    def members(tree: np.ndarray, key: np.ndarray, rep: np.ndarray, n: np.ndarray, shared: np.ndarray, at_edge: np.ndarray) -> pa.RecordBatch:
        """shared: whether a row shares its prefix with the next."""
        inside = at_edge.copy()
        inside[:-1] |= shared
        inside[1:] |= shared
        at = np.flatnonzero(inside)
        return pa.record_batch({
            "tree": pa.array(tree[at], pa.int32()), "prefix": pa.array([key[i, : DESCENT[0]].tobytes() for i in at], pa.binary()), "a": pa.array(rep[at], pa.int64()), "n": pa.array(n[at], pa.int64()),
            "b": pa.nulls(len(at), pa.int64()), "first": pa.array(np.zeros(len(at), bool)), "edge": pa.array(at_edge[at]),
        })

    start = True
    while True:
        batch = next(batches, None)
        if pending is not None:
            now = rows(pending)
            joined = now if held is None else tuple(np.concatenate([h, x]) for h, x in zip(held, now, strict=True))
            tree, key, rep, n = joined
            old = 0 if held is None else len(held[0])
            shared = (tree[1:] == tree[:-1]) & (key[1:, :LEAST] == key[:-1, :LEAST]).all(axis=1)
            for gap in range(1, NEAR + 1):
                if len(rep) <= gap:
                    break
                close = shared[: len(rep) - gap].copy()
                for step in range(1, gap):
                    close &= shared[step : len(rep) - gap + step]
                close &= 100 * np.minimum(n[gap:], n[:-gap]) >= percent * np.maximum(n[gap:], n[:-gap])
                close[: max(0, old - gap)] = False  # done with the batch before
                i = np.flatnonzero(close & (rep[gap:] != rep[:-gap]))
                if len(i):
                    yield pa.record_batch({
                        "tree": pa.array(tree[i], pa.int32()), "prefix": pa.nulls(len(i), pa.binary()), "a": pa.array(np.minimum(rep[i], rep[i + gap])), "n": pa.nulls(len(i), pa.int64()),
                        "b": pa.array(np.maximum(rep[i], rep[i + gap])), "first": pa.array((tree[i] < 3) & (gap == 1)), "edge": pa.array(np.zeros(len(i), bool)),
                    })
            # Regions at either end of the partition may go on in another.
            at_edge = np.zeros(len(rep), bool)
            same = lambda i: (tree == tree[i]) & (key[:, :LEAST] == key[i, :LEAST]).all(axis=1)
            if start:
                at_edge |= same(0)
            if batch is None:
                at_edge |= same(-1)
            found = members(tree, key, rep, n, shared, at_edge)
            # Rows held over come again with the next batch; members are made distinct later.
            if len(found):
                yield found
            start = start and bool(at_edge.all())
            held = tuple(x[-NEAR:] for x in joined)
        if batch is None:
            return
        pending = batch if len(batch) else None


class _Confirm:
    """Holds candidate pairs against their full shingle sets."""

    def __init__(self, rows: DataFrame, percent: int, words: int):
        self.rows, self.percent, self.words = rows, percent, words

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that are links; each document's set is made once."""
        percent, words = self.percent, self.words
        pairs = materialize(pairs.select("a", "b"), "open-pairs")
        if pairs.isEmpty():
            return pairs
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
        sets = _sets_of(self.rows, wanted, words)
        left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(y)) for x, y in (("ia", "sa"), ("ib", "sb")))
        both = pairs.join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib")).select("a", "b", "sa", "sb")
        return materialize(both.mapInArrow(lambda it: _linked(it, percent), "a long, b long").distinct(), "near-links")


def _sets_of(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``id, shingles`` of the wanted ids; each text is shingled once."""
    asked = rows.join(materialize(wanted, "wanted"), F.col("id") == F.col("w"), "left_semi")
    return materialize(asked.mapInArrow(lambda it: _sets(it, words), "id long, shingles binary"), "shingle-sets")


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"id": batch["id"], "shingles": pa.array([shingle_set(t, words).tobytes() for t in batch["text"].to_pylist()], pa.binary())})


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["sa"], batch["sb"], strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _across(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    a, b = (group.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("na", "ca"), ("nb", "cb")))
    joined = pairs.join(a, F.col("a") == F.col("na"), "left").join(b, F.col("b") == F.col("nb"), "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _wide_regions(forest: DataFrame, rows: DataFrame, group: DataFrame, percent: int, words: int, chunk: int, depth: int) -> DataFrame | None:
    """Links between different components in regions of ``depth`` values that neighbours do not cover; None if there are no such regions."""
    region, block, cell = ["tree", "prefix"], ["tree", "prefix", "size", "alone", "of"], ["tree", "prefix", "i", "j"]
    found = forest.where("b IS NULL").select("tree", F.substring("prefix", 1, 4 * depth).alias("prefix"), F.col("a").alias("rep"), "n", "edge")
    members = found.groupBy(*region, "rep").agg(F.max("n").alias("n"), F.max("edge").alias("edge")).join(group, F.col("rep") == F.col("node"), "left")
    # Of two sizes as far apart as the threshold allows, the logarithms to this base differ by one at most.
    base = float(np.log(100 / percent)) * (1 + 1e-9) if percent < 100 else 1e-9
    members = materialize(members.select(*region, "rep", "n", "edge", F.coalesce("component", "rep").alias("c"), F.floor(F.log("n") / base).cast("long").alias("size")), "regions")
    wide = members.groupBy(*region).agg(F.count("*").alias("held"), F.max("edge").alias("at_edge"), F.min("c").alias("low"), F.max("c").alias("high"))
    wide = materialize(wide.where(f"low <> high AND (held > {NEAR + 1} OR at_edge)").select(*region), "wide-regions")
    inside = materialize(members.join(wide, region, "left_semi").drop("edge"), "wide-members")
    if inside.isEmpty():
        return None

    # A component with much of a region has blocks of its own there; the others are mixed.
    own = inside.groupBy(*region, "size", "c").agg(F.count("*").alias("held")).where(F.col("held") * 2 >= chunk).drop("held").withColumn("alone", F.lit(True))
    alone = F.coalesce("alone", F.lit(False))
    blocked = inside.join(materialize(own, "own-blocks"), [*region, "size", "c"], "left").select(*region, "size", "rep", "n", "c", alone.alias("alone"), F.when(alone, F.col("c")).otherwise(0).alias("of"))
    blocks = blocked.groupBy(*block).agg(F.ceil(F.greatest(F.count("*") / chunk, F.sum("n") * 8 / CHUNK_BYTES)).alias("chunks"))
    blocks = materialize(blocks, "blocks")
    name = lambda k: F.xxhash64("size", "alone", "of", k).alias("name")
    placed = blocked.join(blocks, block).select(*region, name(F.pmod(F.xxhash64("rep"), "chunks")), "rep", "c")
    chunks = blocks.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(*block, name(F.col("k")))
    one, other = (chunks.select(*region, *[F.col(c).alias(f"{c}_{x}") for c in ("size", "alone", "of", "name")]) for x in ("i", "j"))
    alike = F.col("alone_i") & F.col("alone_j") & (F.col("of_i") == F.col("of_j"))
    near = one.join(other, region).where((F.col("name_i") <= F.col("name_j")) & (F.abs(F.col("size_i") - F.col("size_j")) <= 1) & ~alike)
    cells = near.select(*region, F.col("name_i").alias("i"), F.col("name_j").alias("j"))
    dealt = cells.withColumn("name", F.explode(F.array_distinct(F.array("i", "j"))))
    asked = materialize(placed.join(dealt, [*region, "name"]), "wide-cells")
    sets = _sets_of(rows, asked.select(F.col("rep").alias("w")).distinct(), words)
    held = asked.join(sets, F.col("rep") == F.col("id")).select(*cell, F.col("name").alias("own"), "rep", "c", "shingles")
    return materialize(held.groupBy(*cell).applyInPandas(lambda pdf: _compare_sets(pdf, percent), "a long, b long").distinct(), "wide-links")


def _compare_sets(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Exact similarities of all sets of one chunk with those of another, as a product of incidence matrices."""
    sides = [pdf[pdf["own"] == x] for x in pdf["own"].unique()]
    sets = [[np.frombuffer(v, np.uint64) for v in x["shingles"]] for x in sides]
    sizes = [np.array([len(v) for v in x], dtype=np.int64) for x in sets]
    _, where, counts = np.unique(np.concatenate([v for x in sets for v in x]), return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[where]  # a shingle of one set is in no intersection
    parts, at = [], 0
    for size in sizes:
        end = at + int(size.sum())
        parts.append((np.repeat(np.arange(len(size)), size), column[at:end]))
        at = end
    common = np.zeros((len(sizes[0]), len(sizes[-1])), dtype=np.float32)
    width = int(column.max()) + 1
    for start in range(0, width, COLUMNS):
        blocks = []
        for (row, col), size in zip(parts, sizes, strict=True):
            inside = (col >= start) & (col < start + COLUMNS)
            block = np.zeros((len(size), min(COLUMNS, width - start)), dtype=np.float32)
            block[row[inside], col[inside] - start] = 1
            blocks.append(block)
        common += blocks[0] @ blocks[-1].T
    whole = common.astype(np.int64)
    rep, c = ([x[k].to_numpy() for x in sides] for k in ("rep", "c"))
    hit = (whole > 0) & (100 * whole >= percent * (sizes[0][:, None] + sizes[-1][None] - whole)) & (c[0][:, None] != c[-1][None])
    return pd.DataFrame(spanning_links(hit, rep[0], rep[-1]), columns=["a", "b"])
