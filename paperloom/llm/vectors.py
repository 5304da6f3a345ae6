"""Vector operators: exact top-k search by histogram selection, near-dedup by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_columns
from .graph import components, spanning_links

#: Cells of a score matrix held at a time, and cells of the histograms of a query block.
CELLS = 1 << 20


def _finite(embedding: str) -> Column:
    x = F.col(f"`{embedding}`").cast("array<double>")
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows of each vector length."""
    lengths = np.diff(batch["v"].offsets.to_numpy())
    for d in np.unique(lengths):
        part = batch.filter(pa.array(lengths == d))
        yield part["id"].to_numpy(), _matrix(part["v"])


# ---------------------------------------------------------------------- exact top-k search


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id: str = "vec_id", embedding: str = "embedding", query_bytes: int = 64 << 20, bins: int = 128) -> DataFrame:
    """The ``k`` highest inner products of each query with every other row; ties to the smaller id.

    Components become ``floor(scale * x)``, so scores are whole numbers; these vectors are
    written to the shared folder once and every scan reads them there.  The queries are taken
    in blocks of about ``query_bytes`` (at most twice that, but one query at least), the only
    rows that reach the driver, and are let go after their block.  For a block every partition scores all its vectors and returns, for each query, a histogram of its
    scores, from the top down to its own k-th; the sums of the histograms locate the bin of
    the global k-th score, the next round divides that bin and counts nothing beyond it, until
    it is one value wide.  A last pass returns the scores above that value and, of those equal to it, as many smallest
    ids as are still wanted.  Nothing but histograms and at most ``k`` rows a query and
    partition leaves a task, and a bin a query reaches the driver.

    Queries are the rows where ``is_query`` holds; repeated query rows are answered once.
    Rows with a null id, or whose vector is null or has a null or non-finite component, take no
    part, and vectors of another length than the query's are no candidates; an empty vector has
    the score 0 with other empty ones.  A row with the query's id is the query's own.  Fewer
    than ``k`` candidates: all.  Sums beyond 64 bits raise an error.  Returns ``query_id, rank,
    vec_id, score``; other columns are ignored, whatever their names.  An empty table, or no
    queries, give an empty table.
    """
    whole = F.transform(F.col(f"`{embedding}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    asked = F.col(f"`{id}`").isNotNull() & _finite(embedding)
    rows = materialize(vectors.where(asked).select(F.col(f"`{id}`").cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")), "whole-vectors")
    queries = rows.where("asked").select("id", "v").distinct()
    rows = rows.select("id", "v")
    most = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    n, longest = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    block_rows = max(1, query_bytes // (8 * ((longest or 0) + bins)))  # a query's components and histogram
    blocks = max(1, math.ceil(n / block_rows))
    found = []
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        chosen = part.toArrow().combine_chunks()
        for i in range(0, max(1, len(chosen)), 2 * block_rows):
            found.append(_top_of_block(rows, chosen[i : i + 2 * block_rows], k, bins, most))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _top_of_block(rows: DataFrame, chosen: pa.Table, k: int, bins: int, most: int) -> DataFrame:
    spark = rows.sparkSession
    ids = chosen["id"].to_numpy()
    queries, bound = {}, 0
    lengths = pc.list_value_length(chosen["v"]).to_numpy(zero_copy_only=False)
    low = np.zeros(len(ids), dtype=np.int64)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        matrix = pc.list_flatten(chosen["v"].take(pa.array(at))).to_numpy().reshape(len(at), d).astype(np.int64)
        queries[int(d)] = at, matrix
        sums = [sum(abs(x) for x in row) * most for row in matrix.tolist()]  # without overflow
        bound = max([bound, *sums])
        if bound >= 1 << 62:
            raise ArithmeticError("inner products leave the range of long")
        low[at] = [-x for x in sums]
    kind = np.float64 if bound < 1 << 53 else np.int64
    shared = spark.sparkContext.broadcast((ids, queries))
    width = 2 * bound + 1
    want = np.full(len(ids), k)
    done = np.zeros(len(ids), dtype=bool)  # fewer candidates than wanted: all are taken
    while len(ids) and not (width == 1 or done.all()):
        last, width = width, -(-width // bins)
        at = spark.sparkContext.broadcast((low, last, width, want))
        counts = rows.mapInArrow(lambda it, at=at: _histograms(it, shared.value, *at.value, bins, kind), "q int, bin int, n long, want long")
        summed = counts.groupBy("q", "bin").agg(F.sum("n").alias("n"), F.max("want").alias("want"))
        summed = summed.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))))
        reached = F.when((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")), F.struct("bin", (F.col("upto") - F.col("n")).alias("above")))
        seen = np.zeros(len(ids), dtype=bool)
        for q, place in summed.groupBy("q").agg(F.max(reached).alias("place")).collect():  # a row a query of the block
            seen[q] = True
            if place is None:
                done[q] = True
            else:
                low[q] += place.bin * width
                want[q] -= place.above
        at.destroy()
        done |= ~seen
    limit = spark.sparkContext.broadcast((np.where(done, np.iinfo(np.int64).min, low), np.where(done, 0, want)))
    kept = rows.mapInArrow(lambda it: _above(it, shared.value, *limit.value, kind), "q int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    top = materialize(kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-k")
    shared.destroy()
    limit.destroy()
    return top


def _scores(batches: Iterator[pa.RecordBatch], shared: tuple, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ids, query numbers, scores and which of them count, of a block of rows at a time."""
    ids, queries = shared
    for batch in batches:
        for own, matrix in _by_length(batch):
            if matrix.shape[1] not in queries:
                continue
            numbers, asked = queries[matrix.shape[1]]
            step = max(1, CELLS // len(numbers))
            for i in range(0, len(own), step):
                scores = (matrix[i : i + step].astype(kind) @ asked.astype(kind).T).astype(np.int64)
                yield own[i : i + step], numbers, scores, own[i : i + step, None] != ids[numbers][None, :]


def _histograms(batches: Iterator[pa.RecordBatch], shared: tuple, low: np.ndarray, last: int, width: int, want: np.ndarray, bins: int, kind: type) -> Iterator[pa.RecordBatch]:
    """Counts by bins of ``width`` of the scores from ``low`` on, within the bin of width ``last`` that they divide."""
    counts = np.zeros((len(low), bins), dtype=np.int64)
    for _, numbers, scores, counted in _scores(batches, shared, kind):
        beyond = scores - low[numbers]
        at = beyond // width
        counted &= (beyond >= 0) & (beyond < last)
        flat = (np.arange(len(numbers)) * bins + at)[counted]
        counts[numbers] += np.bincount(flat, minlength=len(numbers) * bins).reshape(-1, bins)
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    q, at = np.nonzero((counts > 0) & (above < want[:, None]))
    if len(q):
        yield pa.record_batch({"q": q.astype(np.int32), "bin": at.astype(np.int32), "n": counts[q, at], "want": want[q].astype(np.int64)})


def _above(batches: Iterator[pa.RecordBatch], shared: tuple, limit: np.ndarray, want: np.ndarray, kind: type) -> Iterator[pa.RecordBatch]:
    ids = shared[0]
    ties: dict[int, list[int]] = {}
    for own, numbers, scores, counted in _scores(batches, shared, kind):
        r, c = np.nonzero(counted & (scores > limit[numbers]))
        if len(r):
            yield _found(numbers[c], ids, own[r], scores[r, c])
        r, c = np.nonzero(counted & (scores == limit[numbers]) & (want[numbers] > 0))
        for q in np.unique(numbers[c]):
            ties[q] = sorted(ties.get(q, []) + own[r[numbers[c] == q]].tolist())[: want[q]]
    for q, equal in ties.items():
        yield _found(np.full(len(equal), q), ids, np.array(equal), np.full(len(equal), limit[q]))


def _found(q: np.ndarray, ids: np.ndarray, own: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"q": q.astype(np.int32), "query_id": ids[q], "vec_id": own.astype(np.int64), "score": scores.astype(np.int64)})


# --------------------------------------------------- near-dedup by an epsilon grid order join

#: Leading principal dimensions that make the grid and the boxes.
GRID = 8


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, id: str = "vec_id", embedding: str = "embedding", tile_bytes: int = 16 << 20, leaf: int = 256, fanout: int = 8, counts: dict | None = None
) -> DataFrame:
    """Links vectors of cosine ``>= threshold`` by an epsilon grid order join.

    Equal vectors are one class, so copies are never paired.  Unit vectors of cosine c lie
    ``sqrt(2 - 2c)`` apart: that is epsilon.  The classes are sorted by the cells, epsilon
    wide, of their coordinates on the leading principal dimensions (from second moments of
    all classes), the id last, so a crowded cell is cut as well.  The sequence is cut into
    leaves of ``leaf`` classes and intervals of many leaves, as many as ``tile_bytes`` hold
    in single precision (three intervals at least, so that a small table has several tasks).  Intervals are joined recursively: a tree of bounding boxes over the
    sequence is descended by pairs of nodes, down to pairs of leaves, and what is provably
    more than epsilon apart is skipped.  Only then do vectors move, and of a pair of
    intervals only the leaves with a near leaf in the other.  There a matrix product
    compares near leaves; scores near the threshold are computed again in double precision.
    A group returns, for each class with a link, its number of links and the smallest class
    it reaches there; pairs are never listed.

    ``counts``, a dict, is given the numbers of classes, of blocks (pairs of leaves), of
    blocks that were compared, and of vectors moved to pairs of intervals.  Where no leading
    dimension spreads wider than epsilon nothing can be skipped: then every vector meets
    every interval, in tiles.

    Every row is a vector; different vectors of one id have links of their own.  Vectors that are null, empty, zero or hold
    null or non-finite components, and rows with a null id, link with nothing; so do vectors
    of different length.  Returns ``vec_id, n_links, component_id, kept`` for every row:
    other rows linked directly, smallest id reachable, and whether that is its own.  Other
    columns are ignored, whatever their names.  An empty table gives an empty table.
    """
    double = F.col(f"`{embedding}`").cast("array<double>")
    linkable = F.col(f"`{id}`").isNotNull() & _finite(embedding) & F.exists(double, lambda v: v != 0)
    all_rows = vectors.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.when(linkable, F.col(f"`{embedding}`")).alias("v"))
    digest = [F.xxhash64("v").alias("d1"), F.xxhash64(F.lit("vector"), "v").alias("d2")]
    classes = materialize(
        all_rows.where("v IS NOT NULL").groupBy(*digest).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "vector-classes"
    )
    links, edges = _grid_join(classes, threshold, tile_bytes, leaf, fanout, counts)
    found = components(edges, "rep", "label")
    classes = (
        classes.select("d1", "d2", "rep", "n").join(links, ["d1", "d2"], "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select("d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    rows = all_rows.select("vec_id", *[F.when(F.col("v").isNotNull(), d).alias(n) for d, n in zip(digest, ("d1", "d2"), strict=True)])
    out = rows.join(classes, ["d1", "d2"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def _grid_join(classes: DataFrame, threshold: float, tile_bytes: int, leaf: int, fanout: int, counts: dict | None) -> tuple[DataFrame, DataFrame]:
    spark = classes.sparkSession
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    width = width or 1
    axes = spark.sparkContext.broadcast(_principal_axes(classes, width))
    intervals = max(3, math.ceil(n * (4 * width + 8 * GRID + 64) / tile_bytes))  # with what goes beside the components
    size = leaf * max(1, math.ceil(n / intervals / leaf))  # classes of an interval
    cells = [f"c{i}" for i in range(GRID)]
    point = f"d1 long, d2 long, rep long, n long, dim int, v binary, p array<double>, {', '.join(f'{c} int' for c in cells)}"
    points = classes.select("d1", "d2", "rep", "n", "v").mapInArrow(lambda it: _points(it, axes.value, epsilon, width), point)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = points.repartitionByRange(parts, "dim", *cells, "rep").sortWithinPartitions("dim", *cells, "rep").drop(*cells)
    order = materialize(order.mapInArrow(_numbered, "part int, nr long, d1 long, d2 long, rep long, n long, dim int, v binary, p array<double>"), "grid-order")

    # The place in the whole sequence: a partition's rows come after those of the ones before it.
    held = order.groupBy("part").agg(F.count("*").alias("held"))
    before = held.select(F.col("part").alias("of"), (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    place = F.col("before") + F.col("nr")
    placed = order.join(materialize(before, "grid-offsets"), F.col("part") == F.col("of")).select(
        F.floor(place / size).cast("int").alias("interval"), F.floor(place % size / leaf).cast("int").alias("leaf"), "d1", "d2", "rep", "n", "dim", "v", "p"
    )
    boxes = placed.groupBy("interval", "leaf").agg(*[f(F.col("p")[i]).alias(f"{s}{i}") for s, f in (("lo", F.min), ("hi", F.max)) for i in range(GRID)])
    boxes = materialize(boxes, "grid-boxes")
    needed = _near_leaves(boxes, math.ceil(n / size), epsilon, fanout)
    moved = placed.join(needed.where("leaf IS NOT NULL").select("interval", "leaf", "a", "b", "side"), ["interval", "leaf"])
    result = materialize(moved.groupBy("a", "b").applyInArrow(lambda group: _join_intervals(group, threshold, epsilon, width), "d1 long, d2 long, rep long, links long, label long, moved long"), "grid-links")
    if counts is not None:
        leaves = boxes.count()
        compared, moves = needed.agg(F.sum("near")).first()[0], result.agg(F.sum("moved")).first()[0]
        counts.update(classes=n, blocks=leaves * (leaves + 1) // 2, compared=compared or 0, moved=moves or 0)
    result = result.where("rep IS NOT NULL")
    return result.groupBy("d1", "d2").agg(F.sum("links").alias("links")), result.select("rep", "label")


def _principal_axes(classes: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal axes; sums of products are all that leaves a task."""
    sums = classes.select(F.col("rep").alias("id"), "v").mapInArrow(lambda it: _moments(it, width), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    total = np.zeros((width + 1, width + 1))
    total[sums.i, sums.j] = sums.s
    n = max(1.0, total[width, width])
    mean = total[width, :width] / n
    _, axes = np.linalg.eigh(total[:width, :width] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1][:, :GRID]


def _unit(matrix: np.ndarray, width: int) -> np.ndarray:
    """Unit rows, without overflow or underflow, padded to a common width."""
    m = matrix.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width + 1, width + 1))
    for batch in batches:
        for _, m in _by_length(batch):
            m = np.hstack([_unit(m, width), np.ones((len(m), 1))])
            total += m.T @ m
    i, j = np.indices(total.shape)
    yield pa.record_batch({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "s": total.ravel()})


def _points(batches: Iterator[pa.RecordBatch], axes: tuple, epsilon: float, width: int) -> Iterator[pa.RecordBatch]:
    mean, basis = axes
    for batch in batches:
        lengths = np.diff(batch["v"].offsets.to_numpy())
        for d in np.unique(lengths):
            part = batch.filter(pa.array(lengths == d))
            raw = _matrix(part["v"])
            p = (_unit(raw, width) - mean) @ basis
            p = np.pad(p, ((0, 0), (0, GRID - p.shape[1])))
            cell = np.floor(p / epsilon).astype(np.int32)
            yield pa.record_batch({
                "d1": part["d1"], "d2": part["d2"], "rep": part["rep"], "n": part["n"], "dim": np.full(len(part), d, dtype=np.int32), "v": pa.array([x.tobytes() for x in _exact(raw)], pa.binary()),
                "p": pa.ListArray.from_arrays(np.arange(0, p.size + 1, GRID, dtype=np.int32), p.ravel()), **{f"c{i}": cell[:, i] for i in range(GRID)},
            })


def _exact(raw: np.ndarray) -> np.ndarray:
    """In single precision where the column is, else in double: what is moved is what was read."""
    return raw if raw.dtype == np.float32 else raw.astype(np.float64)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        own = [pa.array(np.full(len(batch), number, dtype=np.int32)), pa.array(np.arange(at, at + len(batch), dtype=np.int64))]
        at += len(batch)
        yield pa.RecordBatch.from_arrays([*own, *batch.columns], ["part", "nr", *batch.schema.names])


def _near_leaves(boxes: DataFrame, intervals: int, epsilon: float, fanout: int) -> DataFrame:
    """``a, b, side, interval, leaf`` of the leaves that a pair of intervals has to compare.

    A row with a null leaf says of each pair how many blocks are near.
    The boxes of an interval's leaves are a row (16 numbers a leaf), so that a task meets
    those of two intervals at a time.
    """
    names = [f"{s}{i}" for s in ("lo", "hi") for i in range(GRID)]
    outer = boxes.groupBy("interval").agg(*[(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in names])
    pairs = _interval_pairs(materialize(outer, "interval-boxes"), intervals, epsilon, fanout)
    leaves = materialize(boxes.groupBy("interval").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("leaf", F.array(*names).alias("box")))), lambda x: x["box"])).alias("box")), "leaf-boxes")
    left, right = (leaves.select(F.col("interval").alias(i), F.col("box").alias(x)) for i, x in (("ia", "box_a"), ("ib", "box_b")))
    both = pairs.join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib")).select("a", "b", "box_a", "box_b")
    return materialize(both.mapInArrow(lambda it: _leaf_pairs(it, epsilon), "a int, b int, side int, interval int, leaf int, near long"), "near-leaves")


def _leaf_pairs(batches: Iterator[pa.RecordBatch], epsilon: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, box_a, box_b in zip(*(batch[c].to_pylist() for c in ("a", "b", "box_a", "box_b")), strict=True):
            boxes = [np.array(x).reshape(-1, 2, GRID) for x in ((box_a,) if a == b else (box_a, box_b))]
            i, j = _descend(boxes[0], boxes[-1], epsilon, a == b)
            asked = [(0, a, np.union1d(i, j))] if a == b else [(0, a, np.unique(i)), (1, b, np.unique(j))]
            for side, interval, leaf in asked:
                yield _needed(a, b, side, interval, pa.array(leaf, pa.int32()), 0)
            yield _needed(a, b, 0, a, pa.nulls(1, pa.int32()), len(i))


def _needed(a: int, b: int, side: int, interval: int, leaf: pa.Array, near: int) -> pa.RecordBatch:
    same = lambda value, kind: pa.array(np.full(len(leaf), value), kind)
    return pa.record_batch({
        "a": same(a, pa.int32()), "b": same(b, pa.int32()), "side": same(side, pa.int32()), "interval": same(interval, pa.int32()), "leaf": leaf,
        "near": same(near, pa.int64()),
    })


def _descend(a: np.ndarray, b: np.ndarray, epsilon: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of two sequences (``i <= j`` of the same one) whose boxes come within epsilon.

    Two binary trees of boxes over the sequences are descended by pairs of nodes, a level at a time.
    """
    trees = []
    for boxes in (a, b):
        levels = [boxes]
        while len(levels[-1]) > 1 or len(levels) < 1 + math.ceil(math.log2(max(len(a), len(b), 1))):
            at = np.arange(0, len(levels[-1]), 2)
            low, high = np.minimum.reduceat(levels[-1][:, 0], at), np.maximum.reduceat(levels[-1][:, 1], at)
            levels.append(np.stack([low, high], axis=1))
        trees.append(levels)
    i = j = np.zeros(1 if len(a) and len(b) else 0, dtype=np.int64)
    for level in range(len(trees[0]) - 1, -1, -1):
        x, y = (t[level] for t in trees)
        gap = np.maximum(0, np.maximum(y[j, 0] - x[i, 1], x[i, 0] - y[j, 1]))
        near = np.einsum("ij,ij->i", gap, gap) <= epsilon**2
        i, j = i[near], j[near]
        if level:
            i, j = (np.add.outer(2 * i, [0, 0, 1, 1]).ravel(), np.add.outer(2 * j, [0, 1, 0, 1]).ravel())
            inside = (i < len(trees[0][level - 1])) & (j < len(trees[1][level - 1])) & ((i <= j) | (not same))
            i, j = i[inside], j[inside]
    return i, j


def _interval_pairs(boxes: DataFrame, parts: int, epsilon: float, fanout: int) -> DataFrame:
    """Pairs ``a <= b`` of intervals whose boxes come within epsilon, by descending a tree over the sequence."""
    depth = max(1, math.ceil(math.log(max(2, parts), fanout)))
    lows, highs = [f"lo{i}" for i in range(GRID)], [f"hi{i}" for i in range(GRID)]
    pairs = boxes.sparkSession.range(1).select(F.lit(0).alias("a"), F.lit(0).alias("b"))
    for level in range(depth - 1, -1, -1):
        node = F.floor(F.col("interval") / fanout**level).cast("int").alias("node")
        nodes = boxes.groupBy(node).agg(*[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])
        nodes = nodes.withColumn("up", F.floor(F.col("node") / fanout).cast("int"))
        left = nodes.select(F.col("up").alias("ua"), F.col("node").alias("na"), *[F.col(c).alias(f"a_{c}") for c in lows + highs])
        right = nodes.select(F.col("up").alias("ub"), F.col("node").alias("nb"), *[F.col(c).alias(f"b_{c}") for c in lows + highs])
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.col(f"a_lo{i}") - F.col(f"b_hi{i}")), 2) for i in range(GRID)), F.lit(0.0))
        near = pairs.join(left, F.col("a") == F.col("ua")).join(right, F.col("b") == F.col("ub")).where((F.col("na") <= F.col("nb")) & (gap <= epsilon**2))
        pairs = near.select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return materialize(pairs, "grid-pairs")


#: Classes that one leaf is compared with at a time.
WIDE = 4096


def _join_intervals(group: pa.Table, threshold: float, epsilon: float, width: int) -> pa.Table:
    """Links between the near leaves of two intervals, or within one."""
    sides = [_side(group.filter(pc.equal(group["side"], side)), width) for side in (0, 1)]
    sides = [x for x in sides if len(x["rep"])]
    a, b = sides[0], sides[-1]
    same = group["a"][0].as_py() == group["b"][0].as_py()
    links = [np.zeros(len(x["rep"])) for x in sides]
    label = {int(r): int(r) for x in sides for r in x["rep"]}

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    i, j = _descend(a["box"], b["box"], epsilon, same) if same or len(sides) == 2 else ([], [])
    order = np.argsort(i, kind="stable")
    i, j = np.asarray(i)[order], np.asarray(j)[order]
    for leaf in np.unique(i):
        rows = np.arange(a["edge"][leaf], a["edge"][leaf + 1])
        met = np.concatenate([np.arange(b["edge"][k], b["edge"][k + 1]) for k in j[i == leaf]])
        for start in range(0, len(met), WIDE):
            cols = met[start : start + WIDE]
            scores = a["f"][rows] @ b["f"][cols].T
            hit = scores >= threshold
            r, c = np.nonzero(np.abs(scores - threshold) < 1e-4)
            if len(r):
                hit[r, c] = np.einsum("ij,ij->i", _units(a, rows[r], width), _units(b, cols[c], width)) >= threshold
            if len(a["dims"]) > 1 or len(b["dims"]) > 1:
                hit &= a["dim"][rows, None] == b["dim"][None, cols]
            if same:
                hit &= rows[:, None] < cols[None]
            if not hit.any():
                continue
            links[0][rows] += hit @ b["n"][cols]
            links[-1][cols] += a["n"][rows] @ hit
            r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            for x, y in spanning_links(hit[np.ix_(r, c)], a["rep"][rows[r]], b["rep"][cols[c]]):
                if (p := root(x)) != (q := root(y)):
                    label[max(p, q)] = min(p, q)
    out = [(None, None, None, 0, None, len(group))]
    for x, n in zip(sides, links, strict=True):
        out += [(d1, d2, rep, int(count), root(rep), 0) for d1, d2, rep, count in zip(*(c[n > 0].tolist() for c in (x["d1"], x["d2"], x["rep"], n)), strict=True)]
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["d1", "d2", "rep", "links", "label", "moved"])


def _side(rows: pa.Table, width: int) -> dict:
    """One interval's vectors in the order of the sequence, with the bounds and boxes of their leaves."""
    rows = rows.sort_by("leaf").combine_chunks()
    leaf, dim = rows["leaf"].to_numpy(), rows["dim"].to_numpy()
    edge = np.append(np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])), len(leaf)) if len(leaf) else np.zeros(1, dtype=np.int64)
    p = pc.list_flatten(rows["p"]).to_numpy().reshape(-1, GRID)
    box = np.stack([f.reduceat(p, edge[:-1]) for f in (np.minimum, np.maximum)], axis=1) if len(leaf) else np.zeros((0, 2, GRID))
    side = {**{c: rows[c].to_numpy() for c in ("d1", "d2", "rep")}, "n": rows["n"].to_numpy().astype(np.float64), "dim": dim, "dims": np.unique(dim), "raw": rows["v"], "edge": edge, "box": box}
    side["f"] = np.zeros((len(leaf), width), dtype=np.float32)
    for start in range(0, len(leaf), WIDE):
        at = np.arange(start, min(start + WIDE, len(leaf)))
        side["f"][at] = _units(side, at, width)
    return side


def _units(side: dict, at: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors of some rows, in double precision."""
    out = np.zeros((len(at), width))
    raw, dim = side["raw"].take(pa.array(at)).to_pylist(), side["dim"][at]
    for d in np.unique(dim):
        of = np.flatnonzero(dim == d)
        kind = np.float32 if len(raw[of[0]]) == 4 * d else np.float64
        out[of] = _unit(np.frombuffer(b"".join(raw[k] for k in of), kind).reshape(len(of), d), width)
    return out
