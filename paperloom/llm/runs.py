"""Periodic run detection: a harmonic grid of longest common extensions in each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_parts, own_columns, unpacked

#: Grid points and bytes of text looked at together, and words whose suffixes are sorted together (but for longer documents).
POINTS, TEXT, WORDS = 1 << 20, 1 << 22, 1 << 16
RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text: str = "text", shortest: int = 12) -> DataFrame:
    """Finds all runs of every whole text and drops their repetitions.

    Words are what stands between ASCII white space.  A run is a stretch of words with
    smallest period q and a length of at least ``shortest`` and 2 q that no neighbouring word
    extends keeping period q.  For each period p the grid points jp and (j + 1)p of a document
    are compared: every run of period p holds two such points, and what they share forward
    and backward is the run.  The shared lengths are range minima over the shared lengths of
    neighbours in the suffix array of the text and of its reverse.  Points whose close
    surroundings differ cannot reach the least length and ask nothing; a document without
    other points is not sorted.  A stretch found with several periods has the least one.

    All is done in the scan's tasks, for some documents at a time; nothing is shuffled.  A
    document takes n log n grid points and about 200 bytes a word, however many runs it has.

    Every row is judged by itself, repeated ones alike.  Null and empty texts have no words
    and no runs.  Returns the columns of ``docs``, then ``runs array<struct<start, length,
    period>>`` (word numbers from 0, by start, then period) and ``collapsed string``: the
    words but those that any run holds after its first q, joined by one space; columns of
    these names in ``docs`` give way, all others stay, whatever their names.  An empty table
    gives an empty table.
    """
    new = ("runs", "collapsed")
    rows = docs.select(own_columns(docs, *new).alias("own"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = rows.select("own").schema.add("runs", T.ArrayType(RUN)).add("collapsed", "string")
    return unpacked(rows.mapInArrow(lambda it: _judged(it, shortest), schema), "own", *new)


def _judged(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in in_parts(batch, "text", TEXT):
            yield _judged_together(part, shortest)


def _judged_together(batch: pa.RecordBatch, shortest: int) -> pa.RecordBatch:
    words = [t.encode().split() for t in batch["text"].to_pylist()]  # of bytes: by ASCII white space
    collapsed, runs = [], []
    for own, (start, length, period) in zip(words, runs_of(words, shortest), strict=True):
        if len(start):
            edge = np.zeros(len(own) + 1, dtype=np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            own = [own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        collapsed.append(b" ".join(own).decode())
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)])
    return pa.record_batch({"own": batch["own"], "runs": pa.array(runs, ARROW_RUNS), "collapsed": pa.array(collapsed, pa.string())})


def runs_of(words: list[list], shortest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``start, length, period`` of the runs of each word list, by start, then period."""
    number: dict = {}
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ids = np.array([number.setdefault(x, len(number)) for w in words for x in w], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    none = np.zeros(0, dtype=np.int64)
    out = [(none, none, none)] * len(words)
    doc, x, p = _points(ids, first, sizes, shortest)
    if not len(doc):
        return out
    order = np.argsort(doc, kind="stable")
    doc, x, p = doc[order], x[order], p[order]
    asked = np.unique(doc)
    part = np.cumsum(sizes[asked]) // WORDS  # documents sorted together
    for group in np.split(asked, np.flatnonzero(part[1:] != part[:-1]) + 1):
        a, b = np.searchsorted(doc, group[0], "left"), np.searchsorted(doc, group[-1], "right")
        for d, rows in _extended(ids, first, sizes, group, doc[a:b], x[a:b], p[a:b], shortest):
            out[d] = rows
    return out


def _points(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``document, x, p`` of the grid points x = jp whose surroundings agree with those of x + p.

    What two points of a run share, to both sides, is at least ``max(p, shortest - p)`` words
    long and holds the points; half of ``shortest`` of it is checked here.
    """
    near = max(1, -(-shortest // 2))
    docs = np.flatnonzero((sizes >= shortest) & (sizes >= 2))
    found = []
    pad = np.full(near, -1)
    padded = np.concatenate([pad, ids, pad - 1])
    owner = np.concatenate([pad, np.repeat(np.arange(len(sizes)), sizes), pad])
    halves = sizes[docs] // 2
    whole = np.repeat(docs, halves)  # a row a document and period
    period = np.arange(len(whole)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    points = (sizes[whole] - 1) // period
    upto = np.cumsum(points)
    begin = 0
    while begin < len(whole):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + POINTS, "right")))
        n, at = points[begin:end], np.repeat(np.arange(begin, end), points[begin:end])
        j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        p = period[at]
        x = first[whole[at]] + j * p
        hit = np.flatnonzero(ids[x] == ids[x + p])
        x, p, at = x[hit] + near, p[hit], at[hit]
        shared = np.ones(len(x), dtype=np.int64)
        for step in (1, -1):
            going = np.ones(len(x), dtype=bool)
            for i in range(step, step * near, step):
                going &= (padded[x + i] == padded[x + p + i]) & (owner[x + i] == owner[x]) & (owner[x + p + i] == owner[x])
                shared += going
        enough = shared >= near
        found.append((whole[at[enough]], x[enough] - near, p[enough]))
        begin = end
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _extended(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, group: np.ndarray, doc: np.ndarray, x: np.ndarray, p: np.ndarray, shortest: int) -> Iterator[tuple[int, tuple]]:
    """The runs of the documents ``group`` from their grid points."""
    own = np.searchsorted(group, doc)
    size = sizes[group] + 1  # and a word of its own at the end of each document
    base = np.cumsum(size) - size
    text = np.concatenate([np.r_[ids[first[d] : first[d] + sizes[d]], -1 - i] for i, d in enumerate(group)])
    n = len(text)
    at = x - first[doc] + base[own]
    forward = Extensions(text).shared(at, at + p)
    # What stands before the points, read backwards: the reverse begins with the end of the last document.
    reverse = np.concatenate([text[::-1], [-1 - len(group)]])
    backward = Extensions(reverse).shared(n - at, n - at - p)
    start = at - backward - base[own]
    length = backward + p + forward
    fit = np.flatnonzero((length >= shortest) & (length >= 2 * p))
    own, start, length, p = own[fit], start[fit], length[fit], p[fit]
    order = np.lexsort((p, length, start, own))
    own, start, length, p = own[order], start[order], length[order], p[order]
    if len(own):
        new = np.r_[True, (own[1:] != own[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
        own, start, length, p = own[new], start[new], length[new], p[new]
        order = np.lexsort((p, start, own))
        own, start, length, p = own[order], start[order], length[order], p[order]
        for part in np.split(np.arange(len(own)), np.flatnonzero(own[1:] != own[:-1]) + 1):
            yield int(group[own[part[0]]]), (start[part], length[part], p[part])


class Extensions:
    """Longest common extensions in one sequence: suffix array, shared lengths of its neighbours, range minima."""

    def __init__(self, text: np.ndarray):
        rank = np.unique(text, return_inverse=True)[1].astype(np.int32)
        n, step, ranks = len(text), 1, []
        while True:  # prefix doubling; the ranks by 1, 2, 4 ... symbols are kept
            ranks.append(np.append(rank, np.int32(-1)))
            if int(rank.max()) == n - 1:
                break
            behind = np.zeros(n, dtype=np.int64)
            behind[: n - step] = rank[step:] + 1 if step < n else 0
            rank = np.unique(rank.astype(np.int64) * (n + 1) + behind, return_inverse=True)[1].astype(np.int32)
            step *= 2
        self.rank = rank
        order = np.empty(n, dtype=np.int64)
        order[rank] = np.arange(n)
        shared = np.zeros(n, dtype=np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            x, y = order[:-1] + shared[1:], order[1:] + shared[1:]
            shared[1:] += np.where(ranks[level][np.minimum(x, n)] == ranks[level][np.minimum(y, n)], 1 << level, 0)
        self.least = [shared.astype(np.int32)]
        while (1 << len(self.least)) <= n:
            half = 1 << (len(self.least) - 1)
            last = self.least[-1]
            wider = last.copy()
            wider[: n - half] = np.minimum(last[: n - half], last[half:])
            self.least.append(wider)
        self.least = np.stack(self.least)

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``x`` and at ``y`` (another place) share."""
        a, b = self.rank[x].astype(np.int64), self.rank[y].astype(np.int64)
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.least[level, low], self.least[level, high - (1 << level) + 1]).astype(np.int64)
