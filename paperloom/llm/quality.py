"""Quality classifier: co-training of a text-content and a page-metadata view."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_columns, unpacked

#: Buckets of byte pairs in the text view, and of languages and sources in the metadata view.
PAIRS, LANGS, SOURCES = 256, 8, 32
TEXT, META = PAIRS + 5, LANGS + SOURCES + 8


def text_view(data: bytes) -> np.ndarray:
    """What a document says: hashed byte pairs, and how its words vary."""
    out = np.zeros(TEXT)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    pairs = np.bincount((((b[:-1] << 8) | b[1:]) * np.uint32(2654435761)) >> np.uint32(24), minlength=PAIRS)
    out[:PAIRS] = np.sqrt(pairs / max(1, len(b) - 1))
    words = data.split()
    if words:
        n, kinds = len(words), Counter(words)
        out[PAIRS:] = len(kinds) / n, kinds.most_common(1)[0][1] / n, sum(map(bytes.__eq__, words[1:], words)) / n, np.log1p(len(data) / n), np.log1p(n) / 10
    return out


def meta_view(data: bytes, lang: str | None, source: str | None) -> np.ndarray:
    """What a page is like: its language, source, size, and the layout of its lines and marks.

    The layout is read off the text, but no word or byte sequence is.  Without the shares of
    marks, digits and spaces this view can hardly tell good pages from bad ones on its own, and
    then its pseudo-labels make the other view worse.
    """
    out = np.zeros(META)
    out[zlib.crc32((lang or "").encode()) % LANGS] = 1
    out[LANGS + zlib.crc32((source or "").encode()) % SOURCES] = 1
    b = np.frombuffer(data, np.uint8)
    n = max(1, len(b))
    marks = np.count_nonzero(((b > 32) & (b < 48)) | ((b > 57) & (b < 65)) | ((b > 90) & (b < 97)) | ((b > 122) & (b < 128))) / n
    lines = data.split(b"\n")
    long = max(map(len, lines)) / n
    digits = np.count_nonzero((b > 47) & (b < 58)) / n
    out[LANGS + SOURCES :] = np.log1p(n) / 10, np.log1p(len(lines)) / 5, np.sqrt(marks), long, np.sqrt(digits), len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 10, np.sqrt(np.count_nonzero(b == 32) / n)
    return out


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Count and moments of rows, and gradient and Hessian of the logistic loss at ``weights``: sums over rows."""
    one = np.hstack([x, np.ones((len(x), 1))])
    p = _sigmoid(one @ weights)
    return np.concatenate([[weight.sum()], weight @ x, weight @ (x * x), one.T @ (weight * (p - y)), ((one * (weight * p * (1 - p))[:, None]).T @ one).ravel()])


def _newton(sums: np.ndarray, weights: np.ndarray, ridge: float, before: tuple[np.ndarray, float] | None) -> tuple[Linear, np.ndarray, tuple[np.ndarray, float]]:
    """The model and its weights on plain features after one Newton step on standardised ones, then the step and its share taken.

    A step that turns back on the one before it has overshot: the share is halved, else doubled.
    """
    d = len(weights) - 1
    mean = sums[1 : d + 1] / sums[0]
    scale = np.sqrt(np.maximum(0, sums[d + 1 : 2 * d + 1] / sums[0] - mean**2))
    scale[scale < 1e-5] = 1.0
    turn = np.diag(np.append(1 / scale, 1.0))  # from plain features and a one to standardised ones
    turn[-1, :d] = -mean / scale
    grad, hess = sums[2 * d + 1 : 3 * d + 2], sums[3 * d + 2 :].reshape(d + 1, d + 1)
    own, penalty = np.linalg.solve(turn, weights), ridge * np.append(np.ones(d), 1e-6)
    step = np.linalg.solve(turn.T @ hess @ turn + np.diag(penalty), turn.T @ grad + penalty * own)
    share = min(1.0, before[1] * (0.5 if step @ before[0] < 0 else 2)) if before else 1.0
    own -= step * share * min(1.0, 4 / max(float(np.abs(step).max()), 1e-9))
    return Linear(mean, scale, own), turn @ own, (step, share)


def fit(x: list[np.ndarray], y: np.ndarray, weight: np.ndarray, start: list[np.ndarray] | None = None, more: Callable[[list[np.ndarray]], np.ndarray] | None = None, ridge: float = 1.0, steps: int = 20) -> tuple[list[Linear], list[np.ndarray]]:
    """Ridge logistic regressions of ``y`` on each view of ``x``, by Newton's method on standardised features.

    ``more`` gives the ``_sums`` of further rows, of one view after the other, at given weights.
    """
    at, taken = start or [np.zeros(v.shape[1] + 1) for v in x], [None] * len(x)
    for _ in range(steps):
        sums = [_sums(v, y, weight, w) for v, w in zip(x, at, strict=True)]
        if more:
            sums = np.split(np.concatenate(sums) + more(at), np.cumsum([len(s) for s in sums])[:-1])
        models, at, taken = map(list, zip(*(_newton(s, w, ridge, t) for s, w, t in zip(sums, at, taken, strict=True)), strict=True))
        if max(np.abs(step).max() for step, _ in taken) < 1e-3:
            break
    return models, at


@dataclass
class CoTrained:
    """Two views and the calibrated combination of their logits."""

    views: tuple[Linear, Linear]
    calibration: tuple[Linear, Linear]
    combined: Linear
    rounds: list[tuple[int, int]]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = np.stack([v.logit(x) for v, x in zip(self.views, (text, meta), strict=True)], axis=1)
        own = [_sigmoid(c.logit(logits[:, [i]])) for i, c in enumerate(self.calibration)]
        return _sigmoid(self.combined.logit(logits)), own[0], own[1]


#: Logits beyond the least confident one are counted in so many steps of this width.
BINS, STEP = 1000, 0.02


def _bins(logit: np.ndarray, least: float) -> np.ndarray:
    """0 where not confident, else the number of the step, with the sign of the logit."""
    beyond = np.abs(logit) - least
    return np.where(beyond < 0, 0, np.sign(logit) * (1 + np.clip(beyond // STEP, 0, BINS - 1))).astype(np.int64)


def _given(x: tuple[np.ndarray, np.ndarray], history: list, least: float) -> list[np.ndarray]:
    """The pseudo-labels that each view has been given, NaN where none: they follow from the models and limits of all rounds."""
    given = [np.full(len(x[0]), np.nan) for _ in (0, 1)]
    for views, limits in history:
        for v in (0, 1):
            bins, free = _bins(views[v].logit(x[v]), least), np.isnan(given[1 - v])
            given[1 - v][free & (bins >= limits[v][1])] = 1.0
            given[1 - v][free & (bins <= -limits[v][0])] = 0.0
    return given


def _pool_bins(x: tuple[np.ndarray, np.ndarray], views: list[Linear], history: list, least: float) -> np.ndarray:
    """Of each view, the rows by bin that it has not given a label."""
    given = _given(x, history, least)
    return np.concatenate([np.bincount(_bins(views[v].logit(x[v]), least)[np.isnan(given[1 - v])] + BINS, minlength=2 * BINS + 1) for v in (0, 1)]).astype(float)


def _pool_sums(x: tuple[np.ndarray, np.ndarray], weights: list[np.ndarray], history: list, least: float) -> np.ndarray:
    """``_sums`` of the rows that each view has been given."""
    out = []
    for v, y in enumerate(_given(x, history, least)):
        has = ~np.isnan(y)
        out.append(_sums(x[v][has], y[has], np.ones(has.sum()), weights[v]))
    return np.concatenate(out)


def _limits(counts: np.ndarray, share: float) -> tuple[tuple[int, int], int]:
    """The least bins whose rows get labels 0 and 1, and how many rows these are."""
    sides = counts[:BINS][::-1], counts[BINS + 1 :]  # from the least confident bin on
    take, sure, limits, n = int(share * counts.sum()), sum(map(np.sum, sides)), [], 0
    for side in sides:
        best = np.cumsum(side[::-1])  # rows alike are in one bin and go together
        quota = max(1, round(take * best[-1] / max(1, sure)))
        bins = min(BINS, int(np.searchsorted(best, quota)) + 1) if best[-1] else 0
        limits.append(BINS + 1 - bins)
        n += int(best[bins - 1]) if bins else 0
    return tuple(limits), n


def held_out(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to fit on, and rows to calibrate on: every fifth of each class, and a class of one row in both."""
    held = np.zeros(len(y), dtype=bool)
    alone = held.copy()
    for side in (0, 1):
        rows = np.flatnonzero(y == side)
        held[rows[4::5] if len(rows) >= 5 else rows[1:2]] = True
        alone[rows if len(rows) == 1 else []] = True
    return ~held, held | alone


def co_train(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray] | Callable, rounds: int = 4, confident: float = 0.95, share: float = 0.25, weight: np.ndarray | None = None) -> CoTrained:
    """Co-trains two views on labelled rows ``x, y`` (that count ``weight``) and an unlabelled ``pool``.

    The pool is two arrays, or what adds up a function of them over rows wherever they are.
    A fifth of the labelled rows of each class is held out.  In each round both views are fitted, and each
    gives the other its most confident pool rows, about ``share`` of the rest of the pool and
    in the proportions that it predicts, as pseudo-labels.  On the held-out rows each
    view's logit is calibrated, and the two are combined.
    """
    over = pool if callable(pool) else lambda f: f(pool)
    weight = np.ones(len(y)) if weight is None else weight
    fitted, judged = held_out(y)
    least, history, counts, at = float(np.log(confident / (1 - confident))), [], [], None
    for turn in range(rounds + 1):
        # Without pseudo-labels there is nothing to add up.
        more = partial(lambda h, w: over(partial(_pool_sums, weights=w, history=h, least=least)), list(history)) if history else None
        views, at = fit([v[fitted] for v in x], y[fitted], weight[fitted], at, more)
        if turn == rounds:
            break
        found = np.zeros(2 * (2 * BINS + 1)) + over(partial(_pool_bins, views=views, history=list(history), least=least))
        limits, new = zip(*(_limits(c, share) for c in np.split(found, 2)), strict=True)
        if not sum(new):
            break
        history.append((views, limits))
        counts.append(new)
    logits = np.stack([views[v].logit(x[v][judged]) for v in (0, 1)], axis=1)
    (first, second), _ = fit([logits[:, [0]], logits[:, [1]]], y[judged], weight[judged])
    (combined,), _ = fit([logits], y[judged], weight[judged])
    return CoTrained(tuple(views), (first, second), combined, counts)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("text", "lang", "source")]
        rows = [np.concatenate([text_view(d), meta_view(d, lang, source)]).astype(np.float32).tobytes() for d, lang, source in _rows(*columns)]
        yield pa.record_batch({"id": batch["id"], "features": pa.array(rows, pa.binary())})


def _rows(texts: list, langs: list, sources: list) -> Iterator[tuple[bytes, str, str]]:
    for text, lang, source in zip(texts, langs, sources, strict=True):
        yield (text or "").encode("utf-8", "surrogatepass"), lang, source


#: Partial sums of more tasks than this are added up in tasks before they reach the driver.
FAN = 64


def _over(table: DataFrame, fan: int | None = None) -> Callable:
    """Adds up a function of both views over all rows of ``features``."""
    n = table.rdd.getNumPartitions()

    def over(f: Callable) -> np.ndarray | float:
        parts = table.mapInArrow(lambda it: _totals(it, lambda m: f((m[:, :TEXT], m[:, TEXT:]))), "part binary")
        if n > (fan or FAN):
            parts = parts.repartition(math.isqrt(n)).mapInArrow(_added, "part binary")
        return sum((np.frombuffer(r.part) for r in parts.collect()), 0.0)  # a row a task, of about 0.6 MB

    return over


def _matrix(features: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(features), np.float32).reshape(len(features), TEXT + META).astype(np.float64)


def _totals(batches: Iterator[pa.RecordBatch], f: Callable) -> Iterator[pa.RecordBatch]:
    total = sum((f(_matrix(batch["features"].to_pylist())) for batch in batches if len(batch)), 0.0)
    if not isinstance(total, float):
        yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum((np.frombuffer(part) for batch in batches for part in batch["part"].to_pylist()), 0.0)
    if not isinstance(total, float):
        yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", label: str = "quality", most: int = 8000, **options) -> CoTrained | None:
    """Co-trains on about ``most`` labelled documents and all unlabelled ones.

    The features of all documents (about 1.2 KB each) are written to the shared folder once.
    Each round counts the confident unlabelled ones, and each Newton step sums gradients and
    Hessians over those with pseudo-labels, where they lie; only sums reach the driver.

    The labelled sample is the rows of smallest id hash of each class, so it does not depend on
    the layout of the input; the bound is also what makes the broadcast of sampled ids and the
    features that reach the driver safe.  A rare class has a sixteenth of it at least, as far
    as there are rows, and weights restore its share.  Several labels of a document are
    averaged.  Without labelled documents of both kinds there is no classifier: None.
    """
    order = lambda c: F.xxhash64(F.lit("quality"), c)
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("k")).agg((F.avg(label) >= 0.5).cast("int").alias("quality"))
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    shape = "id long, features binary"
    met = rows.where("id IS NOT NULL").mapInArrow(_featured, shape).join(known, F.col("id") == F.col("k"), "left").select("id", "quality", "features")
    nameless = rows.where("id IS NULL").mapInArrow(_featured, shape).select("id", F.lit(None).cast("int").alias("quality"), "features")
    table = materialize(met.unionByName(nameless), "quality-features")
    ids = table.where("quality IS NOT NULL").select("id", "quality").distinct()
    n = {r.quality: r.n for r in ids.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    rare, common = sorted(n, key=n.get)
    take = {rare: min(n[rare], max(1, most // 16, round(most * n[rare] / sum(n.values()))))}
    take[common] = min(n[common], max(1, most - take[rare]))
    sample = [ids.where(F.col("quality") == c).select(F.col("id").alias("k")).orderBy(order(F.col("k")), "k").limit(take[c]) for c in n]
    got = table.join(F.broadcast(sample[0].unionByName(sample[1])), F.col("id") == F.col("k")).select("id", "quality", "features").toPandas()
    got = got.sort_values(["id", "features"]).drop_duplicates("id")
    # In an order that has nothing to do with ids, for the held-out fifth.
    got = got.iloc[np.argsort([zlib.crc32(b"%d" % i) for i in got["id"]], kind="stable")]
    x, y = _matrix(got["features"].tolist()), got["quality"].to_numpy(dtype=float)
    part = {c: take[c] / sum(take.values()) * sum(n.values()) / n[c] for c in n}
    weight = np.array([1 / part[int(c)] for c in y])
    return co_train((x[:, :TEXT], x[:, TEXT:]), y, _over(table.where("quality IS NULL").select("features")), weight=weight, **options)


def classify(docs: DataFrame, labels: DataFrame, keep_above: float = 0.5, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """Scores every document by two co-trained views; the model of ``train`` goes to all tasks.

    Every row is scored on its whole text, in the task that reads it.
    Returns the columns of ``docs``, then ``quality`` (combined probability of good quality),
    ``text_quality, meta_quality`` (each view, calibrated) and ``keep`` (``quality >=
    keep_above``, so a score of just that stays); columns of these names in ``docs`` give
    way, all others stay, whatever their names.  Repeated rows are scored alike, null ids like
    others.  Null and blank texts have nothing to keep: quality 0.  Null languages and sources are a value of their own.  With
    no usable labels every other document has quality 1.  An empty table stays empty.
    """
    model = train(docs, labels, id, text, lang, source, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {"quality": "double", "text_quality": "double", "meta_quality": "double", "keep": "boolean"}
    base = docs.select(own_columns(docs, *added).alias("own"), *[F.col(f"`{c}`").cast("string").alias(n) for n, c in (("text", text), ("lang", lang), ("source", source))])
    schema = base.select("own").schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return unpacked(base.mapInArrow(lambda it: _classified(it, shared, keep_above), schema), "own", *added)


def _classified(batches: Iterator[pa.RecordBatch], shared, keep_above: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_rows(*[batch[c].to_pylist() for c in ("text", "lang", "source")]))
        blank = np.array([not d.strip() for d, _, _ in rows], dtype=bool)
        scores = [np.ones(len(rows))] * 3
        if shared.value is not None and len(rows):
            scores = shared.value.scores(np.stack([text_view(d) for d, _, _ in rows]), np.stack([meta_view(*r) for r in rows]))
        scores = [np.where(blank, 0.0, s) for s in scores]
        columns = [batch["own"], *[pa.array(s, pa.float64()) for s in scores], pa.array(scores[0] >= keep_above)]
        yield pa.RecordBatch.from_arrays(columns, ["own", "quality", "text_quality", "meta_quality", "keep"])
