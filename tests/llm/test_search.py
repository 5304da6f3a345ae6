"""Vector search and near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import graph, neardup, vectors

SCHEMA = "vec_id long, embedding array<double>"


def brute_top(rows, asked, k):
    whole = [(i, np.floor(1024 * np.array(v, dtype=float)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in whole if asked(i)}:
        scores = sorted((-int(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in whole if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"query_bytes": 100, "bins": 4}])
def test_top_k(spark, options):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 4) / 4).tolist()) for i in range(120)]
    rows += [(500, None), (501, []), (540, []), (505, []), (502, [1.0, None, 0.0, 0.0]), (503, [float("nan")] * 4), (None, [1.0] * 4), (510, [1.0, 2.0]), (520, [0.5, 0.5]), (530, [1e3] * 4), (0, rows[0][1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1))
    found = sorted(tuple(r) for r in vectors.top_k(df, F.col("vec_id") % 10 == 0, k=5, **options).select("query_id", "rank", "vec_id", "score").collect())
    assert found == brute_top(rows, lambda i: i % 10 == 0, 5)


@pytest.mark.parametrize("bins", [3, 7, 100, 128])
def test_top_k_of_dense_scores(spark, bins):
    """Scores of any value, so that a bin's neighbours are full; widths that are no powers of the bins."""
    rows = list(enumerate((np.random.default_rng(bins).normal(size=(700, 8)) * 0.4).tolist()))
    found = sorted(tuple(r) for r in vectors.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=10, bins=bins).collect())
    assert found == brute_top(rows, lambda i: i % 50 == 0, 10)


@pytest.mark.parametrize("every", [20, 100])
def test_top_k_of_the_table(spark, every):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found = sorted(tuple(r) for r in vectors.top_k(table, F.col("vec_id") % every == 0, k=10).collect())
    assert found == brute_top([tuple(r) for r in table.collect()], lambda i: i % every == 0, 10)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0])], SCHEMA)
    assert vectors.top_k(df.limit(0), F.lit(True)).count() == 0
    assert vectors.top_k(df, F.lit(False)).count() == 0
    with pytest.raises(ArithmeticError):
        vectors.top_k(spark.createDataFrame([(1, [1e200, 1.0]), (2, [1e200, 1.0])], SCHEMA).withColumn("embedding", F.transform("embedding", lambda x: F.least(x, F.lit(8e15)))), F.lit(True)).count()


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def check_near(spark, rows, **options):
    unit = lambda v: v / np.linalg.norm(v)
    ok = [(i, unit(np.array(v) / max(map(abs, v)))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = [(a, b) for k, (a, v) in enumerate(ok) for b, w in ok[:k] if len(v) == len(w) and v @ w >= 0.95]
    roots = union(pairs, [i for i, _ in rows])
    links = {i: sum(i in p for p in pairs) for i, _ in rows}
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    assert out == {i: (links[i], roots[i], roots[i] == i) for i, _ in rows}


@pytest.mark.parametrize("options", [{}, {"tile_bytes": 4000, "leaf": 4, "fanout": 2}])
def test_near_vectors(spark, options):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        base = rng.normal(size=6) if i % 3 == 0 else base + rng.normal(size=6) * 0.15
        rows.append((i, base.tolist()))
    rows += [(200 + i, rows[4][1]) for i in range(5)] + [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None]), (304, [float("inf"), 1.0]), (305, [1.0, 0.01]), (306, [2.0, 0.0]), (307, [1e-200, 0.0])]
    check_near(spark, rows, **options)


def test_distant_blocks_are_skipped_and_stay_unmoved(spark):
    """Of vectors that spread along a few dimensions most blocks are never compared, and no link is lost."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in (np.cos(t), np.sin(t), *rng.normal(size=6) * 0.01)]) for i, t in enumerate(rng.uniform(0, 2 * np.pi, 1200))]
    counts = {}
    check_near(spark, rows, tile_bytes=20_000, leaf=16, counts=counts)
    assert counts["classes"] == 1200 and 0 < counts["compared"] < 0.4 * counts["blocks"] and counts["moved"] < 8 * 1200


def test_near_vectors_tables(spark):
    """Repeated ids are rows of their own; other columns, whatever their names, are ignored."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (None, [1.0, 0.0]), (3, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("x"), "interval": F.lit(1), "n_links": F.lit(None), "rep": F.lit(0)})
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()), key=str)
    assert out == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True)]


def test_near_vectors_of_nothing(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    random.seed(2)
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 101 + i) for i in range(40)]
    loose = [(random.randrange(200, 300), random.randrange(200, 300)) for _ in range(60)]
    pairs = path + star + loose
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    found = dict(graph.components(spark.createDataFrame([*pairs, (None, 5)], "a long, b long"), "a", "b").collect())
    assert found == {k: v for k, v in union([p for p in pairs if p[0] != p[1]], nodes).items()}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def low_words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def check_docs(spark, rows, percent=85, **options):
    sets = {}
    for i, t in rows:
        w = low_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = union(pairs, ids)
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent, **options).collect()}
    assert out == {i: (len(sets[i]), roots[i], roots[i] == i) for i in ids}


@pytest.mark.parametrize("options", [{}, {"chunk": 4}])
def test_near_documents(spark, options):
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for size in (1, 2, 3, 40, 25):
        base = random.choices(vocabulary, k=random.randrange(60, 140))
        for c in range(size):
            words = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3])):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            rows.append((n, " ".join(words).upper() if c % 7 == 3 else "\t".join(words)))
            n += 1
    passage = " ".join(random.choices(vocabulary, k=60))
    rows += [(n + i, f"{passage} {' '.join(random.choices(vocabulary, k=12))}") for i in range(30)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "a b c d e"), (906, "É a"), (907, "é a"), (908, "x " * 30_000)]
    check_docs(spark, rows, **options)


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_of_planted_pairs(spark, percent):
    """Of thousands of pairs near the threshold those at or above it are linked, and none below it."""
    random.seed(percent)
    rows, alike = [], []
    for i in range(2500):
        base = [f"{random.randrange(1 << 30):x}" for _ in range(random.randrange(60, 200))]
        copy = list(base)
        for at in random.sample(range(len(base)), random.randrange(1, 4)):
            copy[at] = "changed"
        copy += random.choices(base, k=random.randrange(0, 8))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, copy))
        alike.append(len(a & b) / len(a | b))
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    near = [i for i, s in enumerate(alike) if 100 * s >= percent]
    close = [i for i in near if 100 * alike[i] < percent + 10]
    assert len(close) > 600 and sum(found[2 * i + 1] == 2 * i for i in near) >= 0.999 * len(near)
    assert {found[2 * i + 1] for i in range(2500) if i not in set(near)} == {2 * i + 1 for i in range(2500) if i not in set(near)}


def test_rows_of_one_id_are_one_document(spark):
    """Each row has the set of its own text; what one of the texts links with, all do."""
    a, b, c = ("one two three four five six seven", "other words are in this text here now", "and a third text of seven words now")
    rows = [(5, a), (1, a), (5, b), (9, b), (9, c), (7, "nothing like the others is written in here")]
    out = sorted((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(1, 1, True, 3), (5, 1, False, 3), (5, 1, False, 4), (7, 7, True, 4), (9, 1, False, 4), (9, 1, False, 4)]


def test_near_documents_tables(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "other words in this text here")]
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))).collect()), key=str)
    assert out == [(1, 1, True), (3, 3, True), (3, 3, True), (None, None, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
