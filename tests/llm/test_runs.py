"""Periodic runs against a search of all stretches, and the query against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import queries, runs


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(words, shortest=12):
    """Maximal stretches of each period that agree with themselves shifted; only smallest periods."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(shortest, 2 * q) and smallest_period(stretch) == q:
                out.append((i, len(stretch), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def listed(found):
    return [list(zip(*(c.tolist() for c in f), strict=True)) for f in found]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=40), max_size=6), st.sampled_from([2, 5, 12]), st.sampled_from([3, 50]), st.sampled_from([7, 1 << 20]))
def test_runs_of_words(texts, shortest, together, points):
    before = runs.WORDS, runs.POINTS
    runs.WORDS, runs.POINTS = together, points
    try:
        assert listed(runs.runs_of([list(t) for t in texts], shortest)) == [brute(list(t), shortest) for t in texts]
    finally:
        runs.WORDS, runs.POINTS = before


@given(st.text("ab", min_size=2, max_size=30), st.data())
def test_extensions(text, data):
    ids = np.array([ord(c) for c in text] + [0])
    x, y = data.draw(st.lists(st.integers(0, len(text) - 1), min_size=2, max_size=2, unique=True))
    want = next((n for n in range(len(text)) if x + n >= len(text) or y + n >= len(text) or text[x + n] != text[y + n]), len(text))
    assert runs.Extensions(ids).shared(np.array([x]), np.array([y])).tolist() == [want]


def planted(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", "cd", "x y"])
    out = []
    for _ in range(40):
        words = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            unit = [word() for _ in range(rng.randint(1, 9))]
            words += (unit * 12)[: rng.randint(1, 60)] + [word() for _ in range(rng.randint(0, 5))]
        out.append(rng.choice([" ", "\n", "\t\x0b \r\f"]).join(words))
    return out


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("size", [64, 1 << 22])
def test_operator(spark, size, monkeypatch):
    monkeypatch.setattr(runs, "TEXT", size)
    texts = [*planted(1), None, "", " \n ", "w " * 5000, "p q r " * 4]
    df = spark.createDataFrame([(i, t, "r", 5) for i, t in enumerate(texts * 2)], "doc_id long, text string, runs string, start int")
    out = runs.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "start", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        words = split(r.text)
        found = [(x.start, x.length, x.period) for x in r.runs]
        assert found == ([(0, 5000, 1)] if len(words) == 5000 else brute(words))
        assert r.collapsed == collapsed(words, found)
    assert runs.periodic_runs(df.limit(0)).count() == 0
    assert runs.periodic_runs(df.where("doc_id IS NULL")).count() == 0


def rebuilt(i, text):
    words, h = split(text), zlib.crc32(str(i).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    return words


def digest(i, text):
    words = rebuilt(i, text)
    found = listed(runs.runs_of([words], 12))[0] if len(words) > 700 else brute(words)  # long texts: by the array version, tested above
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (i, len(found), s, n, q, None if s is None else 1000 * n // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(collapsed(words, found)))


def test_query(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op12_periodic_runs(spark, folder).collect()) == sorted(digest(*d) for d in docs)


def test_replanted_edges(spark):
    at = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    docs = [(at[0], None), (at[1], ""), (at[2], " \t"), (at[3], "one"), (at[4], "a b"), (at[5], "\na b  c d e f\rg h i j k l m n o p "), (None, "a b c"), (1, "a  b")]
    out = queries.replanted(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [split(r.text) for r in out] == [rebuilt(i, t) if i is not None else split(t) for i, t in docs]
