"""The prefix trie against a plain one, and the query against its SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import queries, trie

from ..compare import assert_same


def plain_trie(sequences):
    """Rows of the nodes of ``[(conv_id, [(role, text), ...])]``."""
    nodes = {}
    for c, turns in sequences:
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, d == len(turns)))
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = {k for k in below if len(k) == len(key) + 1}
        leaves = sum(not any(len(x) > len(k) and x[: len(k)] == k for x in below) for k in below)
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c, end in members if end)))
        parent = min(c for c, _ in nodes[key[:-1]]) if key else None
        out.append((min(c for c, _ in members), len(key), parent, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ordered(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}


def talk(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, 7)):
            rows.append((c * 3 - 20, turn, rng.choice(["user", "assistant"]), rng.choice("abé") * rng.randint(0, 2)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("local_turns", [1, 5, 40, 2048])
def test_trie(spark, local_turns, monkeypatch):
    monkeypatch.setattr(trie, "JOINED", 3)
    rows = talk(local_turns) + [(900 + i, t, "user", "same" * t) for i in range(30) for t in range(6)] + [(700, None, None, None), (700, 3, "user", None), (None, 1, "user", "x"), (800, -1, "", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", code int, turns string")
    found = trie.conversation_trie(df, local_turns=local_turns).collect()
    assert sorted(map(tuple, found), key=str) == plain_trie(list(ordered(rows).items()))


def test_trie_of_long_shared_beginnings_and_of_turnless_ones(spark):
    long = [("user", str(i)) for i in range(300)]
    sequences = [(i, long[: 250 + i % 7] + [("user", f"own {i}")] * (i % 3)) for i in range(40)] + [(100, []), (101, []), (102, long)]
    code = {t: i for i, t in enumerate(sorted({t for _, s in sequences for t in s}))}
    df = spark.createDataFrame([(c, [(code[t], len(t[1])) for t in s]) for c, s in sequences] + [(None, [])], "conv_id long, turns array<struct<code:long,size:long>>")
    for local_turns in (100, 1 << 20):
        assert sorted(map(tuple, trie.prefix_trie(df, local_turns).collect()), key=str) == plain_trie(sequences)
    nulls = df.where("conv_id >= 100").withColumn("turns", F.when(F.size("turns") > 0, F.col("turns")))
    assert sorted(map(tuple, trie.prefix_trie(nulls).collect()), key=str) == plain_trie([s for s in sequences if s[0] >= 100])


def test_trie_of_nothing_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "user", "a")], SCHEMA)
    assert trie.conversation_trie(df.limit(0)).count() == 0
    assert sorted(map(tuple, trie.conversation_trie(df).collect()), key=str) == plain_trie([(1, [("user", "a")] * 2), (2, [("user", "a")])])


def rebuilt(rows):
    turns = ordered(rows)
    out = []
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out.append((c, turns.get(c - c % 5, [])[:h] + own[h:]))
    return out


def test_query(spark, folder, duck):
    found = queries.op13_conversation_trie(spark, folder)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, found.collect()), key=str) == plain_trie(rebuilt(rows))
    assert_same(found, duck, queries.SQL["op13_conversation_trie"])
