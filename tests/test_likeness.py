"""Trigram joins against all pairs, and what the candidates of vendors lose of the final score."""

import random
import re

import pytest

from paperloom.functions.similarity import name_similarity, organization_key
from paperloom.operators import extraction, likeness


def grams(name):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", name.lower()) for i in range(len(w) + 1)}


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def names(seed, n):
    rng = random.Random(seed)
    part = ["kestrel", "sons", "harbor", "pine", "acme", "trading", "north", "steel", "pipes", "osprey"]
    return sorted({" ".join(rng.choices(part, k=rng.randint(1, 4))) + rng.choice(["", f" {rng.randint(1, 60)}"]) for _ in range(n)})


def misprinted(name, rng):
    i = rng.randrange(len(name))
    return name[:i] + rng.choice("aeiou") + name[i + rng.randint(0, 1) :]


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_pairs_are_those_of_all_pairs(spark, least):
    a, b = names(1, 70), [*names(2, 70), "", " .. "]
    left, right = likeness.rare_first(spark.createDataFrame([(x,) for x in a], "name string"), spark.createDataFrame([(x,) for x in [*b, *b, None]], "other string"), "name", "other")
    found = sorted((r.name, r.other, round(r.alike, 9)) for r in likeness.alike_pairs(left, right, least).collect())
    assert found == sorted((x, y, round(jaccard(x, y), 9)) for x in a for y in b if jaccard(x, y) >= least - 1e-12 and jaccard(x, y) > 0)


@pytest.mark.parametrize("most", [1, 4, 25])
def test_the_likest_are_found(spark, most):
    a, b = names(3, 60), names(4, 80)
    df = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    found = {}
    for r in likeness.most_alike(df(a, "key"), df(b, "v_key"), "key", "v_key", 0.2, most).collect():
        found.setdefault(r.name, []).append((-r.alike, r.other))
    for x in a:
        want = sorted((-jaccard(x, y), y) for y in b if jaccard(x, y) >= 0.2)[:most]
        assert sorted(found.get(x, []))[:most] == want


def test_common_triples_make_no_pairs(spark):
    """A thousand names that share their beginning: pairs grow with the names, not with their square."""
    df = spark.createDataFrame([(f"kestrel and sons number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i:04d}",) for i in range(1000)], "name string")
    left, right = likeness.rare_first(df, df.withColumnRenamed("name", "other"), "name", "other")
    joined = likeness.alike_pairs(left, right, 0.9)
    assert joined.count() < 20_000


def test_candidates_and_the_final_score(spark):
    """Of misprinted names whose best score is 85 or more, the candidates (25 of likeness 0.2) keep most: README has the share."""
    rng = random.Random(5)
    vendors = [(i, organization_key(n)) for i, n in enumerate(names(6, 300))]
    asked = sorted({misprinted(n, rng) for _, n in vendors})
    df = spark.createDataFrame([(k,) for k in asked], "key string")
    found = {}
    for r in extraction.vendor_candidates(df, spark.createDataFrame(vendors, "vendor_id long, v_key string")).collect():
        found.setdefault(r.key, []).append(name_similarity(r.key, r.v_key))
    best = {k: max(name_similarity(k, n) for _, n in vendors) for k in asked}
    good = [k for k in asked if best[k] >= 85]
    kept = sum(max(found.get(k, [0])) >= best[k] - 1e-9 for k in good)
    print(f"recall of the best score: {kept} of {len(good)}")
    assert kept / len(good) >= 0.9
