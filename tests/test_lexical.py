"""The inverted index against scans of all texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions.embed import cover_density, stem
from paperloom.operators import lexical_index, retrieval

WORDS = ["license", "licenses", "version", "term", "the", "Straße", "price", "of", "goods", "x1"]


def texts(n=200):
    rng = random.Random(3)
    return [(i, " ".join(rng.choices(WORDS, weights=[1, 1, 2, 3, 30, 1, 2, 10, 1, 1], k=rng.randint(0, 60)))) for i in range(n)] + [(900, None), (901, ""), (902, "the " * 500), (903, "license " + "x " * 3000 + "version")]


def scan(rows, terms, k):
    """Density of every text, as the functions have it."""
    out = []
    for i, text in rows:
        words = [stem(w) for w in re.findall(r"[^\W_]+", (text or "").casefold())]
        d = cover_density([ps for t in terms if (ps := [p for p, w in enumerate(words) if w == t])])
        if d > 0:
            out.append((-d, i))
    return [(i, round(-d, 12)) for d, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    lexical_index.write_index(spark.createDataFrame(texts(), "doc_id long, text string"), ["doc_id"], "text", path, buckets=8)
    return lexical_index.LexicalIndex(spark, path)


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_ranks_are_those_of_a_scan(index, k):
    questions = {1: ["the"], 2: ["licens", "version"], 3: index.terms("price of the goods"), 4: ["nowhere"], 5: ["nowhere", "strasse"]}
    found = {}
    for r in index.rank(questions, k).collect():
        found.setdefault(r.query, []).append((r["rank"], r.doc_id, round(r.density, 12)))
    for q, terms in questions.items():
        assert [x[1:] for x in sorted(found.get(q, []))] == scan(texts(), terms, k)


def test_rank_of_some_texts(spark, index):
    only = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "doc_id long")
    found = [(r.doc_id, round(r.density, 12)) for r in index.rank({0: ["the", "pric"]}, 5, where=only).orderBy("rank").collect()]
    assert found == scan([t for t in texts() if t[0] % 3 == 0 and t[0] < 200], ["the", "pric"], 5)


def test_only_blocks_of_asked_terms_are_read(index):
    plan = index.postings(["licens", "pric"])
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in shown and "In(term, [licens,pric])" in shown
    folders = {f.rsplit("/", 2)[1] for f in plan.inputFiles()}
    assert {r.bucket for r in plan.select("bucket").distinct().collect()} <= {int(f.split("=")[1]) for f in folders}
    assert {r.term for r in plan.select("term").distinct().collect()} == {"licens", "pric"}


def test_weights_and_coverage_are_those_of_a_scan(spark, index):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    words = df.select("doc_id", F.transform(F.expr("regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+', 0)"), lambda w: F.when(w == "license", "licens").when(w == "licenses", "licens").when(w == "price", "pric").otherwise(w)).alias("words"))
    terms = ["licens", "pric", "zzz"]
    assert sorted((r.term, round(r.idf, 9)) for r in index.weights(terms).collect()) == sorted((r.term, round(r.idf, 9)) for r in retrieval.term_weights(words, "words", terms).collect())
    want = {(r.doc_id, round(r.coverage, 9)) for r in retrieval.term_coverage(words, "doc_id", "words", terms).where("coverage > 0").collect()}
    assert {(r.doc_id, round(r.coverage, 9)) for r in index.coverage(terms).collect()} == want


def test_index_of_nothing(spark, tmp_path):
    lexical_index.write_index(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], "text", str(tmp_path))
    index = lexical_index.LexicalIndex(spark, str(tmp_path))
    assert index.match(["a"]).count() == 0 and index.rank({0: ["a"]}).count() == 0
    with pytest.raises(ValueError, match="terms"):
        index.match([str(i) for i in range(10_001)])
