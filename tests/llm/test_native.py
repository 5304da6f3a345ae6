"""Line dedup and URL filters against plain Python, and their edge cases."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import lines, queries, urls

from ..compare import assert_same

SPACE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark, folder, duck):
    assert_same(queries.QUERIES[name](spark, folder), duck, queries.SQL[name])


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def kept_lines(texts, least):
    keys = [[low(x.strip(SPACE)) for x in (t or "").split("\n")] for t in texts]
    counts = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for t, ks in zip(texts, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if not (k and counts[k] >= least)]
        out.append((len(ks), len(ks) - len(kept), None if t is None else "\n".join(kept)))
    return out


def check_lines(spark, texts, least):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(df, min_docs=least).collect()}
    assert found == dict(enumerate(kept_lines(texts, least)))


def test_line_dedup_small(spark):
    check_lines(spark, ["a\nB \n\nc", "b\nx", " \tB\r\ny\n", None, "", "B\n\n\nB", "É\né", "É", "x" * 200_000 + "\nb"], 3)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text("aAbß \n\t", max_size=14)), min_size=1, max_size=12))
def test_line_dedup_brute_force(spark, texts):
    check_lines(spark, texts, 2)


def test_line_dedup_tables(spark):
    rows = [(None, "a\nb", 7), (None, "a\nc", 8), (1, "a\nd", 9), (1, "a\nd", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long").withColumn("pos", F.lit("x"))
    out = lines.dedup_lines(df, min_docs=4).collect()
    assert sorted(r.text for r in out) == ["b", "c", "d", "d"] and {r.n_lines for r in out} == {2} and {r.pos for r in out} == {"x"}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_url_rules(spark):
    rows = [(0, "http://A.Example.NET/en/x?q"), (1, "http://example.net/fr/"), (2, "https://b.example.com/de/?"), (3, "x://y.org/fr/z"), (4, "http://notnet/"), (5, "http://a.net"),
            (6, None), (7, "no scheme"), (8, "http://example.org/cheap-pills/1"), (9, "http://example.org/pillsbury"), (10, "http://x.net/#a"), (11, ""), (12, "http://y.org/fr/z" + "a" * 100_000), (0, "http://A.Example.NET/en/x?q")]
    out = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), urls.default_rules(spark)).collect()}
    assert out == {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: ("example.com/de/", "block"), 3: ("org/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"),
                   7: (None, "allow"), 8: (None, "block"), 9: (None, "allow"), 10: ("net/", "block"), 11: (None, "allow"), 12: ("org/fr/", "allow")}


def test_url_tables(spark):
    rules = urls.rules_frame(spark, [urls.pattern_rule("digits", r"\d{4}", "block", []), urls.host_rule("a.b/en", "allow")])
    df = spark.createDataFrame([("http://a.b/english", "x"), ("http://c/1234", "y"), ("http://c/1234", "y")], "url string, rule string")
    out = urls.judge_urls(df, rules).collect()
    assert sorted((r.host, r.rule, r.verdict, r.pattern_rule) for r in out if r.host == "a.b") == [("a.b", "a.b/en", "allow", None)]
    assert [(r.verdict, r.pattern_rule) for r in out if r.host == "c"] == [("block", "digits")] * 2
    assert urls.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, urls.rules_frame(spark, [])).collect()} == {"allow"}


def test_the_rarest_literal_is_the_index(spark):
    """Pattern rules of several literals: the word that the fewest URLs hold fetches them, and only its URLs run them."""
    addresses = [f"http://shop{i}.com/item/page/{i}" for i in range(20)] + ["http://a.com/item/free/offer", "http://b.com/item/free/x", "http://b.com/offer/item/free"]
    rules = [urls.pattern_rule("deal", "/free/offer", "block", ["item", "free", "offer"]), urls.pattern_rule("none", "item.*zebra", "block", ["item", "zebra"]), urls.pattern_rule("all", "^nothing$", "block", [])]
    asked = spark.createDataFrame([(u, t) for u in addresses for t in {*re.findall("[0-9A-Za-z]+", u.split("://")[1]), ""}], "url string, token string")
    index = {r.rule: r.token for r in urls.rule_index(urls.rules_frame(spark, rules), asked).collect()}
    assert index == {"deal": "offer", "none": "zebra", "all": ""}
    out = urls.judge_urls(spark.createDataFrame([(u,) for u in addresses], "url string"), urls.rules_frame(spark, rules)).collect()
    assert {r.url for r in out if r.verdict == "block"} == {"http://a.com/item/free/offer"}


def test_hash_is_of_whole_text(spark, folder):
    row = queries.op2_line_dedup(spark, folder).orderBy("doc_id").first()
    assert len(row.kept_sha256) == len(hashlib.sha256(b"").hexdigest())
