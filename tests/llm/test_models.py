"""Quality and language on held-out rows, their edge cases, and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import language, lines, quality, urls

BIG = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{n}.parquet") for n in ("documents", "labels"))
    held = labels.where("doc_id % 4 = 1")
    out = quality.classify(docs, labels.where("doc_id % 4 <> 1")).select("doc_id", "quality", "keep").join(held.withColumnRenamed("quality", "truth"), "doc_id").toPandas()
    good = out.truth == 1
    assert len(out) == held.count() and out.keep[good].mean() >= 0.97 and (~out.keep[~good]).mean() >= 0.8


def test_co_training_beats_few_labels():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 1200).astype(float)
    views = tuple(rng.normal(size=(1200, 5)) + np.outer(y - 0.5, v) for v in ([3, 1, 0, 0, 0], [0, 0, 2.5, 1, 0]))
    few, rest = np.arange(60), np.arange(60, 1200)
    model = quality.co_train(tuple(v[few] for v in views), y[few], tuple(v[rest] for v in views))
    score, _, _ = model.scores(*(v[rest] for v in views))
    assert ((score >= 0.5) == (y[rest] == 1)).mean() >= 0.93 and sum(map(sum, model.rounds)) > 100


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(None, None, None, None, 1), (1, "", "en", None, 2), (2, "fine text here", None, "s", 3), (2, "fine text here", None, "s", 3), (3, "x " * 100_000, "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep int")
    out = {(r.doc_id, r.quality, r.keep) for r in quality.classify(docs, labels).collect()}
    assert out == {(None, 0.0, False), (1, 0.0, False), (2, 1.0, True), (3, 1.0, True)}
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs, spark.createDataFrame([(2, 1), (2, None), (None, 0)], labels.schema)).count() == 5


CLASHES = ("__text", "__host", "own", "text_", "prior", "weight", "best", "top", "loglik", "line_id", "__line_id", "hit_id", "judged", "by_host", "__judged")


def clashing(df):
    """Extra columns with the names that operators use inside, now or once."""
    return df.withColumns({c: F.lit(99) for c in CLASHES})


def test_columns_of_any_name_stay(spark):
    rows = [(1, "the cat and the dog", "en", "a.b", "http://x.net/a"), (1, "the cat and the dog", "en", "a.b", "http://x.net/a"), (None, None, None, None, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out in (quality.classify(docs, labels), language.identify(docs), lines.dedup_lines(docs), urls.judge_urls(docs, urls.default_rules(spark))):
        found = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns and len(found) == 3
        assert {r[c] for r in found for c in CLASHES} == {99}


def test_language_ties_and_very_long_texts(spark):
    """Of equally likely languages the first by name is taken; a text is judged whole, however long."""
    rows = [(1, "aaa", "xx", None), (2, "aaa", "yy", None), (3, "aaa", None, None)] + [(4, "123 " * 50_000 + "der hund und die katze " * 20_000, None, None)]
    rows += [(10 + i, "der hund und die katze im garten", "de", "h") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in language.identify(docs).collect()}
    assert out[4].language == "de" and out[4].keep and out[3].text_language == "xx"


def test_co_training_uses_the_whole_pool_and_rare_classes(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 300 = 7, repeat('$$ 77 ', 20 + id % 40), concat_ws(' ', 'plain words of a fine text', id, 'and', id * 7919 % 1000, 'more of them')) AS text", "'en' AS lang", "'s' AS source")
    labels = docs.where("doc_id < 1500").selectExpr("doc_id", "IF(doc_id % 300 = 7, 0, 1) AS quality")
    model = quality.train(docs, labels, most=64)
    assert model is not None and sum(max(r) for r in model.rounds) > 500
    out = quality.classify(docs, labels, most=64).where("doc_id >= 1500").toPandas()
    assert (out.keep == (out.doc_id % 300 != 7)).all()
    table = spark.range(0, 300, 1, 9).select(F.lit(np.ones(quality.TEXT + quality.META, np.float32).tobytes()).alias("features"))
    assert [quality._over(table, fan)(lambda x: np.array([len(x[0]), x[1].sum()])).tolist() for fan in (None, 2)] == [[300, 300 * quality.META]] * 2


def test_language_of_documents(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").withColumnRenamed("lang", "truth")
    wrong = F.when(F.col("doc_id") % 10 == 0, "en").when(F.col("doc_id") % 10 == 1, None).otherwise(F.col("truth"))
    out = language.identify(docs.withColumn("declared", wrong), declared="declared", host="source").toPandas()
    assert len(out) == docs.count() and (out.language == out.truth).mean() >= 0.985 and out.keep.mean() >= 0.99


def test_language_of_pages(spark):
    pages = language.page_evidence(spark.read.parquet(f"{BIG}/pages.parquet"))
    out = language.identify(pages, declared="declared", host="host", suffix="suffix").toPandas()
    known = out[out.declared == out.suffix]
    assert len(known) > 100 and (known.language == known.declared).mean() >= 0.97


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", "a.example.com", 1), (2, "der hund und die katze", "de", "a.example.com", 2), (3, None, "de", None, 3), (4, "", None, None, 4), (5, "123 ---", "en", "b", 5), (1, "the cat and the dog", "en", "a.example.com", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, language int")
    out = {(r.doc_id, r.language, r.keep) for r in language.identify(docs).collect()}
    assert {(1, "en", True), (2, "de", True)} <= out and {k for i, _, k in out if i > 2} == {False} and len(out) == 5
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.language for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {None}


def brute_languages(rows):
    """Language and probability of each ``text, declared, host, suffix``, by the formulas, in one process."""
    names = sorted({d.strip().lower() for _, d, _, _ in rows if d and d.strip()})
    table = np.zeros((len(names), language.TRIPLES))
    for text, declared, _, _ in rows:
        if declared and declared.strip():
            table[names.index(declared.strip().lower())] += np.bincount(language.triples(text), minlength=language.TRIPLES)
    logs = np.log((table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True))
    domain = lambda h: ".".join((h or "").split(".")[-2:])
    read, hosts, domains, corpus = [], {}, {}, np.zeros(len(names))
    for text, _, host, _ in rows:
        t = language.triples(text)
        row = logs @ np.bincount(t, minlength=language.TRIPLES) * min(len(t), language.EFFECTIVE) / len(t) if len(t) else np.zeros(len(names))
        best = int(np.argmax(row)) if len(t) else None
        read.append((row, best))
        if best is not None:
            for counts, key in ((hosts, host), (domains, domain(host))):
                counts.setdefault(key, np.zeros(len(names)))[best] += 1
            corpus[best] += 1
    out = []
    for (row, best), (_, declared, host, suffix) in zip(read, rows, strict=True):
        prior, weight = np.full(len(names), 1 / len(names)), 1.0
        if host in hosts:
            near = domains[domain(host)]
            up = (near + language.DOMAIN_SMOOTHING * (corpus + 1) / (corpus.sum() + len(names))) / (near.sum() + language.DOMAIN_SMOOTHING)
            weight = hosts[host].sum() + language.HOST_SMOOTHING
            prior = (hosts[host] + language.HOST_SMOOTHING * up) / weight
        mine = prior * weight
        if best is not None:
            mine[best] -= 1
        score = row + np.log(np.maximum(1e-6, mine))
        for said, chance in ((declared, language.DECLARED), (suffix, language.SUFFIX)):
            if said and said.strip().lower() in names:
                score += np.where(np.arange(len(names)) == names.index(said.strip().lower()), np.log(chance), np.log((1 - chance) / (len(names) - 1)))
        out.append((names[int(np.argmax(score))], 1 / np.exp(score - score.max()).sum(), best is not None))
    return out


def test_languages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(120).collect()
    hosts = ["a.example.com", "b.example.com", "example.org", "x", None]
    rows = [(d.text[: 40 + 37 * i % 900], [d.lang, None, "en", " ", d.lang.upper()][i % 5], hosts[i % 4 if i % 11 else 4], ["de", None, "zz"][i % 3]) for i, d in enumerate(docs)]
    rows += [(None, "fr", "x", None), ("", None, None, "de"), ("12 -- 34", "en", "b.example.com", "en"), ("word", None, "new.host", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, lang string, source string, suffix string")
    out = {r.id: r for r in language.identify(df, suffix="suffix").collect()}
    for i, (name, chance, letters) in enumerate(brute_languages(rows)):
        assert (out[i].language, out[i].keep) == (name, letters and chance >= 0.5) and abs(out[i].language_probability - chance) < 1e-6


def test_training_over_tables_is_training_over_arrays(spark, folder):
    """What tasks add up gives the model that one process gives."""
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs.repartition(5), labels, rounds=2)
    rows = [(r.doc_id, np.concatenate([quality.text_view(r.text.encode()), quality.meta_view(r.text.encode(), r.lang, r.source)]).astype(np.float32).astype(float)) for r in docs.collect()]
    truth = {r.doc_id: float(r.quality) for r in labels.collect()}
    known = sorted((r for r in rows if r[0] in truth), key=lambda r: (zlib.crc32(b"%d" % r[0]), r[0]))
    x, pool = np.stack([v for _, v in known]), np.stack([v for i, v in rows if i not in truth])
    own = quality.co_train((x[:, : quality.TEXT], x[:, quality.TEXT :]), np.array([truth[i] for i, _ in known]), (pool[:, : quality.TEXT], pool[:, quality.TEXT :]), rounds=2)
    whole = np.stack([v for _, v in rows])
    for a, b in zip(model.scores(whole[:, : quality.TEXT], whole[:, quality.TEXT :]), own.scores(whole[:, : quality.TEXT], whole[:, quality.TEXT :]), strict=True):
        assert np.abs(a - b).max() < 1e-3


def test_rare_languages_are_candidates(spark):
    rare = ["minä juon kahvia ja syön pullaa kotona", "hän lukee kirjaa ja kuuntelee musiikkia illalla", "tämä talo on vanha mutta hyvin kaunis"]
    rows = [(i, f"the cat and the dog number {i} are in the garden", "en") for i in range(2000)] + [(i, f"der hund und die katze {i} sind nicht im garten", "de") for i in range(2000, 4000)]
    rows += [(4000 + i, t, "fi") for i, t in enumerate(rare)] + [(4003, "minä luen kirjaa kotona illalla", None), (4004, "the cat and the dog are in the garden", " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.concat(F.lit("host"), F.col("doc_id") % 7))
    out = language.identify(docs).where("doc_id >= 4000 OR language NOT IN ('en', 'de') OR NOT keep").orderBy("doc_id").collect()
    assert [(r.doc_id, r.language, r.keep) for r in out] == [(4000, "fi", True), (4001, "fi", True), (4002, "fi", True), (4003, "fi", True), (4004, "en", True)]


def test_pipeline(spark, folder):
    docs, sizes = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), f"test-{name.replace(' ', '-')}")
        assert docs.columns == corpus_pipeline.DOCUMENT
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    packed = corpus_pipeline.run(spark, folder).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_edges(spark, folder):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "some words without an id", "en", "s", 5), (4, "word " * 50_000, "en", None, 5)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, shape)
    scored = quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = corpus_pipeline.quality_classifier(spark, docs, folder)
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in scored.where("keep").select(*docs.columns).collect())
    named = corpus_pipeline.language_id(spark, docs, folder)
    assert named.columns == docs.columns and {r.doc_id for r in named.collect()} == {None, 3, 4} and named.count() == 4
    cut = corpus_pipeline.line_dedup(spark, docs, folder)
    assert cut.columns == docs.columns and cut.count() == 6 and {r.n_chars for r in cut.where("text IS NULL").collect()} == {None}
    one = corpus_pipeline.near_dedup(spark, docs, folder)
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "3", "3", "4", "None"]  # rows of one id are one document
    packed = corpus_pipeline.pack(spark, docs, folder).toPandas()
    assert packed.length.sum() == packed.groupby(["doc_id", "sequence_id", "offset"], dropna=False).length.sum().sum() and packed.doc_id.isna().sum() == 1 and (packed[packed.doc_id < 3].length == 1).all()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_scratch_is_cleared(spark):
    old = corpus_pipeline.materialize(spark.range(2), "old")
    before = corpus_pipeline.scratch(spark)
    kept, gone = (corpus_pipeline.materialize(spark.range(3), name) for name in ("kept", "gone"))
    corpus_pipeline.clear_scratch(spark, kept, since=before)
    assert kept.count() == 3 and old.count() == 2
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist"):
        gone.collect()


def test_page_evidence_by_hand(spark):
    """Markup, address suffix and bare text of pages, as read by eye."""
    rows = [
        ("https://www.site.de/en/start?x=1", '<html lang="de-AT"><head><title>T</title><script>var a = "<b>";</script></head><body>Guten&nbsp;Tag &#228; <b>du</b></body></html>', "T Guten Tag du", "de", "www.site.de", "en"),
        ("http://Example.FR/page", "<HTML class=x LANG='fr'><style>p {}</style><!-- <p>no</p> --><p>Bon\njour</p>", "Bon jour", "fr", "example.fr", "fr"),
        ("http://a.example.com/d/e", "<html><body lang=es>Hola", "Hola", None, "a.example.com", None),
        ("ftp://x.org/es", "<html lang=eng>Hi", "Hi", "eng", "x.org", "es"),
        ("no address", None, "", None, "", None), (None, "", "", None, "", None),
    ]
    df = spark.createDataFrame([(i, r[0], r[1], "clash") for i, r in enumerate(rows)], "page_id long, url string, html string, host string")
    out = {r.page_id: (" ".join(r.text.split()), r.declared, r.host, r.suffix) for r in language.page_evidence(df).collect()}
    assert out == {i: r[2:] for i, r in enumerate(rows)}


def test_very_many_languages_are_an_error_that_names_the_bound(spark):
    df = spark.createDataFrame([(i, "some words here", f"l{i % 9}", "h") for i in range(40)], "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError, match="more than 4 languages"):
        language.identify(df, declared="lang", host="source", table_bytes=4 * 8 * language.TRIPLES)
    assert language.identify(df, declared="lang", host="source", table_bytes=9 * 8 * language.TRIPLES).count() == 40
    assert language.identify(df, declared="lang", host="source", languages=["l1", "l2"]).where("language IN ('l1', 'l2')").count() == 40
