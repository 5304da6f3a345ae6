"""Further operators: classification, evidence, contract rules, answers, knowledge states, scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import embed, values
from ..operators import classify, lexical_index, ranking, retrieval, rules, sets, text
from ..sources import files
from ..sources.shared import new_folder, shared_dir, stored
from .registry import query


@query("c01_classifier")
def _(t):
    model = classify.train(t.documents.where("doc_id % 4 <> 1"), "text", "lang")
    out = classify.ranked(model, t.documents.select("doc_id", "text", "lang"), "text")
    decided = classify.decide(F.col("ranking"), values.enough_text(F.col("text")))
    return out.select("doc_id", "lang", decided.alias("d")).select("doc_id", "lang", "d.label", "d.route")


@query("t20_evidence_location", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'VERIFIED' ELSE 'NOT_FOUND' END AS status, CASE WHEN doc_id % 2 = 0 THEN 1 END AS page FROM documents")
def _(t):
    docs = t.documents
    quote = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("@@@@ #### 0000 ====")
    return docs.select("doc_id", classify.evidence(quote, F.array(F.lit("none"), "text")).alias("e")).select("doc_id", "e.status", "e.page")


@query("f17_full_text_match", "SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z]+'), ['license', 'apache'])")
def _(t):
    return t.documents.where(F.arrays_overlap(F.split(F.lower("text"), "[^a-z]+", -1), F.array(F.lit("license"), F.lit("apache")))).select("doc_id")


@query("l13_contract_rules", """
    SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 3 = 0 THEN ['Liability'] ELSE [] END AS missing, CASE WHEN n_nationkey * 10 > 90 THEN 'FAIL' ELSE 'PASS' END AS notice, CASE WHEN n_nationkey % 2 = 0 THEN 'PASS' ELSE 'WARN' END AS law FROM nation""")
def _(t):
    n = F.col("n_nationkey")
    clause = lambda title, body: F.struct(F.lit(title).alias("title"), body.alias("text"))
    clauses = F.array_compact(F.array(
        clause("Term and Termination", F.concat(F.lit("Either party may end this with "), (n * 10).cast("string"), F.lit(" days written notice."))), F.when(n % 3 != 0, clause("Limitation of Liability", F.lit("None."))),
        clause("Governing Law", F.concat(F.lit("Governed by the laws of the State of "), F.when(n % 2 == 0, "Ohio").otherwise("Texas"), F.lit(".")))))
    wanted = ["Termination", "Liability", "Governing Law"]
    missing = F.array_compact(F.array(*[F.when(text.find_clause(clauses, w).isNull(), F.lit(w)) for w in wanted]))
    notice = rules.notice_period(clauses, F.lit(None).cast("int"), most=90)
    law = rules.approved_law(clauses, ["Ohio"])
    return t.nation.select(n.alias("doc_id"), missing.alias("missing"), notice["outcome"].alias("notice"), law["outcome"].alias("law"))


@query("l00_applicable_rules", "SELECT doc_id, CASE document_type WHEN 'INVOICE' THEN 14 ELSE 5 END AS n FROM files WHERE document_type IS NOT NULL")
def _(t):
    return rules.applicable(t.files.select("doc_id", "document_type"), rules.rule_frame(t.spark), "document_type").groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))


@query("k13_tolerances", "SELECT 0.01::DECIMAL(10,4) AS price_abs, 0::DECIMAL(10,4) AS price_pct, 0::DECIMAL(10,4) AS quantity_abs")
def _(t):
    value = lambda code, name: F.max(F.when(F.col("code") == code, F.col("params")[name])).try_cast("decimal(10,4)")
    found = rules.rule_frame(t.spark).agg(value("INV_PO_UNIT_PRICE", "tolerance_abs").alias("price_abs"), value("INV_PO_UNIT_PRICE", "tolerance_pct").alias("price_pct"), value("INV_PO_QUANTITY", "tolerance").alias("quantity_abs"))
    return found


@query("v03_task_states", """
    SELECT doc_id, CASE WHEN bool_or(state = 'OPEN') THEN 'OPEN' ELSE 'CLEARED' END AS state, min(due_at) FILTER (WHERE state = 'OPEN') AS due_at FROM tasks GROUP BY doc_id""")
def _(t):
    open_ = F.col("state") == "OPEN"
    return t.tasks.groupBy("doc_id").agg(F.when(F.bool_or(open_), "OPEN").otherwise("CLEARED").alias("state"), F.min(F.when(open_, F.col("due_at"))).alias("due_at"))


@query("v05_duplicate_directions", """
    WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS original FROM documents) SELECT doc_id, original AS other, 'copy_of' AS direction FROM c WHERE doc_id <> original UNION ALL SELECT original, doc_id, 'has_copy' FROM c WHERE doc_id <> original""")
def _(t):
    copies = sets.oldest_copy(t.documents.withColumn("sha", F.sha2("text", 256)), "sha", "doc_id", "original").where("doc_id <> original")
    return copies.select("doc_id", F.col("original").alias("other"), F.lit("copy_of").alias("direction")).union(copies.select("original", "doc_id", F.lit("has_copy")))


@query("r11_text_search")
def _(t):
    """Lexical and dense candidates of a question, fused, the best chunk of each document: chunks are analysed once for all questions."""
    question, candidates, least = "apache license version", 60, 0.05
    chunks = stored(text.chunk_documents(t.documents, target=100, most=160, overlap=15).select(F.struct("doc_id", "chunk_index").alias("id"), F.xxhash64("doc_id", "chunk_index").alias("nr"), "content"), "chunks")
    path = new_folder(t.spark, "chunk-index")
    lexical_index.write_index(chunks, ["id"], "content", path)
    index = lexical_index.LexicalIndex(t.spark, path)
    lexical = index.rank({0: index.terms(question)}, k=candidates)
    vectors = stored(chunks.select("nr", "id", embed.embedder(128)("content").alias("embedding")), "chunk-vectors")
    asked = t.spark.createDataFrame([(0, embed.hash_vector(question, 128).tolist())], "query long, q array<double>")
    near = retrieval.nearest(vectors, asked, candidates, "nr").where(F.col("similarity") >= least).join(vectors.select("nr", "id"), "nr")
    dense = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "id")))
    fused = retrieval.fuse(dense, lexical, ["query", "id"]).select("id.doc_id", "id.chunk_index", "score", "place")
    return ranking.top_per_group(fused, ["doc_id"], [F.col("place")], 1)


@query("r12_terms_from_text", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 30 ELSE (doc_id % 60)::INT END AS terms FROM po_header")
def _(t):
    printed = F.concat(F.lit("Payment is due within "), (F.col("doc_id") % 60).cast("string"), F.lit(" days"))
    extracted = F.when(F.col("doc_id") % 3 != 0, F.col("terms"))
    return t.po_header.select("doc_id", F.coalesce(extracted, F.get(text.payment_terms(printed), F.lit(0)).try_cast("int")).alias("terms"))


@query("r13_match_reasons", "SELECT doc_id, list_filter([CASE WHEN total > 100000 THEN 'amount' END, CASE WHEN currency = 'EUR' THEN 'currency' END, CASE WHEN priority = '1-URGENT' THEN 'priority' END], lambda x: x IS NOT NULL) AS reasons FROM po_header")
def _(t):
    c = F.col
    tests = [(c("total") > 100000, "amount"), (c("currency") == "EUR", "currency"), (c("priority") == "1-URGENT", "priority")]
    return t.po_header.select("doc_id", F.array_compact(F.array(*[F.when(x, F.lit(n)) for x, n in tests])).alias("reasons"))


@query("r16_context_assembly", """
    WITH k AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), i AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM k),
    s AS (SELECT conv_id, grp, min(turn) AS first_turn, sum(ceil(length(text) / 4.0)) AS cost FROM i GROUP BY 1, 2), b AS (SELECT *, sum(cost) OVER w AS upto, row_number() OVER w AS nr FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY first_turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT conv_id, 'S' || nr AS label, first_turn FROM b WHERE upto <= 300 OR nr = 1""")
def _(t):
    passages = t.conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    merged = ranking.islands(passages, ["conv_id"], "turn").agg(F.min("turn").alias("first_turn"), F.sum(F.ceil(F.length("text") / 4)).alias("cost"))
    kept = ranking.within_budget(merged, ["conv_id"], ["first_turn"], F.col("cost"), 300)
    label = F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("conv_id").orderBy("first_turn")).cast("string"))
    return kept.select("conv_id", label.alias("label"), "first_turn")


@query("r17_valid_claims", "SELECT conv_id, turn, role, ['S' || (turn % 3)] AS labels FROM conversations WHERE turn % 3 > 0")
def _(t):
    cited = F.array(F.concat(F.lit(" [s"), (F.col("turn") % 3).cast("string"), F.lit("] ")))
    clean = F.transform(cited, lambda c: F.upper(F.btrim(F.trim(c), F.lit("[]"))))
    known = F.array_intersect(clean, F.array(F.lit("S1"), F.lit("S2")))
    return t.conversations.select("conv_id", "turn", "role", known.alias("labels")).where(F.size("labels") > 0)


@query("r20_knowledge_lifecycle", """
    SELECT doc_id, CASE WHEN effective_from > DATE '2025-06-01' THEN 'SCHEDULED' WHEN row_number() OVER (PARTITION BY document_key, effective_from > DATE '2025-06-01' ORDER BY effective_from DESC, doc_id DESC) = 1 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status FROM versions""")
def _(t):
    later = F.col("effective_from") > F.lit("2025-06-01").cast("date")
    place = F.row_number().over(Window.partitionBy("document_key", "later").orderBy(F.desc("effective_from"), F.desc("doc_id")))
    return t.versions.withColumn("later", later).select("doc_id", F.when(F.col("later"), "SCHEDULED").when(place == 1, "ACTIVE").otherwise("SUPERSEDED").alias("status"))


@query("n10_agreement_keys", """
    WITH a AS MATERIALIZED (SELECT doc_id, upper(sku) AS key, unit_price FROM po_lines), b AS MATERIALIZED (SELECT doc_id, upper(sku) AS key, unit_price FROM inv_lines)
    SELECT a.doc_id, a.unit_price = b.unit_price AS agree FROM a JOIN b ON a.doc_id = b.doc_id AND a.key = b.key""")
def _(t):
    b = t.inv_lines.select("doc_id", F.upper("sku").alias("key"), F.col("unit_price").alias("other"))
    joined = t.po_lines.withColumn("key", F.upper("sku")).join(b, ["doc_id", "key"])
    return joined.select("doc_id", (F.col("unit_price").cast("decimal(18,4)") == F.col("other").cast("decimal(18,4)")).alias("agree"))


@query("d05_derived_terms", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN terms ELSE doc_id % 77 END::INT AS terms FROM po_header")
def _(t):
    """Stated terms first, else the days from the issue to the due date, across months and leap years; null without either."""
    kind = F.col("doc_id") % 4
    due = F.when(kind == 0, F.lit(None)).otherwise(F.date_add("doc_date", (F.col("doc_id") % 77).cast("int")))
    return t.po_header.select("doc_id", F.coalesce(F.when(kind == 1, F.col("terms")), F.datediff(due, "doc_date")).alias("terms"))


@query("w10_older_document", "SELECT doc_id, CASE WHEN (doc_date, doc_id) < (DATE '1995-06-01', 700) THEN TRUE ELSE FALSE END AS older FROM po_header")
def _(t):
    mark = F.struct(F.lit("1995-06-01").cast("date").alias("doc_date"), F.lit(700).cast("long").alias("doc_id"))
    return t.po_header.select("doc_id", (F.struct("doc_date", "doc_id") < mark).alias("older"))


@query("q03_expired_leases", "SELECT status, count(*) FILTER (WHERE status = 'RUNNING' AND created_at + INTERVAL 1 HOUR < TIMESTAMP '2024-01-20 00:00:00') AS expired FROM jobs GROUP BY 1")
def _(t):
    expired = (F.col("status") == "RUNNING") & (F.col("created_at") + F.expr("INTERVAL 1 HOUR") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return t.jobs.groupBy("status").agg(F.count_if(expired).alias("expired"))


@query("q06_idempotent_replace", "SELECT department, count(*) AS n FROM jobs GROUP BY 1")
def _(t):
    from ..streaming.jobs import replace_partitions

    path = f"{shared_dir(t.spark)}/replaced-{uuid.uuid4().hex}"
    replace_partitions(t.jobs.select("job_id", "department"), path, "department")
    replace_partitions(t.jobs.where("department = 2").select("job_id", "department"), path, "department")
    return t.spark.read.parquet(path).groupBy("department").agg(F.count("*").alias("n"))


@query("z07_statement_validation", r"SELECT doc_id, len(list_filter(regexp_extract_all(split_part(text, chr(10), 1), '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(substr(text, length(split_part(text, chr(10), 1)) + 1), '[0-9]+'), x))) = 0 AS supported FROM documents")
def _(t):
    """Numbers of the first line that the rest of the text has, too."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit("([0-9]+)"))
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return t.documents.select("doc_id", sets.subset(numbers(first), numbers(F.substr("text", F.length(first) + 1))).alias("supported"))


@query("z09_vendor_confirmation", "SELECT doc_id, CASE WHEN vendor_id IN (SELECT vendor_id FROM vendors) THEN 1.0 ELSE 0.9 END::DOUBLE AS anchor FROM inv_header")
def _(t):
    known = t.vendors.select("vendor_id", F.lit(1.0).alias("raised"))
    return t.inv_header.join(known, "vendor_id", "left").select("doc_id", F.coalesce("raised", F.lit(0.9)).alias("anchor"))


@query("z11_ordered_pages", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7 ORDER BY turn")
def _(t):
    return t.conversations.where("conv_id = 7").orderBy("turn").select("conv_id", "turn", "role")


@query("z16_change_scores", "SELECT 'MODIFIED' AS change, count(*) AS tp, 0 AS fp, 0 AS fn FROM benchmark")
def _(t):
    pairs = t.benchmark.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("1. Term\n"), "text", F.lit("\n2. Payment\nNet 30 days.")).alias("old_text"), F.concat(F.lit("1. Term\n"), "text", F.lit(" More.\n2. Payment\nNet 30 days.")).alias("new_text"))
    found = text.diff_versions(pairs).where("change <> 'UNCHANGED'").groupBy("doc_id", "change").agg(F.count("*").alias("n"))
    truth = t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit("MODIFIED").alias("change"), F.lit(1).alias("m"))
    both = truth.join(found, ["doc_id", "change"], "full").fillna(0, ["n", "m"])
    return both.groupBy("change").agg(F.sum(F.least("n", "m")).alias("tp"), F.sum(F.greatest(F.lit(0), F.col("n") - F.col("m"))).alias("fp"), F.sum(F.greatest(F.lit(0), F.col("m") - F.col("n"))).alias("fn"))


@query("z17_recognition_scores", "SELECT item_id % 3 AS degradation, round(avg(levenshtein(a, replace(a, 'e', 'c')) / length(a)), 9) AS cer FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '?', 'g') AS a FROM benchmark) GROUP BY 1")
def _(t):
    ref = F.regexp_replace("text", "[^ -~]", "?")
    cer = F.levenshtein(ref, F.replace(ref, F.lit("e"), F.lit("c"))) / F.length(ref)
    return t.benchmark.groupBy((F.col("item_id") % 3).alias("degradation")).agg(F.round(F.avg(cer), 9).alias("cer"))


@query("z20_search_set_scores", """
    WITH w AS (SELECT l_returnflag AS family, l_orderkey AS doc FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2), f AS (SELECT l_returnflag AS family, l_orderkey AS doc FROM lineitem WHERE l_quantity > 44 GROUP BY 1, 2)
    SELECT coalesce(w.family, f.family) AS family, round(count(*) FILTER (WHERE w.doc IS NOT NULL AND f.doc IS NOT NULL) / count(f.doc), 9) AS precision, round(count(*) FILTER (WHERE w.doc IS NOT NULL AND f.doc IS NOT NULL) / count(w.doc), 9) AS recall FROM w FULL JOIN f ON w.family = f.family AND w.doc = f.doc GROUP BY 1""")
def _(t):
    side = lambda q, name: t.lineitem.where(F.col("l_quantity") > q).select(F.col("l_returnflag").alias("family"), F.col("l_orderkey").alias("doc")).distinct().withColumn(name, F.lit(1))
    both = side(45, "w").join(side(44, "f"), ["family", "doc"], "full")
    hit = F.count_if(F.col("w").isNotNull() & F.col("f").isNotNull())
    return both.groupBy("family").agg(F.round(hit / F.count("f"), 9).alias("precision"), F.round(hit / F.count("w"), 9).alias("recall"))


@query("s09_recognised_words", "SELECT count(*) AS n FROM nation WHERE n_nationkey % 2 = 0")
def _(t):
    path = f"{shared_dir(t.spark)}/words-{uuid.uuid4().hex}"
    cells = [F.when(F.col("n_nationkey") % 2 == 0, "5").otherwise("4").alias("level"), F.lit("1").alias("page_num"), *[F.lit("10").alias(c) for c in ("left", "top", "width", "height")], F.lit("91.5").alias("conf"), F.col("n_name").alias("text")]
    t.nation.select(*cells).write.option("sep", "\t").option("header", True).csv(path)
    return files.recognised_words(t.spark, path).agg(F.count("*").alias("n"))


@query("s12_text_units")
def _(t):
    return text.chunk_documents(t.benchmark, id="item_id", title=None, target=40, most=80, overlap=10)


@query("t18_stems_and_weights", """
    SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN TRUE ELSE FALSE END AS same FROM nation""")
def _(t):
    pairs = [("tolerance", "tolerances"), ("payment", "payments"), ("invoice", "order"), ("approved", "approve"), ("policy", "police")]
    same = F.udf(lambda a, b: embed.stem(a) == embed.stem(b), "boolean", useArrow=True)
    word = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return t.nation.select("n_nationkey", same(word(0), word(1)).alias("same"))


@query("r03_lexical_order", """
    WITH q AS (SELECT unnest(['the', 'of', 'version']) AS term), d AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')) AS words FROM documents),
    w AS (SELECT term, ln(((SELECT count(*) FROM d) + 1) / ((SELECT count(*) FROM d WHERE list_contains(words, term)) + 0.5)) AS idf FROM q),
    s AS (SELECT doc_id, round(sum(CASE WHEN list_contains(words, term) THEN idf ELSE 0 END) / sum(idf), 6) AS coverage FROM d, w GROUP BY doc_id)
    SELECT doc_id, coverage FROM s ORDER BY coverage DESC, doc_id LIMIT 30""")
def _(t):
    words = t.documents.select("doc_id", F.array_distinct(F.split(F.lower("text"), "[^a-z]+", -1)).alias("words"))
    covered = retrieval.term_coverage(words, "doc_id", "words", ["the", "of", "version"]).select("doc_id", F.round("coverage", 6).alias("coverage"))
    return covered.orderBy(F.desc("coverage"), "doc_id").limit(30)
