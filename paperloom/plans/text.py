"""Text operators: units, chunks, clauses, sensitivity, grounding, retrieval and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import embed
from ..operators import editing, lexical_index, retrieval, search, text, vector_index
from ..sources.shared import new_folder, stored
from .registry import query


@query("t02_sentences", "SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?;:])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s) <> '')) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(F.filter(F.split("text", text.SENTENCE), lambda s: F.trim(s) != "")).alias("n"))


@query("t06_chunks")
def _(t):
    return text.chunk_documents(t.documents)


@query("t06_markdown_chunks")
def _(t):
    page = F.concat(F.lit("---\ntitle: Policy\n---\n# Policy\n\n## 1 Scope\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n## Part\n\n")))
    return text.chunk_documents(t.documents.withColumn("text", page), markdown=True, target=100, most=160, overlap=15)


@query("t07_window_chunks", """
    SELECT doc_id, i AS chunk, substr(text, i * 1700 + 1, 2000) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 300) / 1700)::INT))) AS i FROM documents)""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(text.window_chunks(F.col("text"))).alias("chunk", "content"))


@query("t09_clauses_and_changes")
def _(t):
    pairs = t.benchmark.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("Agreement\n1. Term\n"), "text", F.lit("\n2. Payment\nNet 30 days.\n3. Liability\nNone.")).alias("old_text"),
        F.concat(F.lit("Agreement\n1. Term\n"), "text", F.lit(" More.\n2. Notice\nNinety days.\n3. Payment\nNet 30 days.\nIn witness whereof")).alias("new_text"))
    return text.diff_versions(pairs)


@query("t11_change_summary", "SELECT change, n FROM (VALUES ('UNCHANGED', 2), ('MODIFIED', 1), ('ADDED', 1), ('REMOVED', 1)) v(change, k), LATERAL (SELECT count(*) * k AS n FROM benchmark)")
def _(t):
    pairs = t.benchmark.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("Agreement\n1. Term\n"), "text", F.lit("\n2. Payment\nNet 30 days.\n3. Liability\nNone whatsoever.")).alias("old_text"),
        F.concat(F.lit("Agreement\n1. Term\n"), "text", F.lit(" More.\n2. Scope of works\nQuarterly shipments.\n3. Payment\nNet 30 days.")).alias("new_text"))
    return text.diff_versions(pairs).groupBy("change").agg(F.count("*").alias("n"))


@query("t12_find_clause", """
    SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'Limitation of Liability' WHEN 1 THEN 'LIABILITY: limits' END AS title FROM orders""")
def _(t):
    """The first clause whose title has every word, in any order and case; part of a word is none."""
    clause = lambda n: F.struct(n.alias("title"), F.lit("-").alias("text"))
    title = F.element_at(F.array(*map(F.lit, ["Limitation of Liability", "LIABILITY: limits", "Liabilities", "Limited"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    clauses = F.array(clause(F.lit("Term")), clause(title), clause(F.when(F.col("o_orderkey") % 4 < 2, "Liability").otherwise("")))
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), text.find_clause(clauses, "liability")["title"].alias("title"))


@query("t13_notice_days", "SELECT event_id, greatest(user_id, 30) AS days FROM events")
def _(t):
    printed = F.concat(F.lit("Either party may terminate with thirty (30) days written notice, or a notice period of at least "), F.col("user_id").cast("string"), F.lit(" days."))
    return t.events.select("event_id", text.notice_days(printed).cast("long").alias("days"))


@query("t14_governing_law", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'New Nation' || n_nationkey ELSE 'Ohio' END AS place FROM nation")
def _(t):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("New Nation"), F.col("n_nationkey").cast("string"))).otherwise("Ohio")
    return t.nation.select("n_nationkey", text.governing_law(F.concat(F.lit("This contract is governed by the laws of the State of "), name, F.lit(", without regard to conflicts."))).alias("place"))


@query("t15_sensitivity", r"""
    SELECT doc_id, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+')) AS emails FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.sensitivity(F.col("text")).alias("s")).select("doc_id", "s.emails")


@query("t15_sensitivity_levels")
def _(t):
    return t.documents.select("doc_id", text.sensitivity(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("t16_payment_terms", """
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN [user_id] WHEN 1 THEN [user_id] WHEN 2 THEN [user_id, 7] WHEN 3 THEN [user_id] WHEN 4 THEN [] WHEN 5 THEN [user_id] ELSE [] END::BIGINT[] AS days FROM events""")
def _(t):
    """Terms in prose: several, none, too far from their words, and no text at all."""
    n = F.col("user_id").cast("string")
    printed = F.element_at(F.array(
        F.concat(F.lit("Net "), n), F.concat(F.lit("Payment is due within "), n, F.lit(" calendar days")), F.concat(F.lit("net "), n, F.lit(", late ones due in 7 days")), F.concat(F.lit("Terms: "), n),
        F.concat(n, F.lit(" days")), F.concat(F.lit("PAYABLE, unless agreed, in "), n, F.lit(" days.")), F.concat(F.lit("Payment follows the custom of the trade and of the port, "), n, F.lit(" days")), F.lit("")), (F.col("event_id") % 8 + 1).cast("int"))
    return t.events.select("event_id", F.transform(text.payment_terms(printed), lambda d: d.cast("long")).alias("days"))


STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query("t17_lexical_tokens", rf"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda w: w <> '' AND w NOT IN ({STOP}))) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(text.lexical_tokens(F.col("text"))).alias("n"))


@query("t19_grounding")
def _(t):
    return t.documents.select("doc_id", text.grounding(F.expr("substring(text, length(text) div 2 + 1)"), F.expr("left(text, length(text) div 2)")).alias("g")).select("doc_id", "g.grounded", F.round("g.score", 6).alias("score"))


# ------------------------------------------------------------------------------ retrieval

NORM = "sqrt(list_inner_product({0}, {0}))"
COS = "list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v)))"


def _vector_queries(t):
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


@query("r01_dense_top_k", f"""
    WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
    SELECT q.vec_id AS query, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 12) DESC, e.vec_id) AS rank FROM x e, x q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10""")
def _(t):
    return retrieval.nearest(t.embeddings.select("vec_id", "embedding"), _vector_queries(t), 10, "vec_id").select("query", "vec_id", "rank")


def _indexed(t, keep=None):
    """The vectors of the table, indexed anew in the shared folder."""
    path = new_folder(t.spark, "vector-index")
    vector_index.write_index(t.embeddings, vector_index.fit_cells(t.embeddings, "embedding"), path, "vec_id", "embedding", keep)
    return path


@query("r01_indexed_top_k")
def _(t):
    """Top 10 of every 20th vector through the index: approximate, see r01_index_recall."""
    return vector_index.search(t.spark, _indexed(t), _vector_queries(t), 10).select("query", F.col("id").alias("vec_id"), "rank", F.round("similarity", 9).alias("similarity"))


@query("r01_filtered_top_k", """
    WITH n AS (SELECT count(*) FILTER (WHERE label = 3) AS n FROM embeddings) SELECT q.vec_id AS query, least(10, n) AS found, true AS pass FROM embeddings q, n WHERE q.vec_id % 20 = 0 AND n > 0""")
def _(t):
    """Under a filter the scan goes on, until ten rows remain or all cells are seen; all found rows pass the filter."""
    found = vector_index.search(t.spark, _indexed(t, ["label"]), _vector_queries(t), 10, where=F.col("label") == 3)
    labels = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    return found.join(labels, "id").groupBy("query").agg(F.count("*").alias("found"), F.bool_and(F.col("label") == 3).alias("pass"))


@query("r01_index_recall")
def _(t):
    """Recall at 10 against all rows, and the share of rows that the queries read."""
    path = _indexed(t)
    found = vector_index.search(t.spark, path, _vector_queries(t), 10)
    exact = retrieval.nearest(t.embeddings.select("vec_id", "embedding"), _vector_queries(t), 10, "vec_id").select("query", F.col("vec_id").alias("id"), F.lit(1).alias("hit"))
    cells = vector_index.open_cells(t.spark, path)
    share = found.groupBy("query").agg(F.max("cells").alias("cells")).agg(F.avg(F.col("cells") / len(cells.centroids)).alias("cells_read"))
    recall = exact.join(found.select("query", "id", F.lit(1).alias("seen")), ["query", "id"], "left").agg(F.avg(F.coalesce("seen", F.lit(0))).alias("recall"), F.count("*").alias("wanted"))
    return recall.crossJoin(F.broadcast(share))  # a row each


#: How many candidates each ranking passes on, as a knowledge search asks for.
CANDIDATES = 20


def _lexical(t, stemmed=True):
    """The documents' index, written anew in the shared folder; many questions would share it."""
    path = new_folder(t.spark, "lexical-index")
    lexical_index.write_index(t.documents, ["doc_id"], "text", path, stemmed=stemmed)
    return lexical_index.LexicalIndex(t.spark, path)


@query("f17_indexed_match", "SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z]+'), ['license', 'apache'])")
def _(t):
    return _lexical(t, stemmed=False).match(["license", "apache"])


@query("r02_cover_density")
def _(t):
    """The 60 densest documents of three terms, from the positions in the index."""
    index = _lexical(t)
    return index.rank({0: index.terms("the version license")}, k=60).select("doc_id", "density")


@query("r02_two_terms", """
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS spot, unnest(w) AS term FROM w), m AS (SELECT * FROM p WHERE term IN ('version', 'license')),
    n AS (SELECT *, count(DISTINCT term) OVER (PARTITION BY doc_id) AS held, max(CASE WHEN term = 'version' THEN spot END) OVER o AS v, max(CASE WHEN term = 'license' THEN spot END) OVER o AS l FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY spot)),
    c AS (SELECT doc_id, spot, CASE WHEN held = 1 THEN spot ELSE least(v, l) END AS start FROM n WHERE held = 1 OR (v IS NOT NULL AND l IS NOT NULL)),
    d AS (SELECT doc_id, start, min(spot) AS spot FROM c GROUP BY 1, 2), s AS (SELECT doc_id, sum(1.0::DOUBLE / (spot - start + 1)) AS x FROM d GROUP BY 1)
    SELECT doc_id, round(x / (x + 1), 9) AS density FROM s ORDER BY x / (x + 1) DESC, doc_id LIMIT 60""")
def _(t):
    """Cover density of two plain words: each start of a span that holds both counts once, with its shortest span."""
    return _lexical(t, stemmed=False).rank({0: ["version", "license"]}, k=60).select("doc_id", F.round("density", 9).alias("density"))


@query("r04_indexed_weights", "SELECT term, round(ln((n + 1) / (df + 0.5)), 9) AS idf FROM (SELECT unnest(['the', 'license', 'zzz']) AS term) q, LATERAL (SELECT count(*) AS n, count(*) FILTER (WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z]+'), term)) AS df FROM documents)")
def _(t):
    return _lexical(t, stemmed=False).weights(["the", "license", "zzz"]).select("term", F.round("idf", 9).alias("idf"))


@query("r04_term_weights", "SELECT term, round(ln((n + 1) / (df + 0.5)), 9) AS idf FROM (SELECT unnest(['the', 'license', 'zzz']) AS term) q, LATERAL (SELECT count(*) AS n, count(*) FILTER (WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z]+'), term)) AS df FROM documents)")
def _(t):
    words = t.documents.select(F.split(F.lower("text"), "[^a-z]+", -1).alias("words"))
    return retrieval.term_weights(words, "words", ["the", "license", "zzz"]).select("term", F.round("idf", 9).alias("idf"))


@query("r05_rank_fusion", """
    WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 60), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 97, doc_id) AS rank FROM documents QUALIFY rank <= 60),
    f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS ra, b.rank AS rb, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score FROM a FULL JOIN b USING (doc_id))
    SELECT doc_id, round(score, 12) AS score, row_number() OVER (ORDER BY score DESC, least(coalesce(ra, 1e9), coalesce(rb, 1e9)), coalesce(ra, 1e9), coalesce(rb, 1e9), doc_id) AS place FROM f QUALIFY place <= 20""")
def _(t):
    top = lambda *order: t.documents.orderBy(*order).limit(60).select(F.lit(0).alias("q"), "doc_id", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    fused = retrieval.fuse(top(F.desc("n_chars"), F.asc("doc_id")), top(F.col("doc_id") % 97, F.col("doc_id")), ["q", "doc_id"])
    return fused.where("place <= 20").select("doc_id", F.round("score", 12).alias("score"), "place")


@query("r06_evidence_gate", "SELECT label AS query, max(vec_id % 40 / 100.0) >= 0.25 OR max(vec_id % 60 / 100.0) >= 0.5 AS answerable FROM embeddings GROUP BY label")
def _(t):
    top = t.embeddings.select(F.col("label").alias("query"), (F.col("vec_id") % 40 / 100.0).alias("c"), (F.col("vec_id") % 60 / 100.0).alias("s"))
    return retrieval.evidence_gate(top, "query", "c", "s")


@query("r07_hybrid_retrieval")
def _(t):
    """Dense and lexical candidates of a question over all documents, fused: vectors and postings are made once for all questions."""
    question = "license version terms of the product"
    index = _lexical(t)
    vectors = stored(t.documents.select("doc_id", embed.embedder(256)("text").alias("embedding")), "text-vectors")
    asked = t.spark.createDataFrame([(0, embed.hash_vector(question, 256).tolist())], "query long, q array<double>")
    dense, lexical = retrieval.nearest(vectors, asked, CANDIDATES, "doc_id"), index.rank({0: index.terms(question)}, k=CANDIDATES)
    return retrieval.fuse(dense, lexical, ["query", "doc_id"]).where("place <= 10").select("doc_id", "score", "place")


@query("r08_hash_embeddings")
def _(t):
    return t.benchmark.select("item_id", embed.embedder()("text").alias("embedding"))


#: What is asked of every order, by its key: the sentence, and what it has to mean.
MONTH = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"
ASKED = f"""
    SELECT o_orderkey AS id, o_orderkey % 12 AS kind, CAST(o_custkey AS VARCHAR) AS v, CAST(o_orderkey % 900 + 1 AS VARCHAR) AS n, CAST(o_orderkey % 90 + 10 AS VARCHAR) AS d,
        CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders"""
SENTENCES = """CASE kind
    WHEN 0 THEN concat('find all invoices from Vendor Kestrel ', v) WHEN 1 THEN concat('Show me purchase orders over $', n, ',000 in {month} ', y, ' mentioning steel pipes')
    WHEN 2 THEN concat('documents with payment terms longer  than ', d, ' days') WHEN 3 THEN concat('contracts from Harbor and Pine ', v, ' containing termination clauses')
    WHEN 4 THEN concat('delivery notes between ', day, ' and ', day) WHEN 5 THEN concat('receipts after ', day, ' under ', n, '.50 eur') WHEN 6 THEN concat('invoices before ', day, ' net ', d)
    WHEN 7 THEN concat('agreements since 2026-02-30 up to ', n, 'k') WHEN 8 THEN concat('bank statements by "Acme & Co ', v, '" during ', y)
    WHEN 9 THEN concat('résumés with at least ', d, ' percent match') WHEN 10 THEN concat('payment terms of at least ', d, ' calendar days for insurance policies') ELSE concat('the goods of order ', id) END"""


@query("r09_search_grammar", f"""
    WITH a AS ({ASKED})
    SELECT id, CASE kind WHEN 0 THEN 'INVOICE' WHEN 1 THEN 'PURCHASE_ORDER' WHEN 3 THEN 'CONTRACT' WHEN 4 THEN 'DELIVERY_NOTE' WHEN 5 THEN 'RECEIPT' WHEN 6 THEN 'INVOICE' WHEN 7 THEN 'CONTRACT' WHEN 8 THEN 'BANK_STATEMENT' WHEN 9 THEN 'RESUME' WHEN 10 THEN 'POLICY' ELSE '' END AS types,
        CASE kind WHEN 0 THEN 'Kestrel ' || v WHEN 3 THEN 'Harbor and Pine ' || v WHEN 8 THEN 'Acme & Co ' || v END AS vendor,
        CASE kind WHEN 1 THEN 'gt' WHEN 5 THEN 'lt' WHEN 7 THEN 'lte' END AS amount_op, CASE kind WHEN 1 THEN n::DOUBLE * 1000 WHEN 5 THEN n::DOUBLE + 0.5 WHEN 7 THEN n::DOUBLE * 1000 END AS amount,
        CASE kind WHEN 2 THEN 'gt' WHEN 6 THEN 'eq' WHEN 10 THEN 'gte' END AS terms_op, CASE WHEN kind IN (2, 6, 10) THEN d::BIGINT END AS terms,
        CASE kind WHEN 1 THEN make_date(y, m, 1) WHEN 4 THEN day WHEN 5 THEN day + 1 WHEN 8 THEN make_date(y, 1, 1) END AS since,
        CASE kind WHEN 1 THEN last_day(day) WHEN 4 THEN day WHEN 6 THEN day - 1 WHEN 8 THEN make_date(y, 12, 31) END AS until,
        CASE kind WHEN 1 THEN 'steel pipes' WHEN 3 THEN 'termination clauses' WHEN 7 THEN 'since 2026-02-30' WHEN 9 THEN 'at least ' || d || ' percent match' WHEN 11 THEN 'goods order ' || id ELSE '' END AS text
    FROM a""")
def _(t):
    """A sentence an order, in twelve forms: vendors, periods with odd spaces, bounds, dates that do not exist."""
    names = F.array(*[F.lit(m) for m in search.MONTHS])
    key = F.col("o_orderkey")
    asked = t.orders.select(key.alias("id"), (key % 12).alias("kind"), F.col("o_custkey").alias("v"), (key % 900 + 1).alias("n"), (key % 90 + 10).alias("d"), F.col("o_orderdate").cast("date").alias("day"), F.year("o_orderdate").alias("y"), F.initcap(F.element_at(names, F.month("o_orderdate"))).alias("month"))
    said = F.expr(SENTENCES.replace("'{month} '", "").replace("000 in {month} ', y", "000 in ', month, ' ', y"))
    # Short rows that take long to read: dealt out anew, as few splits hold them all.
    asked = asked.select("id", said.alias("said")).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    shape = "types string, vendor string, amount_op string, amount double, terms_op string, terms long, since date, until date, text string"

    def read(sentence: str) -> tuple:
        p = search.parse(sentence)
        return ",".join(p.types), p.vendor, *(p.amount or (None, None)), *(p.terms or (None, None)), p.since, p.until, p.text

    return asked.select("id", F.udf(read, f"struct<{shape.replace(' ', ':').replace(',:', ',')}>", useArrow=True)("said").alias("p")).select("id", "p.*")


@query("r10_structured_search", "SELECT doc_id, doc_date FROM po_header WHERE total > 150000 AND doc_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' ORDER BY doc_date DESC, doc_id LIMIT 100")
def _(t):
    asked = search.parse("purchase orders over 150k in 1996")
    docs = t.po_header.withColumn("document_type", F.lit("PURCHASE_ORDER"))
    return search.structured(docs, asked).limit(100).select("doc_id", "doc_date")


@query("r14_vendor_phrase", "SELECT vendor_id FROM vendors WHERE name ILIKE '%sons 7%'")
def _(t):
    return t.vendors.where(F.contains(F.lower("name"), F.lit("sons 7"))).select("vendor_id")


@query("r19_error_rates", "SELECT item_id, round(levenshtein(a, replace(replace(a, 'th', 't'), 'e', '3')) / length(a), 9) AS cer FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '?', 'g') AS a FROM benchmark)")
def _(t):
    ref = F.regexp_replace("text", "[^ -~]", "?")
    hyp = F.replace(F.replace(ref, F.lit("th"), F.lit("t")), F.lit("e"), F.lit("3"))
    return t.benchmark.select("item_id", F.round(F.levenshtein(ref, hyp) / F.length(ref), 9).alias("cer"))


@query("r19_word_error_rates", r"""
    WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS n FROM documents)
    SELECT doc_id, n AS words, n // 10 AS edits, round(CASE WHEN n > 0 THEN (n // 10) / n ELSE 0 END, 9) AS rate FROM w""")
def _(t):
    """Whole documents against readings that miss every tenth word: as many edits as words are missing, whatever else they are."""
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+", -1), lambda w: w != "")
    read = F.array_join(F.filter(words, lambda w, i: i % 10 != 9), " ")
    return t.documents.select("doc_id", editing.word_errors("text", read).alias("e")).select("doc_id", F.col("e.words").alias("words"), F.col("e.edits").alias("edits"), F.round("e.rate", 9).alias("rate"))
