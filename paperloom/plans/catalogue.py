"""Single steps of larger operators, each as a query of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from ..operators import classify, matching, metrics, retrieval, rules, text, tools
from ..sources import synthetic
from ..sources.shared import new_folder, shared_dir, stored
from ..streaming import maintenance
from .matching import _items
from .registry import query

# -------------------------------------------------------------------------------- storage


@query("s02_object_store", "SELECT n_nationkey AS key, n_name AS content, length(n_name)::BIGINT AS size FROM nation WHERE n_nationkey % 5 <> 3")
def _(t):
    """Objects put, listed and read by key on any file system that Spark reaches; a fifth of them is removed again."""
    path = f"{shared_dir(t.spark)}/objects-{uuid.uuid4().hex}"
    objects = t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("content"))
    objects.repartition("key").write.partitionBy("key").text(path)
    kept = t.spark.read.format("binaryFile").load(path).where("key % 5 <> 3")
    return kept.select(F.col("key").cast("long").alias("key"), F.rtrim(F.decode("content", "utf-8"), F.lit("\n")).alias("content"), (F.col("length") - 1).alias("size"))


def generated(t, seed=42):
    """Families of every order, written once: ``lines`` of all documents, ``headers`` of the invoices."""
    lines = stored(synthetic.families(t.spark, t.orders, seed, "o_custkey", "o_orderdate"), "families").withColumn("confidence", F.lit(0.98))
    invoices = lines.where("kind = 'INVOICE'")
    headers = invoices.groupBy("doc_id", "number", F.col("o_custkey").alias("vendor_id"), F.col("o_orderdate").cast("date").alias("doc_date")).agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("total"))
    return lines, headers.withColumn("currency", F.lit("USD"))


def found_defects(lines, headers):
    """``order, found``: what the comparison of lines and the search for duplicates see, without a look at what was planted."""
    of = lambda kind: lines.where(F.col("kind") == kind).where("doc_id >= 0").select("doc_id", "sku", "quantity", "unit_price", "confidence")
    items = matching.compare_lines(of("INVOICE"), of("PURCHASE_ORDER"), of("DELIVERY_NOTE"))
    seen = lambda check, status, name: items.where((F.col("check") == check) & (F.col("status") == status)).select(F.col("doc_id").alias("order"), F.lit(name).alias("found"))
    parts = [seen("unit_price", "MISMATCH", "price_changed"), seen("quantity_ordered", "MISMATCH", "quantity_raised"), seen("quantity_delivered", "MISMATCH", "short_delivery"), seen("line_on_order", "MISSING", "foreign_line")]
    copies = matching.strongest(headers).where("strong")
    copies = copies.select(F.greatest("doc_id", -F.col("doc_id") - 1).alias("order"), F.lit("duplicate_invoice").alias("found"))  # the copy of order n is -n - 1
    for part in parts:
        copies = copies.unionByName(part)
    return copies.distinct()


@query("s19_generated_defects")
def _(t):
    """Defects of generated families found again by the three-way comparison and the search for duplicates: what was planted, what was found, how often."""
    lines, headers = generated(t)
    planted = lines.select(F.col("o_orderkey").alias("order"), "scenario").distinct()
    found = found_defects(lines, headers)
    return planted.join(found, "order", "left").groupBy("scenario", F.coalesce("found", F.lit("clean")).alias("found")).agg(F.count("*").alias("n"))


@query("s19_planted_differences", """
    SELECT 'duplicate_number' AS scenario, count(*) FILTER (WHERE o_orderkey % 31 = 0) AS n FROM orders UNION ALL SELECT 'no_order', count(*) FILTER (WHERE o_orderkey % 37 = 0) FROM orders
    UNION ALL SELECT 'other_vendor', count(*) FILTER (WHERE o_orderkey % 41 = 0) FROM orders UNION ALL SELECT 'long_terms', count(*) FILTER (WHERE o_orderkey % 43 = 0) FROM orders""")
def _(t):
    """The differences that the invoices were given, found by comparing them with their orders."""
    i = t.inv_header.select("doc_id", F.col("number").alias("i_number"), "po_number", F.col("vendor_id").alias("i_vendor"), F.col("terms").alias("i_terms"))
    both = i.join(t.po_header.select("doc_id", "vendor_id", "terms"), "doc_id")
    found = {
        "duplicate_number": F.col("i_number") != F.concat(F.lit("INV-"), F.col("doc_id").cast("string")), "no_order": F.col("po_number").isNull(),
        "other_vendor": F.col("i_vendor") != F.col("vendor_id"), "long_terms": F.col("i_terms") > F.col("terms"),
    }
    counts = both.agg(*[F.count_if(c).alias(n) for n, c in found.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(n).alias("n")) for n in found])))


# ------------------------------------------------------------------------- classification


@query("c02_ranked_probabilities", "SELECT doc_id, (SELECT count(DISTINCT lang) FROM documents)::INT AS labels, TRUE AS ranked, 1.0::DOUBLE AS total FROM documents")
def _(t):
    model = classify.train(t.documents, "text", "lang")
    out = classify.ranked(model, t.documents.select("doc_id", "text"), "text")
    p = F.transform("ranking", lambda r: r["p"])
    falling = F.forall(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.get(p, i - 1) >= F.get(p, i))
    return out.select("doc_id", F.size("ranking").alias("labels"), falling.alias("ranked"), F.round(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), 9).alias("total"))


@query("c03_two_stage_decisions", """
    SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN label END AS label, CASE WHEN doc_id % 9 = 0 THEN 'NO_TEXT' WHEN confidence >= 0.8 THEN 'ACCEPTED' ELSE 'REVIEW' END AS route FROM predictions""")
def _(t):
    ranking = F.array(F.struct(F.col("confidence").cast("double").alias("p"), "label"))
    return t.predictions.select("doc_id", classify.decide(ranking, F.col("doc_id") % 9 != 0).alias("d")).select("doc_id", "d.label", "d.route")


@query("c05_labelled_split", "SELECT lang AS label, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    """Labelled documents by a split that depends on the id alone, so that it is the same on every run."""
    return t.documents.groupBy(F.col("lang").alias("label"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------------- chunks


@query("t01_sections", """
    SELECT n_nationkey AS doc_id, unnest(['Scope of ' || n_name, 'Scope of ' || n_name || ' › Depth', 'Terms']) AS section FROM nation""")
def _(t):
    """The headings above each part, without the title."""
    page = F.concat(F.lit("# Policy\n\n## Scope of "), "n_name", F.lit("\n\nIt holds everywhere.\n\n### Depth\n\nAll the way down.\n\n## Terms\n\nThirty days.\n"))
    docs = t.nation.select(F.col("n_nationkey").alias("doc_id"), page.alias("text"))
    return text.chunk_documents(docs, markdown=True, target=1, most=800, overlap=0).select("doc_id", "section")


def _parts(kind: str, most: int):
    return F.udf(lambda s: text.pieces(kind, s or "", most), "array<string>", useArrow=True)


WORDS = r"len(list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda w: w <> ''))"


@query("t03_long_paragraphs", f"SELECT doc_id, {WORDS} AS words, TRUE AS fits FROM documents")
def _(t):
    """Paragraphs by sentences, and those by words, of at most 40 tokens: no word is lost, and only a single word is longer."""
    flat = F.regexp_replace("text", r"[ \t\n\r\x0b\x0c]+", " ")
    parts = t.documents.select("doc_id", _parts("text", 40)(flat).alias("parts"))
    words = lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != ""))
    fits = F.forall("parts", lambda p: (F.length(p) <= 160) | (words(p) == 1))
    return parts.select("doc_id", F.aggregate(F.transform("parts", words), F.lit(0), lambda a, b: a + b).cast("long").alias("words"), fits.alias("fits"))


@query("t04_table_groups", "SELECT p_size AS page, count(*) AS rows, TRUE AS headed FROM part GROUP BY 1")
def _(t):
    """Tables by groups of rows of at most 60 tokens, each under the header."""
    lines = t.part.groupBy(F.col("p_size").alias("page")).agg(F.sort_array(F.collect_list(F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), "p_name", F.lit(" |")))).alias("lines"))
    table = F.concat(F.lit("| Part | Name |\n"), F.array_join("lines", "\n"))
    parts = lines.select("page", _parts("table", 60)(table).alias("parts"))
    rows = F.aggregate(F.transform("parts", lambda p: F.size(F.split(p, "\n")) - 1), F.lit(0), lambda a, b: a + b)
    return parts.select("page", rows.cast("long").alias("rows"), F.forall("parts", lambda p: p.startswith("| Part | Name |\n")).alias("headed"))


@query("t05_overlap_tails", r"""
    WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents),
    p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(flat, '([.!?;:])\s+([A-Z0-9("''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM f),
    e AS (SELECT doc_id, len(s) AS n, unnest(range(2, len(s) + 1)) AS i, s FROM p), c AS (SELECT doc_id, list_sum(list_transform(s[i:n], lambda x: length(x))) + n - i AS size FROM e WHERE n - i < 160)
    SELECT doc_id, coalesce(max(size) FILTER (WHERE ceil(size / 4) <= 75), 0)::BIGINT AS characters FROM f LEFT JOIN c USING (doc_id) GROUP BY 1""")
def _(t):
    """How long what the next chunk repeats is: the most whole sentences at the end within 75 tokens, and never all."""
    flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    tail = F.udf(lambda s: text.tail([s or ""], 75), "string", useArrow=True)
    return t.documents.select("doc_id", F.length(tail(flat)).cast("long").alias("characters"))


@query("w15_chunk_packing", "SELECT doc_id, TRUE AS gapless, TRUE AS within FROM documents")
def _(t):
    """Chunks are numbered without gaps, and none is above the most."""
    per = text.chunk_documents(t.documents).groupBy("doc_id").agg(F.max("chunk_index").alias("last"), F.count("*").alias("n"), F.max(F.ceil(F.length("content") / 4)).alias("most"))
    all_ = t.documents.select("doc_id").join(per, "doc_id", "left")  # a title alone makes no chunk
    return all_.select("doc_id", F.coalesce(F.col("last") + 1 == F.col("n"), F.lit(True)).alias("gapless"), F.coalesce(F.col("most") <= text.MOST, F.lit(True)).alias("within"))


# -------------------------------------------------------------------------------- clauses


def _versions(t):
    """Two versions of a contract an order: the period changes, a clause moves, and one is new."""
    n = F.col("o_orderkey")
    years = lambda k: ((n + k) % 7 + 1).cast("string")
    old = F.concat(F.lit("Agreement\n1. Term\nIt runs for "), years(0), F.lit(" years from today.\n2. Payment\nInvoices are paid in thirty days.\n3. Liability\nNobody is liable."))
    new = F.concat(F.lit("Agreement\n1. Term\nIt runs for "), years(1), F.lit(" years from today.\n2. Liability\nNobody is liable.\n3. Payment\nInvoices are paid in thirty days.\n4. Audit\nBooks are open."))
    return t.orders.select(n.alias("doc_id"), old.alias("old_text"), new.alias("new_text"))


@query("j18_clause_alignment", """
    SELECT o_orderkey AS doc_id, unnest(['Preamble', 'Term', 'Liability', 'Payment', NULL]) AS old_title, unnest(['Preamble', 'Term', 'Liability', 'Payment', 'Audit']) AS new_title FROM orders""")
def _(t):
    return text.diff_versions(_versions(t)).select("doc_id", "old_title", "new_title")


@query("t10_clause_edits", """
    SELECT o_orderkey AS doc_id, 'MODIFIED' AS change, 'replace: ' || (o_orderkey % 7 + 1) || ' -> ' || ((o_orderkey + 1) % 7 + 1) AS edits FROM orders""")
def _(t):
    return text.diff_versions(_versions(t)).where("change = 'MODIFIED'").select("doc_id", "change", "edits")


def _clauses(t, *bodies):
    """A contract an order of clauses ``(title, text)``; a null text means that there is no such clause."""
    clause = lambda title, body: F.when(body.isNotNull(), F.struct(F.lit(title).alias("title"), body.alias("text")))
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), F.array_compact(F.array(*[clause(*b) for b in bodies])).alias("clauses"))


@query("l14_notice_periods", """
    SELECT o_orderkey AS doc_id, CASE o_orderkey % 7 WHEN 0 THEN 'NOT_APPLICABLE' WHEN 1 THEN 'WARN' WHEN 6 THEN CASE WHEN 30 + o_orderkey % 100 > 90 THEN 'FAIL' ELSE 'PASS' END ELSE CASE WHEN o_orderkey % 100 > 90 THEN 'FAIL' ELSE 'PASS' END END AS outcome,
        CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 6 THEN 30 + o_orderkey % 100 ELSE o_orderkey % 100 END::INT AS days FROM orders""")
def _(t):
    """Seven ways to state a notice period, or none."""
    n = (F.col("o_orderkey") % 100).cast("string")
    body = F.element_at(F.array(
        F.lit(None).cast("string"), F.lit("Either party may leave when it likes."), F.concat(n, F.lit(" days' prior written notice ends it.")), F.concat(F.lit("Upon thirty ("), n, F.lit(") calendar days  advance notice.")),
        F.concat(F.lit("A NOTICE PERIOD of "), n, F.lit(" days applies.")), F.concat(F.lit("With "), n, F.lit(" business days written advance notice, within 500 days of the start.")),
        F.concat(F.lit("On 30 days notice, or notice of at least "), (F.col("o_orderkey") % 100 + 30).cast("string"), F.lit(" days after a year."))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    docs = _clauses(t, ("Term", F.lit("A year; 400 days notice of nothing.")), ("Early Termination", body))
    return docs.select("doc_id", rules.notice_period(F.col("clauses"), F.lit(None).cast("int")).alias("r")).select("doc_id", "r.outcome", F.col("r.days").try_cast("int").alias("days"))


@query("l15_governing_laws", """
    SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'NOT_APPLICABLE' WHEN 1 THEN 'PASS' WHEN 2 THEN 'WARN' WHEN 3 THEN 'PASS' ELSE 'WARN' END AS outcome,
        CASE o_orderkey % 5 WHEN 1 THEN 'Delaware' WHEN 2 THEN 'New South Wales' WHEN 3 THEN 'England' END AS place FROM orders""")
def _(t):
    body = F.element_at(F.array(
        F.lit(None).cast("string"), F.lit("This contract is governed by the laws of the State of Delaware, without regard to conflicts."), F.lit("The laws of New South Wales apply."),
        F.lit("It is governed by the law of England and of Wales."), F.lit("The parties will find a law.")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    docs = _clauses(t, ("Law", F.lit("The laws of Ohio.")), ("Governing Law", body))
    return docs.select("doc_id", rules.approved_law(F.col("clauses"), ["delaware", "England"]).alias("r")).select("doc_id", "r.outcome", "r.place")


# -------------------------------------------------------------------- pairs, order, scores


@query("j11_paired_readings", """
    SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, l.line AS left_line, r.line AS right_line FROM (SELECT doc_id, regexp_extract(sku, '([0-9]+)', 1)::BIGINT AS line FROM inv_lines) l
    FULL JOIN (SELECT doc_id, regexp_extract(sku, '([0-9]+)', 1)::BIGINT AS line FROM po_lines) r ON l.doc_id = r.doc_id AND l.line = r.line""")
def _(t):
    """Rows of two extractors: most share a code, some only the description."""
    number = F.regexp_extract("sku", "([0-9]+)", 1).cast("long")
    left, right = (x.select("doc_id", number.alias("line"), "sku", "description") for x in (t.inv_lines, t.po_lines))
    return matching.pair_readings(left, right)


@query("w11_duplicates_in_order", """
    WITH d AS (
        SELECT a.doc_id, o.doc_id AS original_id, o.doc_date, a.number = o.number AS strong FROM inv_header a JOIN inv_header o ON a.vendor_id = o.vendor_id AND (a.number = o.number OR (a.total = o.total AND a.currency = o.currency AND a.doc_date - o.doc_date BETWEEN 0 AND 7)) AND (o.doc_date, o.doc_id) < (a.doc_date, a.doc_id))
    SELECT doc_id, original_id, strong, row_number() OVER (PARTITION BY doc_id ORDER BY strong DESC, doc_date, original_id)::INT AS place FROM d""")
def _(t):
    """A document's originals: strong ones first, then the oldest."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("strong"), "original_date", "original_id"))
    return matching.find_duplicates(t.inv_header).withColumn("place", place).select("doc_id", "original_id", "strong", "place")


@query("r18_ranking_scores", """
    WITH r AS (SELECT conv_id AS query, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY md5(conv_id || '/' || turn || '/' || role || '/' || text)) AS rank, role = 'assistant' AS hit FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL)),
    n AS (SELECT query, count(*) FILTER (WHERE hit) AS n, max((rank <= 3 AND hit)::INT) AS hit, sum((rank <= 3 AND hit)::INT) / 3 AS precision, max(CASE WHEN hit THEN 1.0::DOUBLE / rank ELSE 0 END) AS rr, sum(CASE WHEN rank <= 3 AND hit THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM r GROUP BY 1)
    SELECT query, hit, round(precision, 9) AS precision, round(rr, 9) AS rr, round(dcg / (1 + CASE WHEN n >= 2 THEN 1 / log2(3.0) ELSE 0 END + CASE WHEN n >= 3 THEN 0.5 ELSE 0 END), 9) AS ndcg FROM n WHERE n > 0""")
def _(t):
    """The turns of a conversation in an arbitrary order; those of the assistant are wanted."""
    said = t.conversations.where("text IS NOT NULL").select("conv_id", "turn", "role", "text").distinct()
    name = F.md5(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text"))
    ranked = said.select(F.col("conv_id").alias("query"), name.alias("item"), "role").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("item")))
    per = metrics.ranking_metrics(ranked.select("query", "item", "rank"), ranked.where("role = 'assistant'").select("query", "item"), "query", "item", "rank", 3)
    return per.select("query", "hit", *[F.round(c, 9).alias(c) for c in ("precision", "rr", "ndcg")])


@query("k12_refreshed_totals", "SELECT doc_id, sum(CASE WHEN doc_id % 100 = 1 THEN quantity + 1 ELSE quantity END)::DECIMAL(28,4) AS quantity FROM po_lines GROUP BY 1")
def _(t):
    """Totals kept up to date: only the documents whose lines changed are computed again, the others keep theirs."""
    total = lambda df: df.groupBy("doc_id").agg(F.sum("quantity").cast("decimal(28,4)").alias("quantity"))
    kept = total(t.po_lines.where("doc_id % 100 <> 1"))
    changed = t.po_lines.where("doc_id % 100 = 1").withColumn("quantity", (F.col("quantity") + 1).cast("decimal(18,4)"))
    return kept.unionByName(total(changed))


INVOICE = "doc_id long, number string, po_number string, vendor_id long, total decimal(18,4)"


def invoice_matches(affected, invoices):
    """What an invoice's neighbours say of it: the first of its number, how many invoices its order has and their sum, and others of its vendor and total."""
    same = lambda *keys: invoices.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys)
    mine = invoices.join(affected, "doc_id", "left_semi")
    by_number = same("number").agg(F.min("doc_id").alias("original"))
    by_order = same("po_number").agg(F.count("*").alias("billed"), F.sum("total").cast("decimal(28,4)").alias("billed_total"))
    by_total = same("vendor_id", "total").agg((F.count("*") - 1).alias("alike"))
    found = mine.join(by_number, "number", "left").join(by_order, "po_number", "left").join(by_total, ["vendor_id", "total"], "left")
    return found.select("doc_id", F.coalesce("original", "doc_id").alias("original"), F.coalesce("billed", F.lit(0)).alias("billed"), "billed_total", F.coalesce("alike", F.lit(0)).alias("alike"))


def maintained_invoices(spark, path, buckets=64):
    schema = lambda ddl: T.StructType.fromDDL(ddl)
    result = schema("doc_id long, original long, billed long, billed_total decimal(28,4), alike long")
    return maintenance.Maintained(spark, path, "doc_id", schema(INVOICE), [["number"], ["po_number"], ["vendor_id", "total"]], invoice_matches, result, buckets)


@query("q09_late_documents", """
    WITH i AS (SELECT doc_id, number, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE concat('PO-', CAST(doc_id - doc_id % 5 AS VARCHAR)) END AS po_number, vendor_id, total FROM inv_header WHERE doc_id % 13 <> 0)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY number) AS original, CASE WHEN po_number IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY po_number) END AS billed,
        CASE WHEN po_number IS NOT NULL THEN sum(total) OVER (PARTITION BY po_number) END::DECIMAL(28,4) AS billed_total, count(*) OVER (PARTITION BY vendor_id, total) - 1 AS alike FROM i""")
def _(t):
    """Invoices in three batches: first with wrong orders, then late ones that change their neighbours' results, at last corrections and deletions."""
    order = F.when(F.col("doc_id") % 5 != 4, F.concat(F.lit("PO-"), (F.col("doc_id") - F.col("doc_id") % 5).cast("string")))
    right = t.inv_header.select("doc_id", "number", order.alias("po_number"), F.col("vendor_id").cast("long").alias("vendor_id"), "total", (F.col("doc_id") % 13 == 0).alias("deleted"))
    kept = maintained_invoices(t.spark, new_folder(t.spark, "maintained"), 16)
    kept.apply(right.where("doc_id % 7 <> 3").withColumns({"po_number": F.when(F.col("doc_id") % 11 == 0, "PO-0").otherwise(F.col("po_number")), "deleted": F.lit(False)}), 0)
    kept.apply(right.where("doc_id % 7 = 3").withColumn("deleted", F.lit(False)), 1)
    kept.apply(right.where("doc_id % 11 = 0 OR doc_id % 13 = 0"), 2)
    return kept.results().drop("batch")


# ---------------------------------------------------------------------------------- tools


@query("b06_tool_catalogue", """
    SELECT * FROM (VALUES ('compare_documents', 1, FALSE), ('create_review_task', 2, TRUE), ('generate_report', 1, TRUE), ('get_document', 1, FALSE), ('get_document_evidence', 2, FALSE), ('get_extracted_fields', 1, FALSE),
        ('get_workflow_status', 1, FALSE), ('run_business_rules', 1, FALSE), ('search_documents', 1, FALSE), ('search_knowledge_base', 2, FALSE)) v(name, needs, writes)""")
def _(t):
    rows = [F.struct(F.lit(x.name).alias("name"), F.lit(len(x.needs)).alias("needs"), F.lit(x.writes).alias("writes")) for x in tools.TOOLS.values()]
    return t.spark.range(1).select(F.inline(F.array(*rows)))


def agent_tables(t) -> tools.Tables:
    """What the tools read, from the views."""
    orders = t.po_header.withColumn("document_type", F.lit("PURCHASE_ORDER"))
    fields = t.po_lines.select("doc_id", F.col("sku").alias("path"), F.col("quantity").cast("string").alias("value"), "confidence")
    passages = t.versions.join(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "text", "effective_from", "effective_to")
    jobs = t.jobs.select(F.col("job_id").alias("doc_id"), "job_type", "status", "created_at")
    return {
        "documents": orders, "vendors": t.vendors, "fields": fields, "passages": passages, "invoice_lines": t.inv_lines, "order_lines": t.po_lines, "invoices": t.inv_header, "orders": t.po_header,
        "compared": _items(t), "compared_headers": matching.compare_headers(t.inv_header, t.po_header), "tasks": t.tasks, "jobs": jobs,
    }


@query("b06_search_tool", "SELECT doc_id, total FROM po_header WHERE total > 200000 ORDER BY doc_date DESC, doc_id LIMIT 20")
def _(t):
    return tools.call("search_documents", agent_tables(t), query="purchase orders over 200k").select("doc_id", "total")


@query("b06_knowledge_tool", """
    WITH d AS (SELECT v.doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM versions v JOIN documents USING (doc_id) WHERE effective_from <= DATE '2025-03-01' AND (effective_to IS NULL OR effective_to >= DATE '2025-03-01')),
    q AS (SELECT unnest(['license', 'the', 'version']) AS term), i AS (SELECT term, ln(((SELECT count(*) FROM d) + 1) / ((SELECT count(*) FROM d WHERE list_contains(w, term)) + 0.5)) AS idf FROM q)
    SELECT doc_id, round(sum(CASE WHEN list_contains(w, term) THEN idf ELSE 0 END) / sum(idf), 6) AS coverage FROM d, i GROUP BY doc_id HAVING coverage > 0 ORDER BY coverage DESC, doc_id LIMIT 5""")
def _(t):
    found = tools.call("search_knowledge_base", agent_tables(t), question="the license version", day="2025-03-01")
    return found.select("doc_id", F.round("coverage", 6).alias("coverage"))


@query("n09_dispatch", """
    WITH p AS (SELECT event_id, ['MONEY', 'INTEGER', 'DAYS', 'BOOLEAN', 'CURRENCY', 'IDENTIFIER', 'PERCENT', 'EMAIL'][event_id % 8 + 1] AS kind, event_id % 8 AS k, user_id AS u FROM events)
    SELECT event_id, kind, CASE k WHEN 0 THEN u || '.5' WHEN 1 THEN u::VARCHAR WHEN 2 THEN (u * 7)::VARCHAR WHEN 3 THEN CASE WHEN event_id % 16 = 3 THEN 'true' ELSE 'false' END WHEN 4 THEN 'EUR' WHEN 5 THEN 'AB-' || u
        WHEN 6 THEN rtrim(rtrim((u % 90 + 1)::DECIMAL(9,2)::DECIMAL(18,4)::DECIMAL(18,6)::VARCHAR, '0'), '.') ELSE 'me' || u || '@x.org' END AS printed,
        CASE WHEN k = 2 AND event_id % 3 = 0 THEN 'OK' ELSE 'OK' END AS status FROM p WHERE k <> 6""")
def _(t):
    """Printed values of eight kinds, normalised by the dispatcher."""
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    kinds = F.array(*map(F.lit, ["MONEY", "INTEGER", "DAYS", "BOOLEAN", "CURRENCY", "IDENTIFIER", "PERCENT", "EMAIL"]))
    printed = F.element_at(F.array(
        F.concat(F.lit("Total: $ "), u, F.lit(".50")), F.concat(F.lit("no. "), u), F.concat(u, F.lit(" weeks")), F.when(e % 16 == 3, "will renew").otherwise("shall not renew"), F.concat(u, F.lit(" EUR")),
        F.concat(F.lit(" ab- "), u, F.lit(".")), F.concat(u, F.lit("%")), F.concat(F.lit("Me"), u, F.lit("@X.org"))), (e % 8 + 1).cast("int"))
    rows = t.events.where("event_id % 8 <> 6").select("event_id", F.get(kinds, (e % 8).cast("int")).alias("kind"), printed.alias("text"))
    return rows.select("event_id", "kind", values.normal_value(F.col("kind"), F.col("text")).alias("v")).select("event_id", "kind", F.col("v.value").alias("printed"), "v.status")


@query("r01_similarities", """
    SELECT q.vec_id AS query, round(max(list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v)))), 9) AS best
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) e, (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 20 = 0) q GROUP BY 1""")
def _(t):
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return retrieval.nearest(t.embeddings, queries, 1, "vec_id").select("query", F.round("similarity", 9).alias("best"))
