"""Fields of printed documents, comparisons one by one, sources as units, and scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators import extraction, fields, matching, metrics, ranking, rules, sets, text
from ..sources import files
from ..sources.shared import shared_dir
from .matching import LINE_RULES, PAIRS, line_rules, three_way
from .registry import query

#: Labels and table headers with their synonyms.
LABELS = {"number": ["PO Number", "Order No"], "date": ["Order Date", "Date"], "total": ["Total Due", "Total"], "terms": ["Terms"], "vendor": ["Vendor"]}
HEADERS = {"sku": ["item no", "sku"], "description": ["description", "item"], "quantity": ["qty", "quantity"], "price": ["unit price", "price"]}


def _printed(t):
    """The lines of a printed order."""
    c = F.col
    lines = F.array(
        F.lit("Purchase Order"), F.concat(F.lit("PO Number: "), "number"), F.lit("Order Date"), c("doc_date").cast("string"),
        F.concat(F.lit("TOTAL DUE "), c("total").cast("string"), F.lit(" "), "currency"), F.lit("Terms"), F.concat(F.lit("Vendor: V"), c("vendor_id").cast("string")))
    return t.po_header.select("doc_id", F.posexplode(lines).alias("line", "text"))


@query("c06_labelled_values", """
    SELECT doc_id, unnest(['number', 'date', 'total', 'vendor']) AS field, unnest([number, doc_date::VARCHAR, total::VARCHAR || ' ' || currency, 'V' || vendor_id]) AS value,
        unnest(['SAME_LINE', 'BELOW', 'SAME_LINE', 'SAME_LINE']) AS place FROM po_header""")
def _(t):
    return fields.labelled_values(_printed(t), LABELS)


@query("c07_column_fields", """
    SELECT n_nationkey AS doc_id, unnest(['sku', 'description', 'quantity', 'price']) AS field, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [0, 1, 2, 3] ELSE [3, 2, 1, 0] END) AS position FROM nation""")
def _(t):
    plain, other = (F.array(*map(F.lit, x)) for x in (["Item No.", "Description", "Qty", "Unit Price"], ["Price (USD)", "Quantity", "Item description", "SKU"]))
    return fields.map_columns(t.nation.select(F.col("n_nationkey").alias("doc_id"), F.when(F.col("n_nationkey") % 2 == 0, plain).otherwise(other).alias("headers")), HEADERS)


@query("c08_item_rows", """
    SELECT doc_id, 1 AS "row", CASE WHEN doc_id % 2 = 0 THEN 'SKU ' || doc_id END AS code, 'steel bolt' AS description, (doc_id % 90 + 0.5)::DECIMAL(18,4) AS quantity, CASE WHEN doc_id % 3 = 0 THEN 'pcs' END AS unit FROM po_header""")
def _(t):
    d = F.col("doc_id")
    item = F.concat(F.when(d % 2 == 0, F.concat(F.lit("SKU "), d.cast("string"), F.lit(" - "))).otherwise(""), F.lit("steel bolt"))
    amount = F.concat((d % 90).cast("string"), F.lit(".5"), F.when(d % 3 == 0, " pcs").otherwise(""))
    rows = F.array(F.struct(item.alias("item"), amount.alias("amount")), *[F.struct(F.lit(i).alias("item"), a.alias("amount")) for i, a in (("Sub-Total", amount), ("", amount), ("see below", F.lit("n/a")))])
    return fields.table_rows(t.po_header.select("doc_id", F.posexplode(rows).alias("row", "x")).select("doc_id", (F.col("row") + 1).alias("row"), "x.item", "x.amount"))


@query("c09_section_items", """
    SELECT n_nationkey AS doc_id, unnest([2, 3, 5]) AS line, unnest(['skills', 'skills', 'duties']) AS section, unnest(['lifting', n_name, 'report daily']) AS item FROM nation""")
def _(t):
    lines = F.array(F.lit("- no section"), F.lit("Required skills"), F.lit("- lifting"), F.concat(F.lit("2) "), "n_name"), F.lit("Duties:"), F.lit("* report daily"), F.lit("Other remarks"), F.lit("- not listed"))
    return fields.section_items(t.nation.select(F.col("n_nationkey").alias("doc_id"), F.posexplode(lines).alias("line", "text")), {"(?i)skills": "skills", "(?i)^duties": "duties"})


@query("c10_document_currency", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN currency WHEN doc_id % 3 = 1 THEN 'GBP' END AS currency FROM po_header")
def _(t):
    d = F.col("doc_id")
    amounts = F.when(d % 3 == 1, F.array(F.lit("GBP 10.00"), F.lit("£5.00"))).when(d % 3 == 2, F.array(F.lit("10.00 CHF"), F.lit("EUR 3"))).otherwise(F.array(F.lit("JPY 7")))
    docs = t.po_header.select("doc_id", F.when(d % 3 == 0, F.col("currency")).alias("stated"), amounts.alias("amounts"))
    return docs.select("doc_id", fields.document_currency(docs, "stated", "amounts").alias("currency"))


@query("c14_reading_confidence", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.54 ELSE 0 END::DOUBLE AS reading, CASE event_id % 3 WHEN 0 THEN 0.54 WHEN 1 THEN 0.324 ELSE 0 END::DOUBLE AS with_checks FROM events")
def _(t):
    normal, none = F.when(F.col("event_id") % 3 == 0, "OK").when(F.col("event_id") % 3 == 1, "UNCERTAIN").otherwise("INVALID"), F.lit(None)
    score = lambda consistent: extraction.field_confidence(F.lit("VERIFIED"), none, normal, none, none, F.lit(0), F.lit(True), consistent, none.cast("boolean"), F.lit(False), F.lit(False))
    return t.events.select("event_id", score(F.lit(None).cast("boolean")).alias("reading"), score(F.lit(False)).alias("with_checks"))


@query("c16_document_scores", """
    WITH f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 0.9 END::DOUBLE AS a, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 0.7 + (doc_id % 3) / 10.0 END::DOUBLE AS b, CASE WHEN doc_id % 2 = 1 THEN 0.88 END::DOUBLE AS cell, doc_id % 7 = 0 AS failed FROM po_header),
    s AS (SELECT *, least(coalesce(a, 0), coalesce(b, 0)) AS required_confidence, list_filter([CASE WHEN a IS NULL THEN 'a' END, CASE WHEN b IS NULL THEN 'b' END], lambda x: x IS NOT NULL) AS missing, a IS NOT NULL OR b IS NOT NULL OR cell IS NOT NULL AS found FROM f),
    o AS (SELECT *, least(required_confidence, coalesce(cell, 1)) AS confidence FROM s),
    v AS (SELECT *, CASE WHEN failed OR confidence < 0.6 THEN 'MANDATORY_REVIEW' WHEN confidence < 0.85 THEN 'ANALYST_REVIEW' ELSE 'AUTO' END AS level FROM o)
    SELECT doc_id, required_confidence, cell AS line_confidence, confidence, missing, CASE WHEN NOT found THEN 'FAILED' WHEN len(missing) > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status, level,
        list_filter([CASE WHEN NOT found THEN 'EXTRACTION_FAILED' WHEN len(missing) > 0 THEN 'MISSING_REQUIRED_FIELDS' END, CASE WHEN failed THEN 'EXTRACTION_INCONSISTENT' END,
            CASE WHEN found AND len(missing) = 0 AND NOT failed AND level <> 'AUTO' THEN 'EXTRACTION_UNCERTAIN' END], lambda x: x IS NOT NULL) AS reasons FROM v""")
def _(t):
    d = F.col("doc_id")
    field = lambda name, table, conf: F.struct(F.lit(name).alias("name"), F.lit(not table).alias("required"), F.lit(table).alias("in_table"), conf.cast("double").alias("confidence"))
    parts = F.array(field("a", False, F.when(d % 5 != 0, 0.9)), field("b", False, F.when(d % 10 != 0, F.round(0.7 + (d % 3) / 10, 4))), field("cell", True, F.when(d % 2 == 1, 0.88)))
    return fields.score_documents(t.po_header.select("doc_id", F.inline(parts)), d % 7 == 0)


@query("n01_numbers", """
    SELECT doc_id, [-total::DOUBLE, doc_id::DOUBLE, -3.0] AS found, [false, true, false] AS percent FROM po_header""")
def _(t):
    read = F.udf(lambda s: [(float(v), p) for v, _, p in values.find_numbers(s)], "array<struct<value double, percent boolean>>", useArrow=True)
    printed = F.concat(F.lit("Credit ("), F.col("total").cast("decimal(18,2)").cast("string"), F.lit("), rate "), F.col("doc_id").cast("string"), F.lit(" %, change 3-"))
    return t.po_header.select("doc_id", read(printed).alias("x")).select("doc_id", F.col("x.value").alias("found"), F.col("x.percent").alias("percent"))


@query("n11_value_in_source", "SELECT doc_id, doc_id % 2 = 0 AS money, doc_id % 3 = 0 AS date, TRUE AS rate, TRUE AS text, FALSE AS empty FROM po_header")
def _(t):
    d, amount, day = F.col("doc_id"), F.col("total").cast("decimal(18,2)"), F.col("doc_date")
    holds = lambda kind, v, s: fields.value_in_source(F.lit(kind), v, s)
    return t.po_header.select(
        "doc_id", holds("MONEY", F.concat(amount.cast("string"), F.lit("00")), F.concat(F.lit("due: "), F.when(d % 2 == 0, amount).otherwise(amount + 1).cast("string"), F.lit(" USD"))).alias("money"),
        holds("DATE", day.cast("string"), F.date_format(F.when(d % 3 == 0, day).otherwise(F.date_add(day, 1)), "d MMMM yyyy")).alias("date"),
        holds("PERCENT", F.lit("5.0%"), F.lit("a rate of 5 %")).alias("rate"), holds("TEXT", F.lit("Kestrel and Sons Limited"), F.lit("for Kestrel ans Sons Limited, Harwich")).alias("text"),
        holds("TEXT", F.lit("x"), F.lit("  ")).alias("empty"))


@query("k08_money_text", r"SELECT doc_id, regexp_replace(total::DECIMAL(18,4)::VARCHAR, '(\.\d\d)(\d*?)0+$', '\1\2') AS money, CASE WHEN doc_id % 2 = 0 THEN '+1.5' ELSE '-1.5' END AS change FROM po_header")
def _(t):
    return t.po_header.select("doc_id", values.money_text(F.col("total")).alias("money"), values.signed_text(F.when(F.col("doc_id") % 2 == 0, 1.5).otherwise(-1.5).cast("decimal(10,3)")).alias("change"))


@query("k01_same_vendor", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN i.vendor_id = o.vendor_id WHEN doc_id % 2 = 0 THEN TRUE END AS same FROM inv_header i JOIN po_header o USING (doc_id)")
def _(t):
    both = t.inv_header.select("doc_id", "vendor_id").join(t.po_header.select("doc_id", F.col("vendor_id").alias("other")), "doc_id")
    return both.select("doc_id", matching.same_vendor(F.when(F.col("doc_id") % 3 != 0, F.col("vendor_id")), F.col("other"), F.when(F.col("doc_id") % 2 == 0, True)).alias("same"))


@query("k02_numeric_status", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'MISSING' WHEN l_orderkey % 29 = 0 THEN 'UNCERTAIN' WHEN l_linenumber % 3 = 0 OR 1 <= l_quantity::DECIMAL(18,4) * 0.05 THEN 'MATCH' WHEN l_linenumber = 1 THEN 'UNCERTAIN' ELSE 'MISMATCH' END AS status FROM lineitem""")
def _(t):
    n, right = F.col("l_linenumber"), F.col("l_quantity").cast("decimal(18,4)")
    left = F.when(n != 7, right + F.when(n % 3 == 0, 0).otherwise(1))
    return t.lineitem.select("l_orderkey", "l_linenumber", matching.numeric_status(left, right, n == 1, 0, 0.05, F.col("l_orderkey") % 29 == 0).alias("status"))


def _checks(name, checks):
    wanted = ", ".join(f"'{c}'" for c in checks)

    @query(name, f'WITH {PAIRS} SELECT doc_id, key, "check", status FROM items WHERE "check" IN ({wanted})')
    def _(t):
        return three_way(t).where(F.col("check").isin(checks)).select("doc_id", "key", "check", "status")


_checks("k04_missing_lines", ["line_fulfilled", "line_on_order"])
_checks("k06_order_lines", ["unit_price", "quantity_ordered"])
_checks("k07_delivered_quantities", ["quantity_delivered", "line_delivered"])


def _rule(name, code):
    @query(name, f"WITH {LINE_RULES} SELECT doc_id, outcome, failing FROM results WHERE code = '{code}'")
    def _(t):
        return line_rules(t).where(F.col("code") == code).select("doc_id", "outcome", "failing")


_rule("l03_quantity_ordered", "INV_PO_QUANTITY")
_rule("l04_quantity_delivered", "INV_DELIVERED_QUANTITY")
_rule("l05_line_not_ordered", "INV_LINE_NOT_ORDERED")


@query("k05_header_counts", """
    SELECT 'vendor_id' AS "check", count(*) FILTER (WHERE i.vendor_id <> o.vendor_id) AS mismatches FROM inv_header i JOIN po_header o ON i.po_number = o.number
    UNION ALL SELECT 'currency', count(*) FILTER (WHERE i.currency <> o.currency) FROM inv_header i JOIN po_header o ON i.po_number = o.number UNION ALL SELECT 'terms', count(*) FILTER (WHERE i.terms <> o.terms) FROM inv_header i JOIN po_header o ON i.po_number = o.number""")
def _(t):
    return matching.compare_headers(t.inv_header, t.po_header).groupBy("check").agg(F.count_if(F.col("status") == "MISMATCH").alias("mismatches"))


@query("j15_duplicate_candidates", """
    SELECT doc_id, 'number' AS kind, min(doc_id) OVER w AS oldest, count(*) OVER w - 1 AS others FROM inv_header WINDOW w AS (PARTITION BY number) QUALIFY others > 0
    UNION ALL SELECT doc_id, 'total', min(doc_id) OVER w AS oldest, count(*) OVER w - 1 AS others FROM inv_header WINDOW w AS (PARTITION BY total) QUALIFY others > 0""")
def _(t):
    """Documents that share a number or a total, as groups."""
    return sets.related_groups(t.inv_header.select("doc_id", "number", "total"), "doc_id", {"number": ["number"], "total": ["total"]})


@query("z19_corpus_duplicates", """
    SELECT d.doc_id, count(*) AS older FROM inv_header d JOIN inv_header o ON d.vendor_id = o.vendor_id AND d.number = o.number AND (o.doc_date, o.doc_id) < (d.doc_date, d.doc_id) GROUP BY 1""")
def _(t):
    """Older documents of the same vendor and number: the place among them, so that a frequent number makes no pairs."""
    named = t.inv_header.select("doc_id", "doc_date", F.struct("vendor_id", matching.reference_key(F.col("number")).alias("number")).alias("name"))
    return ranking.places(named, "name", ["doc_date", "doc_id"], "place").where("place > 1").select("doc_id", (F.col("place") - 1).alias("older"))


@query("j21_row_scores", "SELECT doc_id, count(*) AS expected, count(*) AS detected, count(*) AS matched FROM po_lines GROUP BY 1")
def _(t):
    """Rows read against true rows, by code or best likeness."""
    number = F.regexp_extract("sku", "([0-9]+)", 1).cast("long")
    read, true = (x.select("doc_id", number.alias("line"), "sku", "description") for x in (t.inv_lines, t.po_lines))
    return matching.match_lines_fuzzy(read, true, 75.0).groupBy("doc_id").agg(
        F.count("right_line").alias("expected"), F.count("left_line").alias("detected"), F.count_if(F.col("left_line").isNotNull() & F.col("right_line").isNotNull()).alias("matched"))


@query("z15_expected_rules", """
    SELECT doc_id, list_filter(['INV_PO_UNIT_PRICE', 'INV_PO_PAYMENT_TERMS', 'INV_PO_VENDOR'], lambda r: (r = 'INV_PO_UNIT_PRICE' AND doc_id % 7 = 0) OR (r = 'INV_PO_PAYMENT_TERMS' AND doc_id % 43 = 0) OR (r = 'INV_PO_VENDOR' AND doc_id % 41 = 0)) AS expected FROM inv_header""")
def _(t):
    truth = {"INV_PO_UNIT_PRICE": 7, "INV_PO_PAYMENT_TERMS": 43, "INV_PO_VENDOR": 41}
    return t.inv_header.select("doc_id", F.array_compact(F.array(*[F.when(F.col("doc_id") % n == 0, F.lit(code)) for code, n in truth.items()])).alias("expected"))


@query("d06_expiry_windows", "SELECT doc_id, CASE WHEN effective_to IS NULL THEN 'NOT_APPLICABLE' WHEN effective_to < DATE '2025-06-01' THEN 'FAIL' WHEN effective_to <= DATE '2025-06-01' + 90 THEN 'WARN' ELSE 'PASS' END AS outcome FROM versions")
def _(t):
    return t.versions.select("doc_id", rules.contract_expiry(F.col("effective_to"), F.lit(False), F.lit("2025-06-01").cast("date"), 90).alias("outcome"))


@query("m03_lexeme_array", r"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) AS lexemes FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+", -1), lambda w: w != ""))).alias("lexemes"))


@query("m07_metric_paths", """
    SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey / 10.0 END::DOUBLE AS value, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not a number' WHEN 2 THEN 'missing' ELSE 'not a number' END AS problem FROM nation""")
def _(t):
    n = F.col("n_nationkey")
    leaf = F.when(n % 4 == 0, F.concat(F.lit('{"f1": '), (n / 10).cast("string"), F.lit("}"))).when(n % 4 == 1, '{"f1": "high"}').when(n % 4 == 2, "{}").otherwise('{"f1": true}')
    at = metrics.metric_at(F.concat(F.lit('{"fields": '), leaf, F.lit("}")), "$.fields.f1")
    return t.nation.select("n_nationkey", at.alias("m")).select("n_nationkey", "m.value", "m.problem")


@query("q07_department_turns", "SELECT job_id, department, row_number() OVER (PARTITION BY department ORDER BY created_at, job_id)::INT AS turn FROM jobs WHERE status = 'QUEUED'")
def _(t):
    queued = t.jobs.where("status = 'QUEUED'").select("job_id", "department", "created_at")
    return ranking.places(queued, "department", ["created_at", "job_id"], "turn").select("job_id", "department", F.col("turn").cast("int").alias("turn"))


@query("x05_tax_keys", "SELECT vendor_id, nullif(upper(regexp_replace(tax_id, '[^0-9A-Za-z]', '', 'g')), '') AS key FROM vendors")
def _(t):
    return t.vendors.select("vendor_id", extraction.tax_id_key(F.col("tax_id")).alias("key"))


@query("x19_merged_passages", """
    WITH d AS (SELECT doc_id, left(text, (length(text) * 6 + 9) // 10) AS a, right(text, (length(text) * 6 + 9) // 10) AS b FROM documents),
    n AS (SELECT *, list_max(list_filter(range(21, length(a) + 1), lambda n: right(a, n) = left(b, n))) AS n FROM d) SELECT doc_id, a || substr(b, n + 1) AS merged FROM n""")
def _(t):
    """The first and the last six tenths of each text, joined again."""
    merge = F.udf(values.merge_overlapping, "string", useArrow=True)
    share = F.expr("(length(text) * 6 + 9) div 10").cast("int")
    return t.documents.select("doc_id", merge(F.left("text", share), F.right("text", share)).alias("merged"))


def _unit_rows(df, read):
    units = F.udf(lambda s: [(k, x, n) for k, x, n in read(s or "")], "array<struct<kind string, text string, level int>>", useArrow=True)
    return df.select("doc_id", F.posexplode(units("text")).alias("nr", "u")).select("doc_id", "nr", "u.kind", "u.text", "u.level")


@query("s11_markdown_units", """
    SELECT n_nationkey AS doc_id, unnest([0, 1, 2, 3]) AS nr, unnest(['heading', 'text', 'table', 'heading']) AS kind, unnest([n_name, 'first line' || chr(10) || 'second', '| a | b |' || chr(10) || '| 1 | 2 |', 'Part']) AS text, unnest([1, 0, 0, 2]) AS level FROM nation""")
def _(t):
    page = F.concat(F.lit("---\nowner: ops\n---\n# "), "n_name", F.lit("\n\nfirst line\nsecond\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## Part\n"))
    return _unit_rows(t.nation.select(F.col("n_nationkey").alias("doc_id"), page.alias("text")), text.markdown_units)


@query("s13_numbered_units", """
    SELECT n_nationkey AS doc_id, unnest([0, 1, 2, 3]) AS nr, unnest(['heading', 'heading', 'text', 'heading']) AS kind, unnest([n_name, '4. Term', 'It runs a year.', '4.2 Notice']) AS text, unnest([1, 2, 0, 3]) AS level FROM nation""")
def _(t):
    page = F.concat("n_name", F.lit("\n\n4. Term\n\nIt runs a year.\n\n4.2 Notice\n"))
    return _unit_rows(t.nation.select(F.col("n_nationkey").alias("doc_id"), page.alias("text")), text.text_units)


#: Printed lines, and the number and title that they have as headings.
LINES = [
    ("Article 3: Term.", "3", "Term"), ("4.2 Late payment", "4.2", "Late payment"), ("5. Where the buyer is late,", None, None), ("6. the buyer pays", None, None), ("Clause 7 - Fees", "7", "Fees"),
    ("SECTION 2.1) Scope", "2.1", "Scope"), ("7) Fees", "7", "Fees"), ("7 Fees", None, None), ("1.2.3.4 Deep", "1.2.3.4", "Deep"), ("1.2.3.4.5 Deeper", None, None), ("  12. Ünder", None, None), ("", None, None),
    ("30 Days after that", None, None), ("8. One two three four five six seven eight nine ten eleven", None, None),
]


@query("t08_heading_grammar", f"""
    SELECT o_orderkey AS doc_id, {[n for _, n, _ in LINES]}[o_orderkey % {len(LINES)} + 1] AS number, {[x for _, _, x in LINES]}[o_orderkey % {len(LINES)} + 1] AS title FROM orders""".replace("None", "NULL"))
def _(t):
    read = F.udf(text.heading, "struct<number string, title string>", useArrow=True)
    line = F.element_at(F.array(*[F.lit(x) for x, _, _ in LINES]), (F.col("o_orderkey") % len(LINES) + 1).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), read(line).alias("h")).select("doc_id", "h.number", "h.title")


@query("s17_reports_once", "SELECT 'orders' AS suite, o_orderpriority AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY 2")
def _(t):
    """Reports of two folders with the same content are imported once."""
    folder = f"{shared_dir(t.spark)}/reports-{uuid.uuid4().hex}"
    counts = t.orders.groupBy(F.lit("orders").alias("suite"), F.col("o_orderpriority").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    for copy in ("a", "b"):
        files.write_report(counts, f"{folder}/{copy}")
    return files.import_reports(t.spark, f"{folder}/*").select("suite", "metric", "value")


@query("g08_header_agreement", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS lost FROM nation")
def _(t):
    words = lambda *x: F.array(*map(F.lit, x))
    n = F.col("n_nationkey")
    second = F.when(n % 3 == 0, words("#", "Item  no", "QTY", "Pr1ce")).when(n % 3 == 1, words("Item No", "Qty", "Price")).otherwise(words("Qty", "Price"))
    return t.nation.select("n_nationkey", extraction.header_offset(words("#", "Item No", "Qty", "Price"), second).alias("lost"))


@query("g06_column_bounds", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN [49.99]::DOUBLE[] ELSE [35.0]::DOUBLE[] END AS bounds FROM nation")
def _(t):
    boxes = lambda *x: F.array(*[F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1")) for a, b in x])
    words = F.when(F.col("n_nationkey") % 2 == 0, boxes((0, 18), (50, 66))).otherwise(boxes((0, 18), (40, 66)))
    return t.nation.select("n_nationkey", extraction.column_bounds(boxes((0, 20), (50, 70)), words).alias("bounds"))
