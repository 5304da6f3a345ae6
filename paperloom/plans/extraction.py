"""Confidence, consistency, vendors, layout and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, extraction, matching, rules
from ..sources.shared import stored
from .matching import LINE_RULES, _items
from .registry import query


@query("c13_field_confidence", """
    SELECT event_id, (CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN least(1.0::DOUBLE, value / 100) WHEN 2 THEN 0.1 ELSE 0 END) * (CASE event_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6 ELSE 0 END) * (0.5::DOUBLE + 0.5::DOUBLE * least(100, value) / 100)
        * (CASE WHEN event_id % 5 = 0 THEN 0.8::DOUBLE ELSE 1 END) * (CASE WHEN event_id % 7 = 0 THEN 0.6::DOUBLE ELSE 1 END) * (CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.9 END) > 0.30005 AS sure FROM events""")
def _(t):
    e, v = F.col("event_id"), F.col("value")
    evidence = F.when(e % 4 == 0, "VERIFIED").when(e % 4 == 1, "FUZZY").when(e % 4 == 2, "UNSUPPORTED").otherwise("NOT_FOUND")
    normal = F.when(e % 3 == 0, "OK").when(e % 3 == 1, "UNCERTAIN").otherwise("INVALID")
    c = extraction.field_confidence(evidence, v, normal, v, F.lit(1.0), F.when(e % 5 == 0, 1).otherwise(0), F.lit(True), e % 7 != 0, F.when(e % 2 == 0, True), F.lit(False), F.lit(False))
    return t.events.select("event_id", (c > 0.30004).alias("sure"))


@query("c15_review_level", "SELECT doc_id, CASE WHEN label <> truth OR confidence < 0.6 THEN 'MANDATORY_REVIEW' WHEN confidence < 0.85 THEN 'ANALYST_REVIEW' ELSE 'AUTO' END AS level FROM predictions")
def _(t):
    return t.predictions.select("doc_id", extraction.review_level(F.col("confidence"), F.col("label") != F.col("truth")).alias("level"))


@query("c04_agreement_confidence", """
    SELECT event_id, round(least(0.95, greatest(0, CASE user_id % 3 WHEN 0 THEN greatest(0.8, 0.9) WHEN 1 THEN 0.65 ELSE 0.45 END + CASE WHEN event_id % 4 >= 2 AND event_id % 4 >= event_id % 3 THEN 0.1 WHEN event_id % 3 > event_id % 4 THEN -0.1 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN -0.1 ELSE 0 END)), 4)::DOUBLE AS confidence FROM events""")
def _(t):
    label = F.when(F.col("user_id") % 3 == 0, "a").when(F.col("user_id") % 3 == 1, "b").otherwise("c")
    e = F.col("event_id")
    return t.events.select("event_id", extraction.agreement_confidence(label, F.lit("a"), F.lit(0.9), F.lit("b"), e % 4, e % 3, e % 5 != 0).alias("confidence"))


@query("c12_consistency_checks", """
    WITH l AS (SELECT doc_id, quantity, unit_price, round(quantity * unit_price, 2) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS amount FROM po_lines),
    s AS (SELECT doc_id, sum(amount) AS line_sum, count(*) AS n FROM l GROUP BY 1)
    SELECT doc_id, 'LINE_AMOUNT' AS code, doc_id % 7 <> 0 AS passed FROM s
    UNION ALL SELECT doc_id, 'LINES_SUM', abs(line_sum - total) <= 0.02 * greatest(1, floor(n / 10) + 1) FROM s JOIN po_header USING (doc_id)
    UNION ALL SELECT doc_id, 'DUE_DATE_TERMS', doc_id % 5 <> 0 FROM po_header""")
def _(t):
    none = F.lit(None).cast("decimal(18,4)")
    head = t.po_header.select("doc_id", none.alias("subtotal"), none.alias("tax_amount"), none.alias("tax_rate"), "total", F.col("doc_date").alias("issued"), F.date_add("doc_date", 30 + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("due"), "terms")
    lines = t.po_lines.select("doc_id", "quantity", "unit_price", (F.round(F.col("quantity") * F.col("unit_price"), 2) + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("amount"))
    return extraction.consistency_checks(head, lines)


@query("c11_merge_readings", """
    WITH a AS (SELECT doc_id, sku AS path, quantity AS value, confidence FROM po_lines WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, sku AS path, quantity, 0.9 AS confidence FROM dn_lines WHERE doc_id % 4 <> 0)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.path, b.path) AS path, CASE WHEN b.doc_id IS NULL OR a.confidence >= b.confidence THEN a.value ELSE b.quantity END AS value, a.value = b.quantity AS agreement FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.path = b.path""")
def _(t):
    a = t.po_lines.where("doc_id % 3 <> 0").select("doc_id", F.col("sku").alias("path"), F.col("quantity").alias("value"), F.col("confidence").cast("double").alias("confidence"))
    b = t.dn_lines.where("doc_id % 4 <> 0").select("doc_id", F.col("sku").alias("path"), F.col("quantity").alias("value"), F.lit(0.9).alias("confidence"))
    return extraction.merge_readings(a, b)


@query("c17_correction_overlay", "SELECT p.doc_id, p.sku AS path, coalesce(CASE WHEN p.doc_id % 6 = 0 THEN 1.0 END, quantity)::DECIMAL(18,4) AS value, p.doc_id % 6 = 0 AS corrected FROM po_lines p")
def _(t):
    fields = t.po_lines.select("doc_id", F.col("sku").alias("path"), F.col("quantity").alias("value"))
    return extraction.correction_overlay(fields, fields.where("doc_id % 6 = 0").withColumn("value", F.lit(1).cast("decimal(18,4)"))).withColumn("value", F.col("value").cast("decimal(18,4)"))


@query("c18_resolve_vendors", """
    SELECT doc_id, CASE WHEN doc_id % 5 <= 3 THEN doc_id END AS vendor_id, CASE WHEN doc_id % 5 <= 2 THEN 'name' WHEN doc_id % 5 = 3 THEN 'tax_id' END AS method FROM printed_vendors
    UNION ALL SELECT vendor_id + 1000000000, vendor_id, 'likeness' FROM vendors UNION ALL SELECT vendor_id + 2000000000, vendor_id, 'name' FROM vendors UNION ALL SELECT vendor_id + 3000000000, NULL, NULL FROM vendors""")
def _(t):
    """Printed names and tax ids; then every vendor's name misprinted, its alias, and the name of nobody."""
    number, none = F.col("vendor_id").cast("string"), F.lit(None).cast("string").alias("tax_id")
    more = lambda nr, name: t.vendors.select((F.col("vendor_id") + F.lit(nr)).alias("doc_id"), name.alias("name"), none)
    docs = t.printed_vendors.unionByName(more(1_000_000_000, F.concat(F.lit("Kestrell & Sons "), number))).unionByName(more(2_000_000_000, F.concat(F.lit("KSI no. "), number)))
    docs = docs.unionByName(more(3_000_000_000, F.concat(F.lit("Osprey Shipping "), number)))
    return extraction.resolve_vendors(docs, t.vendors, t.vendors.select("vendor_id", F.concat(F.lit("KSI No "), number).alias("alias")))


@query("j17_vendor_candidates", """
    WITH n AS (SELECT vendor_id, 'kestrel and sons ' || vendor_id AS name FROM vendors), q AS (SELECT vendor_id AS k, 'kestrell and sons ' || vendor_id AS key FROM vendors),
    w AS (SELECT vendor_id, name, unnest(string_split(name, ' ')) AS w FROM n), g AS (SELECT DISTINCT vendor_id, substr('  ' || w || ' ', i, 3) AS gram FROM w, range(1, 12) r(i) WHERE i <= length(w) + 1),
    x AS (SELECT k, unnest(string_split(key, ' ')) AS w FROM q), h AS (SELECT DISTINCT k, substr('  ' || w || ' ', i, 3) AS gram FROM x, range(1, 12) r(i) WHERE i <= length(w) + 1),
    gn AS (SELECT vendor_id, count(*) AS m FROM g GROUP BY 1), hn AS (SELECT k, count(*) AS n FROM h GROUP BY 1), s AS (SELECT k, vendor_id, count(*) AS shared FROM h JOIN g USING (gram) GROUP BY 1, 2)
    SELECT k AS doc_id, vendor_id FROM s JOIN gn USING (vendor_id) JOIN hn USING (k) WHERE shared / (n + m - shared) >= 0.2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY shared / (n + m - shared) DESC, vendor_id) <= 25""")
def _(t):
    key = F.concat(F.lit("kestrell and sons "), F.col("vendor_id").cast("string"))
    asked = t.vendors.select(key.alias("key"), F.col("vendor_id").alias("doc_id"))
    names = t.vendors.select("vendor_id", F.concat(F.lit("kestrel and sons "), F.col("vendor_id").cast("string")).alias("v_key"))
    return extraction.vendor_candidates(asked.select("key"), names).join(asked, "key").select("doc_id", "vendor_id")


@query("c19_vendor_keys", "SELECT vendor_id, upper(regexp_replace(tax_id, '[^0-9A-Za-z]', '', 'g')) AS tax_key FROM vendors")
def _(t):
    return t.vendors.select("vendor_id", extraction.tax_id_key(F.col("tax_id")).alias("tax_key"))


# --------------------------------------------------------------------------------- layout


def _words(t):
    """A page an order: a header line, then a line a part, in three columns of words."""
    cell = lambda x, y, s: F.struct(F.lit(float(x)).alias("x0"), y.alias("y0"), s.cast("string").alias("text"))
    nr = F.col("nr")
    rows = t.po_lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sku", "description", "quantity"))).alias("lines"))
    body = rows.select("doc_id", F.posexplode("lines").alias("nr", "l")).select("doc_id", F.inline(F.array(cell(50, 80 + nr * 14.4, F.replace("l.sku", F.lit(" "), F.lit("-"))), cell(200, 80 + nr * 14.4, F.replace("l.description", F.lit(" "), F.lit("-"))), cell(400, 80 + nr * 14.4, F.col("l.quantity")))))
    head = rows.select("doc_id", F.inline(F.array(*[cell(x, F.lit(60.0), F.lit(s)) for x, s in ((50, "Item"), (200, "Description"), (400, "Quantity"))])))
    return head.unionByName(body).select(F.col("doc_id").alias("page_id"), "text", "x0", "y0", (F.col("x0") + 4.5 * F.length("text")).alias("x1"), (F.col("y0") + 9).alias("y1"), F.lit(9.0).alias("size"))


@query("g01_lines_and_segments", "SELECT doc_id AS page_id, count(*) + 1 AS lines, 3 * (count(*) + 1) AS segments FROM po_lines GROUP BY 1")
def _(t):
    return extraction.lay_out(_words(t)).groupBy("page_id").agg(F.countDistinct("line").alias("lines"), F.count("*").alias("segments"))


@query("g04_page_text", """
    SELECT doc_id AS page_id, 'Item' || chr(10) || 'Description' || chr(10) || 'Quantity' || chr(10) || string_agg(replace(sku, ' ', '-') || chr(10) || replace(description, ' ', '-') || chr(10) || CAST(quantity AS VARCHAR), chr(10) ORDER BY sku, description, quantity) AS text FROM po_lines GROUP BY 1""")
def _(t):
    return extraction.page_text(extraction.lay_out(_words(t)))


@query("g05_table_headers", "SELECT DISTINCT doc_id AS page_id, 0 AS line, ['Item', 'Description', 'Quantity'] AS header FROM po_lines")
def _(t):
    return extraction.table_headers(extraction.lay_out(_words(t)))


@query("g07_table_cells", """
    SELECT doc_id AS page_id, unnest([0, 1, 2]) AS "column", unnest([replace(sku, ' ', '-'), replace(description, ' ', '-'), CAST(quantity AS VARCHAR)]) AS text FROM po_lines""")
def _(t):
    lines = stored(extraction.lay_out(_words(t)), "lines")  # pages are laid out once; headers and cells both read them
    return extraction.body_cells(lines, extraction.table_headers(lines)).select("page_id", "column", "text")


def _form(t):
    """A page an order like a printed form: a title, labels with their values beside them, and two columns of prose."""
    cell = lambda x, y, s, size=9.0: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), s.cast("string").alias("text"), F.lit(size).alias("size"))
    at = lambda x, y, text: [cell(x + 4.5 * text.index(w), y, F.lit(w)) for w in text.split()]
    words = [cell(50, 40, F.lit("Order"), 14.0), *at(50, 80, "Number:"), *at(50, 92, "Date:"), *at(50, 104, "Total:"), cell(110, 80, F.col("number")), cell(110, 92, F.col("doc_date")), cell(300, 104, F.col("total"))]
    words += [*at(50, 200, "Goods stay ours"), *at(50, 212, "until paid."), *at(350, 200, "Notices go by"), *at(350, 212, "letter only.")]
    rows = t.po_header.select("doc_id", F.inline(F.array(*words)))
    return rows.select(F.col("doc_id").alias("page_id"), "text", "x0", "y0", (F.col("x0") + 4.5 * F.length("text")).alias("x1"), (F.col("y0") + F.col("size")).alias("y1"), "size")


FORM = """unnest([{0}]) AS block, unnest([{1}]) AS kind, unnest([{2}]) AS text FROM po_header"""
PROSE = "'Goods stay ours' || chr(10) || 'until paid.', 'Notices go by' || chr(10) || 'letter only.'"


@query("g02_blocks_in_reading_order", "SELECT doc_id AS page_id, " + FORM.format("0, 1, 2, 3, 4, 5", "'heading', 'text', 'text', 'text', 'text', 'text'", "'Order', 'Number:' || chr(10) || 'Date:' || chr(10) || 'Total:', number || chr(10) || doc_date, total::VARCHAR, " + PROSE))
def _(t):
    return extraction.blocks(_form(t), merge=False).select("page_id", "block", "kind", "text")


@query("g03_labels_with_values", "SELECT doc_id AS page_id, " + FORM.format("0, 1, 2, 3, 4", "'heading', 'text', 'text', 'text', 'text'", "'Order', 'Number: ' || number || chr(10) || 'Date: ' || doc_date || chr(10) || 'Total:', total::VARCHAR, " + PROSE))
def _(t):
    return extraction.blocks(_form(t)).select("page_id", "block", "kind", "text")


@query("w16_line_bands", "SELECT doc_id AS page_id, count(*) + 1 AS lines FROM po_lines GROUP BY 1")
def _(t):
    return extraction.lay_out(_words(t)).groupBy("page_id").agg(F.countDistinct("line").alias("lines"))


@query("w14_stitched_tables", """
    WITH x AS (SELECT DISTINCT user_id AS doc_id, CAST(day(ts) AS INT) AS page, event_type AS header FROM events), y AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id, header ORDER BY page) AS grp FROM x)
    SELECT doc_id, page, header, dense_rank() OVER (PARTITION BY doc_id, header ORDER BY grp) AS "table" FROM y""")
def _(t):
    pages = t.events.select(F.col("user_id").alias("doc_id"), F.dayofmonth("ts").alias("page"), F.col("event_type").alias("header")).distinct()
    return extraction.stitch_tables(pages)


# ------------------------------------------------------------------------------ decisions


@query("b01_intents", "SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '(?i)\\b(compare|difference|differ|match)\\w*') THEN 'COMPARE' WHEN regexp_matches(text, '(?i)\\bduplicate\\w*') THEN 'DUPLICATES' WHEN regexp_matches(text, '(?i)\\b(policy|allowed|limit|rule)\\w*') THEN 'POLICY_QUESTION' WHEN regexp_matches(text, '(?i)\\b(summary|summari[sz]e|overview)\\b') THEN 'SUMMARY' WHEN text IS NOT NULL THEN 'INVESTIGATE' END AS intent FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", "role", decisions.intent(F.col("text")).alias("intent"))


#: Outcomes of the line and the header rules of each invoice, as SQL.
OUTCOMES = f"""{LINE_RULES}, outcomes AS (
    SELECT doc_id, code, outcome FROM results UNION ALL SELECT i.doc_id, unnest(['INV_PO_VENDOR', 'INV_PO_CURRENCY', 'INV_PO_PAYMENT_TERMS']),
        unnest([CASE WHEN i.vendor_id = o.vendor_id THEN 'PASS' ELSE 'FAIL' END, CASE WHEN i.currency = o.currency THEN 'PASS' ELSE 'FAIL' END, CASE WHEN i.terms = o.terms THEN 'PASS' ELSE 'FAIL' END])
    FROM inv_header i JOIN po_header o ON i.po_number = o.number)"""
SEVERE = ", ".join(f"'{code}'" for code, _, _, severity, _ in rules.RULES if severity in ("HIGH", "CRITICAL"))


def _outcomes(t):
    return rules.line_rules(_items(t)).select("doc_id", "code", "outcome").unionByName(rules.header_rules(matching.compare_headers(t.inv_header, t.po_header)))


@query("b02_recommendation", f"""
    WITH {OUTCOMES}, per AS (SELECT doc_id, count(*) FILTER (WHERE outcome = 'FAIL') AS failing, count(*) FILTER (WHERE outcome = 'WARN') AS attention, bool_or(outcome = 'FAIL' AND code IN ({SEVERE})) AS severe, FALSE AS duplicate FROM outcomes GROUP BY 1)
    SELECT *, CASE WHEN severe THEN 'HOLD' WHEN failing > 0 THEN 'REVIEW' WHEN attention > 0 THEN 'CHECK' ELSE 'APPROVE' END AS action FROM per""")
def _(t):
    return decisions.recommendation(_outcomes(t).join(rules.rule_frame(t.spark).select("code", "severity"), "code"))


@query("b03_confidence", """
    SELECT doc_id, round(least(1, greatest(0, 1 + sum(effect))), 2)::DOUBLE AS score, CASE WHEN round(1 + sum(effect), 2) >= 0.8 THEN 'HIGH' WHEN round(1 + sum(effect), 2) >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (
        SELECT user_id AS doc_id, event_type AS factor, min(CASE event_type WHEN 'error' THEN CAST(-0.3 AS DOUBLE) WHEN 'purchase' THEN -0.15 ELSE -0.05 END) AS effect FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    effect = F.when(F.col("event_type") == "error", -0.3).when(F.col("event_type") == "purchase", -0.15).otherwise(-0.05)
    return decisions.confidence(t.events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("factor"), effect.alias("effect")), "doc_id")


@query("b04_maker_checker", "SELECT l_orderkey AS doc_id, NOT list_contains(list(DISTINCT l_returnflag), 'R') AS may_approve FROM lineitem GROUP BY 1")
def _(t):
    makers = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("l_returnflag").alias("makers"))
    return makers.select("doc_id", decisions.may_approve(F.col("makers"), "R").alias("may_approve"))


@query("b05_snapshots", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS sha256 FROM nation""")
def _(t):
    return decisions.snapshot(t.nation, ["n_name", "n_regionkey"]).select("n_nationkey", "sha256")


@query("k11_assessment", f"""
    WITH {OUTCOMES} SELECT doc_id, count(*) FILTER (WHERE outcome = 'PASS') AS pass, count(*) FILTER (WHERE outcome = 'WARN') AS warn, count(*) FILTER (WHERE outcome = 'FAIL') AS fail,
        count(*) FILTER (WHERE outcome = 'NOT_APPLICABLE') AS not_applicable FROM outcomes GROUP BY 1""")
def _(t):
    """All rules of each invoice in one pass."""
    return _outcomes(t).groupBy("doc_id").agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("PASS", "WARN", "FAIL", "NOT_APPLICABLE")])
