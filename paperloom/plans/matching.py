"""Comparison, rules, duplicates and reviews over derived orders, invoices and delivery notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, rules
from .registry import query

KEY = "nullif(regexp_replace(upper(sku), '[^0-9A-Z]', '', 'g'), '')"
PAIRS = f"""
    l AS (SELECT doc_id, {KEY} AS key, quantity, unit_price, confidence < 0.75 AS weak, row_number() OVER (PARTITION BY doc_id, {KEY} ORDER BY quantity, unit_price) AS nr FROM inv_lines),
    r AS (SELECT doc_id, {KEY} AS key, quantity, unit_price, confidence < 0.75 AS weak, row_number() OVER (PARTITION BY doc_id, {KEY} ORDER BY quantity, unit_price) AS nr FROM po_lines),
    p AS (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.key, r.key) AS key, l.quantity AS lq, r.quantity AS rq, l.unit_price AS lp, r.unit_price AS rp, l.weak AS lw, r.weak AS rw,
        l.doc_id IS NOT NULL AS lh, r.doc_id IS NOT NULL AS rh FROM l FULL JOIN r ON l.doc_id = r.doc_id AND l.key = r.key AND l.nr = r.nr),
    d AS (SELECT *, count(*) FILTER (WHERE lh) OVER w AS n_left, count(*) FILTER (WHERE rh) OVER w AS n_right, coalesce(bool_or(lw AND NOT rh) OVER w, FALSE) AS extra_weak, coalesce(bool_or(rw AND NOT lh) OVER w, FALSE) AS open_weak
        FROM p WINDOW w AS (PARTITION BY doc_id)),
    c AS (SELECT doc_id FROM inv_header i JOIN po_header o USING (doc_id) WHERE i.currency <> o.currency),
    notes AS (SELECT doc_id, {KEY} AS key, sum(quantity) AS delivered, bool_or(confidence < 0.75) AS dw FROM dn_lines GROUP BY 1, 2),
    items AS (
        SELECT doc_id, key, 'unit_price' AS check, CASE WHEN lp IS NULL OR rp IS NULL THEN 'MISSING' WHEN doc_id IN (FROM c) THEN 'UNCERTAIN' WHEN abs(lp - rp) <= 0.01 THEN 'MATCH' WHEN lw OR rw THEN 'UNCERTAIN' ELSE 'MISMATCH' END AS status, lp - rp AS difference FROM d WHERE lh AND rh
        UNION ALL SELECT doc_id, key, 'quantity_ordered', CASE WHEN lq = rq THEN 'MATCH' WHEN lw OR rw THEN 'UNCERTAIN' ELSE 'MISMATCH' END, lq - rq FROM d WHERE lh AND rh
        UNION ALL SELECT doc_id, key, 'line_on_order', CASE WHEN n_right = 0 OR lw OR open_weak THEN 'UNCERTAIN' ELSE 'MISSING' END, NULL FROM d WHERE lh AND NOT rh
        UNION ALL SELECT doc_id, key, 'line_fulfilled', CASE WHEN n_left = 0 OR rw OR extra_weak THEN 'UNCERTAIN' ELSE 'MISSING' END, NULL FROM d WHERE rh AND NOT lh
        UNION ALL SELECT l.doc_id, l.key, CASE WHEN delivered IS NULL THEN 'line_delivered' ELSE 'quantity_delivered' END, CASE WHEN delivered IS NULL THEN CASE WHEN weak THEN 'UNCERTAIN' ELSE 'MISSING' END
            WHEN quantity = delivered THEN 'MATCH' WHEN weak OR dw THEN 'UNCERTAIN' ELSE 'MISMATCH' END, quantity - delivered
            FROM l LEFT JOIN notes USING (doc_id, key) WHERE l.doc_id IN (SELECT doc_id FROM notes))"""


def _items(t, checks=None):
    unlike = t.inv_header.select("doc_id", F.col("currency").alias("a")).join(t.po_header.select("doc_id", "currency"), "doc_id").select("doc_id", (F.col("a") != F.col("currency")).alias("currencies_differ"))
    return matching.compare_lines(t.inv_lines, t.po_lines, t.dn_lines, currencies_differ=unlike, checks=checks)


@query("j12_three_way_match", f"WITH {PAIRS} SELECT doc_id, key, \"check\", status, CAST(difference AS DECIMAL(18,4)) AS difference FROM items")
def three_way(t):
    return _items(t)


@query("j13_delivery_against_order", f"""
    SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.key, o.key) AS key, CASE WHEN n.key IS NULL THEN 'line_fulfilled' WHEN o.key IS NULL THEN 'line_on_order' ELSE 'quantity_ordered' END AS "check",
        CASE WHEN n.key IS NULL THEN CASE WHEN NOT EXISTS (SELECT 1 FROM dn_lines x WHERE x.doc_id = o.doc_id) THEN 'UNCERTAIN' ELSE 'MISSING' END WHEN n.quantity = o.quantity THEN 'MATCH' ELSE 'MISMATCH' END AS status
    FROM (SELECT doc_id, {KEY} AS key, quantity FROM dn_lines) n FULL JOIN (SELECT doc_id, {KEY} AS key, quantity FROM po_lines) o ON n.doc_id = o.doc_id AND n.key = o.key""")
def _(t):
    notes = t.dn_lines.withColumn("unit_price", F.lit(None).cast("decimal(18,4)"))
    return matching.compare_lines(notes, t.po_lines, None).where("check <> 'unit_price'").select("doc_id", "key", "check", "status")


@query("j14_pick_order", """
    SELECT i.doc_id, max_by(o.doc_id, (CASE WHEN i.vendor_id = o.vendor_id THEN 1e15 ELSE 0 END + epoch(o.doc_date) + o.doc_id / 1e6)) AS order_id FROM inv_header i JOIN po_header o ON i.po_number = o.number GROUP BY 1""")
def _(t):
    return matching.pick_order(t.inv_header.select("doc_id", "vendor_id", F.col("po_number").alias("number")), t.po_header, "number")


@query("j10_fuzzy_line_match", """
    SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, l.line AS left_line, r.line AS right_line FROM (SELECT doc_id, regexp_extract(sku, '([0-9]+)', 1)::BIGINT AS line FROM inv_lines) l
    FULL JOIN (SELECT doc_id, regexp_extract(sku, '([0-9]+)', 1)::BIGINT AS line FROM po_lines) r ON l.doc_id = r.doc_id AND l.line = r.line""")
def _(t):
    number = F.regexp_extract("sku", "([0-9]+)", 1).cast("long")
    left, right = (x.select("doc_id", number.alias("line"), "sku", "description") for x in (t.inv_lines, t.po_lines))
    return matching.match_lines_fuzzy(left, right)


@query("k03_header_match", """
    SELECT doc_id, "check", CASE WHEN a IS NULL OR b IS NULL THEN 'MISSING' WHEN a = b THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM (
        SELECT i.doc_id, unnest(['vendor_id', 'currency', 'terms']) AS "check", unnest([i.vendor_id::VARCHAR, i.currency, i.terms::VARCHAR]) AS a, unnest([o.vendor_id::VARCHAR, o.currency, o.terms::VARCHAR]) AS b
        FROM inv_header i JOIN po_header o ON i.po_number = o.number)""")
def headers(t):
    return matching.compare_headers(t.inv_header, t.po_header)


@query("a15_comparison_summary", f"WITH {PAIRS} SELECT doc_id, count(*) FILTER (WHERE status = 'MATCH') AS match, count(*) FILTER (WHERE status = 'MISMATCH') AS mismatch, count(*) FILTER (WHERE status = 'MISSING') AS missing, count(*) FILTER (WHERE status = 'UNCERTAIN') AS uncertain FROM items GROUP BY 1")
def _(t):
    return _items(t).groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("MATCH", "MISMATCH", "MISSING", "UNCERTAIN")])


@query("a16_sum_compare", f"SELECT doc_id, sum(quantity) AS billed FROM inv_lines GROUP BY 1 HAVING sum(quantity) > 100")
def _(t):
    return t.inv_lines.groupBy("doc_id").agg(F.sum("quantity").alias("billed")).where("billed > 100")


DUPLICATES = """
    dup AS (
        SELECT a.doc_id, b.doc_id AS original_id, 'SAME_VENDOR_AND_NUMBER' AS kind, TRUE AS strong, b.doc_date AS original_date FROM inv_header a JOIN inv_header b ON a.vendor_id = b.vendor_id AND a.number = b.number AND (b.doc_date, b.doc_id) < (a.doc_date, a.doc_id)
        UNION ALL SELECT a.doc_id, b.doc_id, 'SAME_VENDOR_AMOUNT_AND_DATE', FALSE, b.doc_date FROM inv_header a JOIN inv_header b ON a.vendor_id = b.vendor_id AND a.total = b.total AND a.currency = b.currency AND a.number <> b.number
            AND (b.doc_date, b.doc_id) < (a.doc_date, a.doc_id) AND a.doc_date - b.doc_date <= 7)"""


def _many(t):
    """Invoices, each also as a later copy of another number."""
    return t.inv_header.unionByName(t.inv_header.where("doc_id % 5 = 0").select(
        (-F.col("doc_id") - 1).alias("doc_id"), F.concat("number", F.lit("A")).alias("number"), "po_number", "vendor_id", "currency", F.date_add("doc_date", 3).alias("doc_date"), "total", "terms"))


MANY = """many AS (SELECT * FROM inv_header UNION ALL SELECT -doc_id - 1, number || 'A', po_number, vendor_id, currency, CAST(doc_date + 3 AS DATE), total, terms FROM inv_header WHERE doc_id % 5 = 0)"""


@query("k09_duplicates", f"WITH {MANY}, {DUPLICATES.replace('inv_header', 'many').replace('a.number = b.number', 'upper(a.number) = upper(b.number)')} SELECT doc_id, original_id, kind, strong FROM dup")
def _(t):
    return matching.find_duplicates(_many(t)).select("doc_id", "original_id", "kind", "strong")


@query("k10_strongest_duplicate", f"WITH {MANY}, {DUPLICATES.replace('inv_header', 'many')} SELECT doc_id, original_id, kind FROM dup QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY strong DESC, original_date, original_id) = 1")
def _(t):
    return matching.strongest(_many(t)).drop("strong")


LINE_RULES = f"""{PAIRS}, s AS (
    SELECT doc_id, count(*) FILTER (WHERE "check" = 'unit_price') AS n1, count(*) FILTER (WHERE "check" = 'unit_price' AND status = 'MISMATCH') AS f1, count(*) FILTER (WHERE "check" = 'unit_price' AND status = 'UNCERTAIN') AS u1,
        count(*) FILTER (WHERE "check" = 'quantity_ordered') AS n2, count(*) FILTER (WHERE "check" = 'quantity_ordered' AND status = 'MISMATCH' AND difference > 0) AS f2, count(*) FILTER (WHERE "check" = 'quantity_ordered' AND status = 'UNCERTAIN') AS u2,
        count(*) FILTER (WHERE "check" IN ('quantity_delivered', 'line_delivered')) AS n3, count(*) FILTER (WHERE ("check" = 'quantity_delivered' AND status = 'MISMATCH' AND difference > 0) OR ("check" = 'line_delivered' AND status = 'MISSING')) AS f3,
        count(*) FILTER (WHERE "check" IN ('quantity_delivered', 'line_delivered') AND status = 'UNCERTAIN') AS u3, 1 AS n4, count(*) FILTER (WHERE "check" = 'line_on_order' AND status = 'MISSING') AS f4, count(*) FILTER (WHERE "check" = 'line_on_order' AND status = 'UNCERTAIN') AS u4
    FROM items GROUP BY doc_id),
    results AS (SELECT doc_id, code, CASE WHEN n = 0 THEN 'NOT_APPLICABLE' WHEN f > 0 THEN 'FAIL' WHEN u > 0 THEN 'WARN' ELSE 'PASS' END AS outcome, f AS failing FROM (
        SELECT doc_id, unnest(['INV_PO_UNIT_PRICE', 'INV_PO_QUANTITY', 'INV_DELIVERED_QUANTITY', 'INV_LINE_NOT_ORDERED']) AS code, unnest([n1, n2, n3, n4]) AS n, unnest([f1, f2, f3, f4]) AS f, unnest([u1, u2, u3, u4]) AS u FROM s))"""


@query("l02_line_rules", f"WITH {LINE_RULES} SELECT * FROM results")
def line_rules(t):
    return rules.line_rules(_items(t))


@query("l02_price_differs", f"WITH {LINE_RULES} SELECT doc_id, failing FROM results WHERE code = 'INV_PO_UNIT_PRICE' AND outcome = 'FAIL'")
def flagship(t):
    return rules.line_rules(_items(t, ("unit_price",))).where("code = 'INV_PO_UNIT_PRICE' AND outcome = 'FAIL'").select("doc_id", "failing")


@query("l06_header_rules", """
    SELECT i.doc_id, unnest(['INV_PO_VENDOR', 'INV_PO_CURRENCY', 'INV_PO_PAYMENT_TERMS']) AS code,
        unnest([CASE WHEN i.vendor_id = o.vendor_id THEN 'PASS' ELSE 'FAIL' END, CASE WHEN i.currency = o.currency THEN 'PASS' ELSE 'FAIL' END, CASE WHEN i.terms = o.terms THEN 'PASS' ELSE 'FAIL' END]) AS outcome
    FROM inv_header i JOIN po_header o ON i.po_number = o.number""")
def _(t):
    return rules.header_rules(matching.compare_headers(t.inv_header, t.po_header))


@query("l01_duplicate_rule", f"WITH {MANY}, {DUPLICATES.replace('inv_header', 'many')} SELECT m.doc_id, CASE WHEN bool_or(strong) THEN 'FAIL' WHEN count(d.doc_id) > 0 THEN 'WARN' ELSE 'PASS' END AS outcome FROM many m LEFT JOIN dup d ON m.doc_id = d.doc_id GROUP BY 1")
def _(t):
    return rules.duplicate_rule(_many(t), matching.strongest(_many(t)))


@query("l07_order_reference", "SELECT doc_id, CASE WHEN po_number IS NULL THEN 'FAIL' WHEN po_number NOT IN (SELECT number FROM po_header WHERE status <> 'P') THEN 'WARN' ELSE 'PASS' END AS outcome FROM inv_header")
def _(t):
    return rules.order_reference(t.inv_header, t.po_header.where("status <> 'P'"), F.col("po_number"), F.col("number"))


@query("l08_arithmetic", """
    SELECT doc_id, CASE WHEN bool_or(off AND NOT weak) THEN 'FAIL' WHEN bool_or(off) THEN 'WARN' ELSE 'PASS' END AS outcome FROM (
        SELECT doc_id, abs(quantity * unit_price - round(quantity * unit_price)) > 0.45 AS off, confidence < 0.75 AS weak FROM inv_lines) GROUP BY 1""")
def _(t):
    amount = F.col("quantity") * F.col("unit_price")
    off = F.abs(amount - F.round(amount)) > 0.45
    return t.inv_lines.groupBy("doc_id").agg(F.when(F.bool_or(off & (F.col("confidence") >= 0.75)), "FAIL").when(F.bool_or(off), "WARN").otherwise("PASS").alias("outcome"))


@query("l09_mandatory_fields", "SELECT doc_id, list_filter([CASE WHEN number IS NULL THEN 'number' END, CASE WHEN po_number IS NULL THEN 'po_number' END, CASE WHEN total IS NULL THEN 'total' END], lambda x: x IS NOT NULL) AS missing FROM inv_header")
def _(t):
    return t.inv_header.select("doc_id", rules.mandatory_fields(["number", "po_number", "total"]).alias("missing"))


@query("l10_known_vendor", "SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM vendors v WHERE v.vendor_id = i.vendor_id) THEN 'PASS' ELSE 'WARN' END AS outcome FROM inv_header i")
def _(t):
    known = t.vendors.select("vendor_id", F.lit("PASS").alias("outcome"))
    return t.inv_header.join(known, "vendor_id", "left").select("doc_id", F.coalesce("outcome", F.lit("WARN")).alias("outcome"))


@query("l11_contract_expiry", """
    SELECT doc_id, CASE WHEN effective_to IS NULL THEN 'NOT_APPLICABLE' WHEN effective_to < DATE '2025-06-01' THEN CASE WHEN doc_id % 8 = 0 THEN 'WARN' ELSE 'FAIL' END WHEN effective_to <= DATE '2025-07-01' THEN 'WARN' ELSE 'PASS' END AS outcome FROM versions""")
def _(t):
    today = F.lit("2025-06-01").cast("date")
    return t.versions.select("doc_id", rules.contract_expiry(F.col("effective_to"), F.col("doc_id") % 8 == 0, today, 30).alias("outcome"))


@query("l12_terms_limit", "SELECT doc_id, CASE WHEN coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE terms END, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 70 END) IS NULL THEN 'NOT_APPLICABLE' WHEN coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE terms END, 70) > 60 THEN 'FAIL' ELSE 'PASS' END AS outcome FROM inv_header")
def _(t):
    terms = F.when(F.col("doc_id") % 3 != 0, F.col("terms"))
    due = F.when(F.col("doc_id") % 4 != 0, F.date_add("doc_date", 70))
    return t.inv_header.select("doc_id", rules.terms_limit(terms, F.col("doc_date"), due, 60).alias("outcome"))


@query("l16_default_rules", "SELECT doc_type, n FROM (VALUES ('INVOICE', 14), ('PURCHASE_ORDER', 3), ('DELIVERY_NOTE', 6), ('RECEIPT', 2), ('CONTRACT', 5)) v(doc_type, n)")
def _(t):
    return rules.rule_frame(t.spark).select(F.explode("applies_to").alias("doc_type")).groupBy("doc_type").agg(F.count("*").cast("int").alias("n"))


SEVERITY = {c: s for c, _, _, s, _ in rules.RULES}
ITEMS = f"""{LINE_RULES}, sev AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {rules.SEVERITIES.index(s) + 1})" for c, s in SEVERITY.items())}) v(code, rank)),
    open_items AS (SELECT doc_id, code, 'DISCREPANCY' AS category, CASE outcome WHEN 'WARN' THEN greatest(1, rank - 1) ELSE rank END AS rank FROM results JOIN sev USING (code) WHERE outcome IN ('FAIL', 'WARN'))"""


def _review_items(t):
    return rules.review_items(rules.line_rules(_items(t)).join(rules.rule_frame(t.spark).select("code", "severity"), "code"))


@query("v01_review_items", f"WITH {ITEMS} SELECT doc_id, code, category, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][rank] AS severity FROM open_items")
def _(t):
    return _review_items(t).select("doc_id", "code", "category", "severity")


@query("v02_review_tasks", f"WITH {ITEMS} SELECT doc_id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(rank)] AS priority, 'DISCREPANCY' AS task_type, count(*) AS n_items FROM open_items WHERE NOT (doc_id % 3 = 0 AND code = 'INV_PO_QUANTITY') GROUP BY doc_id")
def _(t):
    seen = t.po_header.where("doc_id % 3 = 0").select("doc_id", F.lit("INV_PO_QUANTITY").alias("code"))
    return rules.tasks(_review_items(t), acknowledged=seen)


@query("v04_due_and_overdue", """
    SELECT task_id, created_at + (CASE priority WHEN 'URGENT' THEN 4 WHEN 'HIGH' THEN 24 WHEN 'NORMAL' THEN 72 ELSE 168 END) * INTERVAL 1 HOUR AS due, state = 'OPEN' AND created_at + (CASE priority WHEN 'URGENT' THEN 4 WHEN 'HIGH' THEN 24 WHEN 'NORMAL' THEN 72 ELSE 168 END) * INTERVAL 1 HOUR < TIMESTAMP '2024-01-20 00:00:00' AS overdue FROM tasks""")
def _(t):
    due = rules.due_at(F.col("created_at"), F.col("priority"), {"URGENT": 4, "HIGH": 24, "NORMAL": 72, "LOW": 168})
    return t.tasks.select("task_id", due.alias("due"), ((F.col("state") == "OPEN") & (due < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))).alias("overdue"))
