"""Normalisers over printed values that are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity, values
from ..operators import likeness, matching, retrieval
from .registry import query

def _sql(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS value FROM documents"


def _register(name, expression, column):
    query(name, _sql(expression) if expression else None)(lambda t: t.documents.select("doc_id", column(F.col("text")).alias("value")))


SPACED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_register("x01_collapse", SPACED, values.collapse)
_register("x02_squash", r"regexp_replace(lower(text), '\s+', '', 'g')", values.squash)
_register("x03_label", r"list_aggregate(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '[#№º°]', ' no ', 'g'), '[^\pL\pN_&%\s]', ' ', 'g'), '\s+'), lambda w: w <> ''), lambda w: CASE WHEN w IN ('number', 'num', 'nr', 'nbr') THEN 'no' ELSE w END), 'string_agg', ' ')", lambda c: F.nullif(values.label(c), F.lit("")))
_register("x04_reference_key", "nullif(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^0-9A-Z]', '', 'g'), '')", matching.reference_key)
_register("x08_slug", r"regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '')", values.slug)
_register("x09_plain_text", r"CASE WHEN trim(text) <> '' AND NOT regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') THEN trim(text, ' ') END", values.plain_text)
_register("x10_clip", f"CASE WHEN length({SPACED}) <= 40 THEN {SPACED} ELSE rtrim(left({SPACED}, 39)) || '…' END", lambda c: values.clip(c, 40))
_register("x11_classifier_text", r"trim(regexp_replace(regexp_replace(lower(left(text, 6000)), '[0-9]', '0', 'g'), '\s+', ' ', 'g'))", values.classifier_text)
_register("x12_enough_text", r"length(regexp_replace(text, '\s+', '', 'g')) >= 20", values.enough_text)
_register("x13_clause_text", r"trim(regexp_replace(regexp_replace(lower(text), '[^\pL\pN_%€$£.,]', ' ', 'g'), '\s+', ' ', 'g'))", values.clause_text)
_register("x14_identifier", r"CASE WHEN regexp_matches(text, '[A-Za-z0-9]') THEN upper(regexp_replace(regexp_replace(replace(text, 'ß', 'ss'), '^[ :;,.]+|[ :;,.]+$', '', 'g'), '\s+', '', 'g')) END", values.identifier)
_register("x17_yes_no", f"CASE WHEN regexp_matches(text, '{values.phrase_pattern(values.DENIALS, True)}') THEN FALSE WHEN regexp_matches(text, '{values.phrase_pattern(values.ASSENTS, False)}') THEN TRUE END", values.yes_no)
_register("x01_nfkc", None, values.nfkc)
_register("n14_estimate_tokens", "ceil(length(text) / 4)::BIGINT", values.estimate_tokens)


@query("x20_document_numbers", r"""
    WITH f AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9/-]{3,}'), lambda t: regexp_matches(t, '[0-9]') AND NOT regexp_full_match(t, '(19|20)[0-9][0-9]')) AS found FROM documents)
    SELECT doc_id, list_filter(found, lambda t, i: list_position(found, t) = i)[1:5] AS value FROM f""")
def _(t):
    return t.documents.select("doc_id", values.document_numbers(F.col("text")).alias("value"))


@query("x15_email", r"SELECT doc_id, nullif(lower(regexp_extract(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+')), '') AS email FROM documents")
def _(t):
    return t.documents.select("doc_id", values.email(F.col("text")).alias("email"))


@query("x16_phone", r"""
    WITH p AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '' END || '49 (' || user_id || ') ' || event_id || '-00' AS printed FROM events),
    q AS (SELECT event_id, regexp_extract(printed, '\+?\d[\d\s().-]{5,}\d') AS found FROM p)
    SELECT event_id, CASE WHEN length(regexp_replace(found, '\D', '', 'g')) BETWEEN 7 AND 15 THEN CASE WHEN starts_with(found, '+') THEN '+' ELSE '' END || regexp_replace(found, '\D', '', 'g') END AS phone FROM q""")
def _(t):
    printed = F.concat(F.when(F.col("event_id") % 2 == 0, "+").otherwise(""), F.lit("49 ("), F.col("user_id").cast("string"), F.lit(") "), F.col("event_id").cast("string"), F.lit("-00"))
    return t.events.select("event_id", values.phone(printed).alias("phone"))


@query("x06_organization_key", "SELECT doc_id, CASE WHEN doc_id % 5 <= 2 THEN 'kestrel and sons ' || doc_id WHEN doc_id % 5 = 3 THEN 'unknown trading' ELSE '' END AS key FROM printed_vendors")
def _(t):
    return t.printed_vendors.select("doc_id", similarity.organization("name").alias("key"))


@query("x07_name_similarity")
def _(t):
    pairs = t.printed_vendors.join(t.vendors.select(F.col("vendor_id").alias("doc_id"), F.col("name").alias("known")), "doc_id")
    return pairs.select("doc_id", similarity.name_score(similarity.organization("name"), similarity.organization("known")).alias("score"))


@query("x18_keyword_evidence", r"""
    SELECT doc_id, cue FROM documents, (SELECT unnest(['licensed', 'version', 'the', 'der', 'que']) AS cue) c WHERE regexp_matches(lower(text), '(^|[^\pL\pN_])' || cue || '($|[^\pL\pN_])')""")
def _(t):
    cues = ["licensed", "version", "the", "der", "que"]
    found = F.array_compact(F.array(*[F.when(F.lower("text").rlike(rf"\b{c}\b"), F.lit(c)) for c in cues]))
    return t.documents.select("doc_id", F.explode(found).alias("cue"))


@query("x21_item_key", "SELECT doc_id, CASE WHEN length(k) <= 300 THEN k ELSE left(k, 283) || '#' || left(sha256(k), 16) END AS key FROM (SELECT doc_id, 'rule:' || doc_id || ':' || text AS k FROM documents)")
def _(t):
    return t.documents.select("doc_id", values.item_key(F.lit("rule"), F.col("doc_id").cast("string"), F.col("text")).alias("key"))


# ---------------------------------------------------------------------- numbers and money


@query("n03_amounts", "SELECT doc_id, total AS value, FALSE AS ambiguous FROM (SELECT doc_id, round(total, 2) AS total FROM po_header)")
def _(t):
    cents = F.format_number(F.round("total", 2).cast("double"), 2)
    read = t.po_header.select("doc_id", values.amount(F.concat(F.lit("VAT (20%) total "), cents, F.lit(" USD"))).alias("x"))
    return read.select("doc_id", "x.value", "x.ambiguous")


@query("n02_ambiguous_amounts", "SELECT l_orderkey, l_partkey, CAST(l_partkey % 9 + 1 AS DECIMAL(18,4)) * 1000 + l_orderkey % 1000 AS value, TRUE AS ambiguous FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    printed = F.format_string("%d,%03d", F.col("l_partkey") % 9 + 1, F.col("l_orderkey") % 1000)
    return rows.select("l_orderkey", "l_partkey", values.amount(printed).alias("x")).select("l_orderkey", "l_partkey", "x.value", "x.ambiguous")


@query("n04_percent", "SELECT l_orderkey, l_linenumber, count(*) AS n, max(CAST(round(l_discount * 100, 2) AS DECIMAL(18,6)) / 100) AS rate FROM lineitem GROUP BY 1, 2")
def _(t):
    printed = F.concat(F.lit("discount "), F.round(F.col("l_discount") * 100, 2).cast("decimal(18,2)").cast("string"), F.lit(" %"))
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max(values.percent(printed)).alias("rate"))


@query("n05_decimal_text", r"SELECT doc_id, CASE WHEN strpos(t, '.') > 0 THEN regexp_replace(t, '\.?0+$', '') ELSE t END AS value FROM (SELECT doc_id, CAST(total AS VARCHAR) AS t FROM po_header)")
def _(t):
    return t.po_header.select("doc_id", values.decimal_text(F.col("total")).alias("value"))


PRINTED_MONEY = "CASE event_id % 7 WHEN 0 THEN 'total EUR ' WHEN 1 THEN 'US$' WHEN 2 THEN '£' WHEN 3 THEN 'Rs. ' WHEN 4 THEN '$' WHEN 5 THEN '¥' ELSE 'sum ' END || event_id"


def _printed_money(t):
    return t.events.select("event_id", F.expr(PRINTED_MONEY.replace("event_id %", "event_id %").replace("|| event_id", "|| CAST(event_id AS STRING)")).alias("printed"))


@query("n06_currency", """
    SELECT event_id, ['EUR', 'USD', 'GBP', 'INR', 'USD', 'JPY', NULL][event_id % 7 + 1] AS code, [TRUE, TRUE, TRUE, TRUE, FALSE, FALSE, NULL][event_id % 7 + 1] AS explicit FROM events""")
def _(t):
    return _printed_money(t).select("event_id", values.currency(F.col("printed")).alias("x")).select("event_id", "x.code", "x.explicit")


@query("n07_currencies", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN ['EUR'] WHEN 1 THEN ['USD'] WHEN 2 THEN ['GBP'] ELSE [] END AS codes FROM events")
def _(t):
    return _printed_money(t).select("event_id", values.currencies(F.col("printed")).alias("codes"))


@query("n08_decimal_comma", r"""
    SELECT lang, CASE WHEN commas > points THEN TRUE WHEN points > commas THEN FALSE END AS decimal_comma FROM (
        SELECT lang, sum(len(regexp_extract_all(text, '\d,\d{2}\b'))) AS commas, sum(len(regexp_extract_all(text, '\d\.\d{2}\b'))) AS points FROM documents GROUP BY lang)""")
def _(t):
    votes = t.documents.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(r"\d,\d{2}\b"))).alias("commas"), F.sum(F.regexp_count("text", F.lit(r"\d\.\d{2}\b"))).alias("points"))
    return votes.select("lang", F.when(F.col("commas") > F.col("points"), True).when(F.col("points") > F.col("commas"), False).alias("decimal_comma"))


@query("n09_normal_values")
def _(t):
    kinds = F.array(*map(F.lit, ["MONEY", "DATE", "BOOLEAN", "CURRENCY", "PERCENT", "DAYS", "INTEGER", "IDENTIFIER", "EMAIL", "TEXT"]))
    rows = _printed_money(t).select("event_id", "printed", F.get(kinds, (F.col("event_id") % 10).cast("int")).alias("kind"))
    return rows.select("event_id", "kind", values.normal_value(F.col("kind"), F.col("printed")).alias("x")).select("event_id", "kind", "x.value", "x.status")


LUHN = """(SELECT sum(CASE WHEN (length(d) - i) % 2 = 0 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END) FROM (SELECT i, CAST(substr(d, i, 1) AS INT) AS v FROM range(1, length(d) + 1) r(i))) % 10 = 0"""


@query("n12_luhn", f"SELECT event_id, {LUHN} AS valid FROM (SELECT event_id, CAST(4000000000000000 + event_id * 7919 AS VARCHAR) AS d FROM events)")
def _(t):
    return t.events.select("event_id", values.luhn((4000000000000000 + F.col("event_id") * 7919).cast("string")).alias("valid"))


@query("n13_iban", """
    SELECT event_id, (CAST(n || '131400' AS HUGEINT) % 97 + (CAST(substr(c, 1, 2) AS HUGEINT))) % 97 = 1 AS valid FROM (
        SELECT event_id, lpad(CAST(event_id * 7919 AS VARCHAR), 18, '0') AS n, lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS c FROM events)""")
def _(t):
    printed = F.concat(F.lit("DE"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.lpad((F.col("event_id") * 7919).cast("string"), 18, "0"))
    return t.events.select("event_id", values.iban(printed).alias("valid"))


@query("n15_model_cost", """
    SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE round((CAST(event_id AS DECIMAL(18,4)) * 3 + (user_id + 5) * CASE WHEN user_id % 3 = 1 THEN CAST(15 AS DECIMAL(18,4)) END) / 1000000, 6) END AS cost FROM events""")
def _(t):
    price = F.when(F.col("user_id") % 3 == 1, F.lit(15)).cast("decimal(10,2)")
    cost = values.model_cost(F.col("event_id"), F.col("user_id"), F.lit(5), F.lit(3).cast("decimal(10,2)"), price, F.col("user_id") % 3 == 0)
    return t.events.select("event_id", cost.alias("cost"))


# -------------------------------------------------------------------------- dates, periods


@query("d01_find_dates", "SELECT doc_id, [CAST(doc_date AS VARCHAR)] AS readings FROM po_header")
def _(t):
    printed = F.when(F.col("doc_id") % 3 == 0, F.date_format("doc_date", "d MMMM yyyy")).when(F.col("doc_id") % 3 == 1, F.date_format("doc_date", "yyyy-MM-dd")).otherwise(F.date_format("doc_date", "dd.MM.yyyy"))
    return t.po_header.select("doc_id", F.transform(F.get(values.dates(F.concat(F.lit("Dated "), printed)), F.lit(0)), lambda d: d.cast("string")).alias("readings"))


@query("d02_date_order", """
    SELECT vendor_id, CASE WHEN d > 0 AND m = 0 THEN 'DMY' WHEN m > 0 AND d = 0 THEN 'MDY' WHEN d > 0 THEN NULL WHEN vendor_id % 2 = 0 THEN 'MDY' ELSE NULL END AS date_order FROM (
        SELECT vendor_id, count(*) FILTER (WHERE vendor_id % 4 <> 3 AND day(doc_date) > 12) AS d, count(*) FILTER (WHERE vendor_id % 4 = 3 AND day(doc_date) > 12) AS m FROM po_header GROUP BY 1)""")
def _(t):
    late, swapped = F.dayofmonth("doc_date") > 12, F.col("vendor_id") % 4 == 3
    votes = t.po_header.groupBy("vendor_id").agg(F.count_if(late & ~swapped).alias("d"), F.count_if(late & swapped).alias("m"))
    return votes.select("vendor_id", values.date_order(F.col("d"), F.col("m"), F.when(F.col("vendor_id") % 2 == 0, "USD").otherwise("CAD")).alias("date_order"))


@query("d03_periods", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN user_id WHEN 2 THEN user_id * 7 WHEN 3 THEN user_id * 30 ELSE 30 END AS days FROM events")
def _(t):
    n = F.col("user_id").cast("string")
    printed = F.when(F.col("event_id") % 5 == 0, "Due on receipt").when(F.col("event_id") % 5 == 1, F.concat(F.lit("net "), n, F.lit(" calendar days"))).when(F.col("event_id") % 5 == 2, F.concat(n, F.lit(" weeks"))).when(F.col("event_id") % 5 == 3, F.concat(n, F.lit(" months"))).otherwise("thirty (30) days")
    return t.events.select("event_id", values.days(printed).alias("days"))


@query("d04_due_dates", "SELECT doc_id, CAST(doc_date + terms AS DATE) AS due, 30 AS terms FROM po_header")
def _(t):
    due = F.date_add("doc_date", F.col("terms"))
    return t.po_header.select("doc_id", due.alias("due"), F.datediff(due, "doc_date").alias("terms"))


@query("d10_backoff", "SELECT job_id, least(3600, 10 * 2 ** greatest(0, attempts * 4 - 1))::INT AS seconds FROM jobs")
def _(t):
    return t.jobs.select("job_id", values.backoff(F.col("attempts") * 4).alias("seconds"))


@query("d11_cents", "SELECT doc_id, round(total * 1.0825, 2) AS gross FROM po_header")
def _(t):
    return t.po_header.select("doc_id", F.round(F.col("total") * F.lit("1.0825").cast("decimal(5,4)"), 2).alias("gross"))


@query("n16_boxes", "SELECT user_id, min(event_id) AS x0, max(event_id) AS x1, min(value) AS y0, max(value) AS y1, (min(event_id) + max(event_id)) / 2 AS centre FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("x0"), F.max("event_id").alias("x1"), F.min("value").alias("y0"), F.max("value").alias("y1"), ((F.min("event_id") + F.max("event_id")) / 2).alias("centre"))


@query("r15_trigram_vendors", """
    WITH w AS (SELECT vendor_id, unnest(regexp_split_to_array(lower(name), '[^a-z0-9]+')) AS w FROM vendors UNION ALL SELECT -1, unnest(['kestrel', 'sons', '42'])),
    g AS (SELECT DISTINCT vendor_id, substr('  ' || w || ' ', i, 3) AS gram FROM w, range(1, 30) r(i) WHERE w <> '' AND i <= length(w) + 1), q AS (SELECT gram FROM g WHERE vendor_id = -1),
    s AS (SELECT vendor_id, count(*) FILTER (WHERE gram IN (SELECT gram FROM q)) AS shared, count(*) AS n FROM g WHERE vendor_id >= 0 GROUP BY 1)
    SELECT vendor_id, round(shared / (n + (SELECT count(*) FROM q) - shared), 6) AS score FROM s WHERE shared / (n + (SELECT count(*) FROM q) - shared) >= 0.2""")
def _(t):
    return t.vendors.withColumn("score", retrieval.trigram_similarity(F.col("name"), F.lit("kestrel sons 42"))).where("score >= 0.2").select("vendor_id", F.round("score", 6).alias("score"))


@query("r15_alike_names", """
    WITH n AS (SELECT vendor_id, lower(name) AS name FROM vendors), w AS (SELECT vendor_id, unnest(regexp_split_to_array(name, '[^a-z0-9]+')) AS w FROM n),
    g AS (SELECT DISTINCT vendor_id, substr('  ' || w || ' ', i, 3) AS gram FROM w, range(1, 30) r(i) WHERE w <> '' AND i <= length(w) + 1), c AS (SELECT vendor_id, count(*) AS n FROM g GROUP BY 1),
    s AS (SELECT a.vendor_id AS x, b.vendor_id AS y, count(*) AS shared FROM g a JOIN g b USING (gram) WHERE a.vendor_id < b.vendor_id GROUP BY 1, 2)
    SELECT x, y, round(shared / (p.n + q.n - shared), 6) AS alike FROM s JOIN c p ON x = p.vendor_id JOIN c q ON y = q.vendor_id WHERE shared / (p.n + q.n - shared) >= 0.75""")
def _(t):
    """Pairs of vendors whose names are alike, over the whole table."""
    names = t.vendors.select("vendor_id", F.lower("name").alias("name"))
    pairs = likeness.alike_pairs(*likeness.rare_first(names, names, "name", "name"), 0.75)
    ids = lambda c, to: names.select(F.col("name").alias(c), F.col("vendor_id").alias(to))
    return pairs.join(ids("name", "x"), "name").join(ids("other", "y"), "other").where("x < y").select("x", "y", F.round("alike", 6).alias("alike"))
