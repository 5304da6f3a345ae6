"""Business rules over comparison items, and the review items that follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import find_clause, governing_law, notice_days

#: The configured rules: code, type, document types, severity, parameters.
RULES = [
    ("INV_DUPLICATE", "duplicate_document", ["INVOICE"], "HIGH", {"date_window_days": "7"}),
    ("INV_PO_UNIT_PRICE", "line_unit_price", ["INVOICE"], "HIGH", {"tolerance_pct": "0", "tolerance_abs": "0.01"}),
    ("INV_PO_QUANTITY", "line_quantity_ordered", ["INVOICE"], "HIGH", {"tolerance": "0", "allow_partial": "true"}),
    ("INV_DELIVERED_QUANTITY", "line_quantity_delivered", ["INVOICE"], "HIGH", {"tolerance": "0"}),
    ("INV_LINE_NOT_ORDERED", "line_not_ordered", ["INVOICE"], "HIGH", {}),
    ("INV_PO_VENDOR", "header_match", ["INVOICE"], "CRITICAL", {"check": "vendor_id"}),
    ("INV_PO_CURRENCY", "header_match", ["INVOICE"], "HIGH", {"check": "currency"}),
    ("INV_PO_TAX_RATE", "header_match", ["INVOICE"], "MEDIUM", {"check": "tax_rate", "tolerance": "0.0001"}),
    ("INV_PO_PAYMENT_TERMS", "header_match", ["INVOICE"], "LOW", {"check": "terms"}),
    ("INV_MISSING_PO", "order_reference", ["INVOICE"], "MEDIUM", {}),
    ("DOC_ARITHMETIC", "document_arithmetic", ["INVOICE", "PURCHASE_ORDER", "RECEIPT"], "HIGH", {}),
    ("DOC_MANDATORY_FIELDS", "mandatory_fields", ["INVOICE", "PURCHASE_ORDER", "DELIVERY_NOTE", "RECEIPT", "CONTRACT"], "MEDIUM", {}),
    ("DOC_UNKNOWN_VENDOR", "known_vendor", ["INVOICE", "PURCHASE_ORDER", "DELIVERY_NOTE"], "MEDIUM", {}),
    ("DN_PO_QUANTITY", "line_quantity_ordered", ["DELIVERY_NOTE"], "MEDIUM", {"tolerance": "0", "allow_partial": "true"}),
    ("DN_LINE_NOT_ORDERED", "line_not_ordered", ["DELIVERY_NOTE"], "MEDIUM", {}),
    ("DN_PO_VENDOR", "header_match", ["DELIVERY_NOTE"], "HIGH", {"check": "vendor_id"}),
    ("DN_MISSING_PO", "order_reference", ["DELIVERY_NOTE"], "LOW", {}),
    ("CONTRACT_EXPIRY", "contract_expiry", ["CONTRACT"], "HIGH", {"warn_within_days": "30"}),
    ("CONTRACT_REQUIRED_CLAUSES", "required_clauses", ["CONTRACT"], "HIGH", {"clauses": "Termination,Liability,Governing Law"}),
    ("CONTRACT_TERMINATION_NOTICE", "clause_notice_period", ["CONTRACT"], "MEDIUM", {"clause": "Termination", "max_days": "90"}),
    ("CONTRACT_GOVERNING_LAW", "governing_law", ["CONTRACT"], "MEDIUM", {"clause": "Governing Law", "allowed": "Ohio"}),
    ("POLICY_PAYMENT_TERMS", "payment_terms_limit", ["INVOICE"], "MEDIUM", {"max_days": "60"}),
]
#: Severities, least first, and the categories of review items in their order.
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
CATEGORIES = ["CONTENT", "CLASSIFICATION", "EXTRACTION", "DUPLICATE", "DISCREPANCY", "REQUESTED"]


def rule_frame(spark) -> DataFrame:
    rows = [
        F.struct(F.lit(code).alias("code"), F.lit(kind).alias("rule_type"), F.array(*map(F.lit, types)).alias("applies_to"), F.lit(severity).alias("severity"),
                 F.create_map(*[F.lit(x) for kv in params.items() for x in kv]).cast("map<string,string>").alias("params") if params else F.create_map().cast("map<string,string>").alias("params"))
        for code, kind, types, severity, params in RULES
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def applicable(docs: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """Documents with the rules for their type: an equi-join on types, whose rules are few."""
    return docs.join(F.broadcast(rules.select("code", "severity", F.explode("applies_to").alias(kind))), kind)  # RULES is a fixed list


def _outcome(failing: Column, uncertain: Column, applies: Column) -> Column:
    return F.when(~applies, "NOT_APPLICABLE").when(failing > 0, "FAIL").when(uncertain > 0, "WARN").otherwise("PASS")


def line_rules(items: DataFrame, tolerance: float = 0, allow_partial: bool = True) -> DataFrame:
    """Outcomes of the line rules: ``doc_id, code, outcome, failing``; one aggregation for all of them."""
    c, s, d = F.col("check"), F.col("status"), F.col("difference")
    over = (s == "MISMATCH") & ((d > tolerance) if allow_partial else (F.abs(d) > tolerance))
    cases = {
        "INV_PO_UNIT_PRICE": (c == "unit_price", s == "MISMATCH"),
        "INV_PO_QUANTITY": (c == "quantity_ordered", over),
        "INV_DELIVERED_QUANTITY": (c.isin("quantity_delivered", "line_delivered"), ((s == "MISMATCH") & (d > tolerance)) | ((c == "line_delivered") & (s == "MISSING"))),
        "INV_LINE_NOT_ORDERED": (c == "line_on_order", s == "MISSING"),
    }
    sums = []
    for code, (mine, failing) in cases.items():
        sums += [F.count_if(mine).alias(f"{code}_n"), F.count_if(mine & failing).alias(f"{code}_f"), F.count_if(mine & (s == "UNCERTAIN")).alias(f"{code}_u")]
    wide = items.groupBy("doc_id").agg(*sums)
    always = {"INV_LINE_NOT_ORDERED"}
    outcomes = [
        F.struct(F.lit(code).alias("code"), _outcome(F.col(f"{code}_f"), F.col(f"{code}_u"), F.lit(True) if code in always else F.col(f"{code}_n") > 0).alias("outcome"), F.col(f"{code}_f").alias("failing"))
        for code in cases
    ]
    return wide.select("doc_id", F.inline(F.array(*outcomes)))


def header_rules(items: DataFrame) -> DataFrame:
    """FAIL on a mismatch, WARN on a weak reading, NOT_APPLICABLE where a side has no value."""
    code = F.when(F.col("check") == "vendor_id", "INV_PO_VENDOR").when(F.col("check") == "currency", "INV_PO_CURRENCY").otherwise("INV_PO_PAYMENT_TERMS")
    outcome = F.when(F.col("status") == "MISSING", "NOT_APPLICABLE").when(F.col("status") == "MISMATCH", "FAIL").when(F.col("status") == "UNCERTAIN", "WARN").otherwise("PASS")
    return items.select("doc_id", code.alias("code"), outcome.alias("outcome"))


def duplicate_rule(docs: DataFrame, duplicates: DataFrame) -> DataFrame:
    found = duplicates.groupBy("doc_id").agg(F.max("strong").alias("strong"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.when(F.col("strong"), "FAIL").when(F.col("strong").isNotNull(), "WARN").otherwise("PASS").alias("outcome"))


def order_reference(docs: DataFrame, orders: DataFrame, reference: Column, number: Column) -> DataFrame:
    """FAIL without a reference, WARN if the order is not on file."""
    known = orders.select(number.alias("__on_file")).distinct()
    joined = docs.withColumn("__ref", reference).join(known, F.col("__ref") == F.col("__on_file"), "left")
    return joined.select("doc_id", F.when(F.col("__ref").isNull(), "FAIL").when(F.col("__on_file").isNull(), "WARN").otherwise("PASS").alias("outcome"))


def mandatory_fields(required: list[str]) -> Column:
    """Names of required columns that are null."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))


def contract_expiry(expires: Column, renews: Column, today: Column, days: int) -> Column:
    return (F.when(expires.isNull(), "NOT_APPLICABLE").when(expires < today, F.when(renews, "WARN").otherwise("FAIL"))
            .when(expires <= F.date_add(today, days), "WARN").otherwise("PASS"))


def notice_period(clauses: Column, extracted: Column, keyword: str = "Termination", most: int = 90) -> Column:
    """``struct(outcome, days)``: the extracted notice period, else the longest in the clause, against the policy's most.

    Without either there is nothing to judge; a clause that states no days is for a person.
    """
    clause = find_clause(clauses, keyword)
    days = F.coalesce(extracted, F.when(clause.isNotNull(), notice_days(clause["text"])))
    outcome = F.when(days > most, "FAIL").when(days.isNotNull(), "PASS").when(clause.isNotNull(), "WARN").otherwise("NOT_APPLICABLE")
    return F.struct(outcome.alias("outcome"), days.alias("days"))


def approved_law(clauses: Column, allowed: list[str], keyword: str = "Governing Law") -> Column:
    """``struct(outcome, place)``: whether the clause names an approved law, in any case; another one, or none, is for Legal."""
    clause = find_clause(clauses, keyword)
    flat = F.lower(F.regexp_replace(clause["text"], r"\s+", " "))
    named = reduce(lambda a, b: a | b, [F.contains(flat, F.lit(x.lower())) for x in allowed])
    outcome = F.when(clause.isNull(), "NOT_APPLICABLE").when(named, "PASS").otherwise("WARN")
    return F.struct(outcome.alias("outcome"), F.when(clause.isNotNull(), governing_law(clause["text"])).alias("place"))


def terms_limit(terms: Column, issued: Column, due: Column, most: int) -> Column:
    days = F.coalesce(terms, F.datediff(due, issued))
    return F.when(days.isNull(), "NOT_APPLICABLE").when(days > most, "FAIL").otherwise("PASS")


# -------------------------------------------------------------------------- review items


def review_items(results: DataFrame) -> DataFrame:
    """Items of FAIL, WARN (one level softer) and ERROR (MEDIUM) results: ``doc_id, code, category, severity, rank``."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    softer = F.when(F.col("outcome") == "WARN", F.greatest(F.lit(1).cast("long"), rank - 1)).when(F.col("outcome") == "ERROR", 2).otherwise(rank)
    hit = results.where(F.col("outcome").isin("FAIL", "WARN", "ERROR"))
    category = F.when(F.col("code") == "INV_DUPLICATE", "DUPLICATE").otherwise("DISCREPANCY")
    return hit.select("doc_id", "code", category.alias("category"), softer.cast("int").alias("rank"), F.element_at(F.array(*map(F.lit, SEVERITIES)), softer.cast("int")).alias("severity"))


def tasks(items: DataFrame, acknowledged: DataFrame | None = None) -> DataFrame:
    """The review task of each document with open items: priority from the worst, type from the first category."""
    if acknowledged is not None:
        items = items.join(acknowledged, ["doc_id", "code"], "left_anti")
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return items.groupBy("doc_id").agg(F.max_by("severity", "rank").alias("priority"), F.min_by("category", order).alias("task_type"), F.count("*").alias("n_items"))


def due_at(created: Column, priority: Column, hours: dict[str, int]) -> Column:
    allowed = F.coalesce(*[F.when(priority == p, F.lit(h)) for p, h in hours.items()])
    return created + F.make_dt_interval(hours=allowed)
