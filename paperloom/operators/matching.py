"""Line matching, two- and three-way comparison, duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ratio, token_set_ratio

#: Readings of a lower confidence are weak.
MIN_CONFIDENCE = 0.75


def reference_key(text: Column) -> Column:
    """Upper-case letters and digits only; null if none."""
    return F.nullif(F.regexp_replace(F.upper(text), "[^0-9A-Z]", ""), F.lit(""))


def pair_by_key(left: DataFrame, right: DataFrame, doc: str, key: str, order: list[str]) -> DataFrame:
    """Pairs the n-th line of a key on one side with the n-th on the other; full outer, so the rest stays.

    Columns other than document and key get the prefixes ``l_`` and ``r_``.  A null key pairs with nothing.
    """
    sides = []
    for df, prefix in ((left, "l_"), (right, "r_")):
        nr = F.when(F.col(key).isNotNull(), F.row_number().over(Window.partitionBy(doc, key).orderBy(*order)))
        rest = [F.col(c).alias(prefix + c) for c in df.columns if c not in (doc, key)]
        sides.append(df.withColumn("__nr", nr).select(doc, key, "__nr", *rest, F.lit(True).alias(prefix + "has")))
    return sides[0].join(sides[1], [doc, key, "__nr"], "full").drop("__nr")


def numeric_status(left: Column, right: Column, weak: Column, absolute, relative=0, currencies_differ: Column | None = None) -> Column:
    """MISSING, then UNCERTAIN for unlike currencies, MATCH within tolerance, UNCERTAIN if weak, else MISMATCH."""
    allowed = F.greatest(F.lit(absolute).cast("decimal(18,4)"), F.abs(right) * F.lit(relative).cast("decimal(5,4)"))
    status = F.when(left.isNull() | right.isNull(), "MISSING")
    if currencies_differ is not None:
        status = status.when(currencies_differ, "UNCERTAIN")
    return status.when(F.abs(left - right) <= allowed, "MATCH").when(weak, "UNCERTAIN").otherwise("MISMATCH")


def equal_status(left: Column, right: Column, weak: Column, same: Column | None = None) -> Column:
    """Header equality; ``same`` overrides plain equality where it is known."""
    equal = left == right if same is None else F.coalesce(same, left == right)
    return F.when(left.isNull() | right.isNull(), "MISSING").when(equal, "MATCH").when(weak, "UNCERTAIN").otherwise("MISMATCH")


def missing_status(no_lines: Column, weak: Column) -> Column:
    """A line on one side only: UNCERTAIN if the other side has no lines, or an item code is weak."""
    return F.when(no_lines | weak, "UNCERTAIN").otherwise("MISSING")


def same_vendor(a_id: Column, b_id: Column, similar: Column) -> Column:
    """True, false, or null where a side has no vendor."""
    return F.when(a_id.isNotNull() & b_id.isNotNull(), a_id == b_id).otherwise(similar)


def keyed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("key", reference_key(F.col("sku"))).withColumn("weak", F.col("confidence") < MIN_CONFIDENCE)


def compare_lines(subject: DataFrame, order: DataFrame, deliveries: DataFrame | None, price_abs=0.01, price_pct=0, quantity_abs=0, currencies_differ: DataFrame | None = None, checks: tuple[str, ...] | None = None) -> DataFrame:
    """Comparison items of invoice lines against their order, and the sum of their deliveries.

    Lines of a document pair by item code.  All inputs have ``doc_id, sku, quantity,
    confidence``; invoice and order also ``unit_price``.  Returns ``doc_id, key, check,
    status, difference``.  Sums of deliveries are aggregated before the join; every join is
    on document and code, so one document's lines are the most that meet, and counts over a
    document are windows over its pairs.  With ``checks`` only those are computed: without
    the ones of single lines or deliveries, neither is looked for.
    """
    wanted = lambda *names: checks is None or any(n in checks for n in names)
    left = keyed(subject).select("doc_id", "key", "quantity", "unit_price", "weak")
    right = keyed(order).select("doc_id", "key", "quantity", "unit_price", "weak")
    pairs = pair_by_key(left, right, "doc_id", "key", ["quantity", "unit_price"])
    if currencies_differ is not None:
        pairs = pairs.join(currencies_differ.select("doc_id", "currencies_differ"), "doc_id", "left").fillna(False, ["currencies_differ"])
    else:
        pairs = pairs.withColumn("currencies_differ", F.lit(False))
    weak = F.coalesce(F.col("l_weak"), F.lit(False)) | F.coalesce(F.col("r_weak"), F.lit(False))
    both = F.col("l_has").isNotNull() & F.col("r_has").isNotNull()
    if wanted("line_on_order", "line_fulfilled"):
        # Of each document: lines on either side, and whether a line that is left over is weak.
        doc = Window.partitionBy("doc_id")
        rows = pairs.withColumns({
            "n_left": F.count("l_has").over(doc), "n_right": F.count("r_has").over(doc),
            "extra_weak": F.max(F.when(F.col("r_has").isNull(), F.col("l_weak"))).over(doc), "open_weak": F.max(F.when(F.col("l_has").isNull(), F.col("r_weak"))).over(doc),
        })
    else:
        none = {"n_left": F.lit(1), "n_right": F.lit(1), "extra_weak": F.lit(False), "open_weak": F.lit(False)}
        rows = pairs.where(both).withColumns(none)
    null = F.lit(None).cast("decimal(18,4)")
    any_weak = lambda *names: reduce(lambda a, b: a | b, [F.coalesce(F.col(n), F.lit(False)) for n in names])
    items = F.when(both, F.array(
        F.struct(F.lit("unit_price").alias("check"), numeric_status(F.col("l_unit_price"), F.col("r_unit_price"), weak, price_abs, price_pct, F.col("currencies_differ")).alias("status"), (F.col("l_unit_price") - F.col("r_unit_price")).cast("decimal(18,4)").alias("difference")),
        F.struct(F.lit("quantity_ordered").alias("check"), numeric_status(F.col("l_quantity"), F.col("r_quantity"), weak, quantity_abs).alias("status"), (F.col("l_quantity") - F.col("r_quantity")).cast("decimal(18,4)").alias("difference")),
    )).when(F.col("l_has").isNotNull(), F.array(
        F.struct(F.lit("line_on_order").alias("check"), missing_status(F.col("n_right") == 0, any_weak("l_weak", "open_weak")).alias("status"), null.alias("difference")),
    )).otherwise(F.array(
        F.struct(F.lit("line_fulfilled").alias("check"), missing_status(F.col("n_left") == 0, any_weak("r_weak", "extra_weak")).alias("status"), null.alias("difference")),
    ))
    out = rows.select("doc_id", "key", F.inline(items if checks is None else F.filter(items, lambda x: x["check"].isin(*checks))))
    if deliveries is None or not wanted("quantity_delivered", "line_delivered"):
        return out
    notes = keyed(deliveries).groupBy("doc_id", "key").agg(F.sum("quantity").cast("decimal(18,4)").alias("delivered"), F.max("weak").alias("d_weak"))
    noted = notes.groupBy("doc_id").agg(F.count("*").alias("n_notes"))
    billed = left.join(notes, ["doc_id", "key"], "left").join(noted, "doc_id")  # documents with a delivery note
    has = F.col("delivered").isNotNull()
    delivered = billed.select(
        "doc_id", "key", F.when(has, "quantity_delivered").otherwise("line_delivered").alias("check"),
        F.when(has, numeric_status(F.col("quantity"), F.col("delivered"), F.col("weak") | F.coalesce("d_weak", F.lit(False)), quantity_abs)).otherwise(missing_status(F.lit(False), F.col("weak"))).alias("status"),
        F.when(has, F.col("quantity") - F.col("delivered")).cast("decimal(18,4)").alias("difference"),
    )
    return out.unionByName(delivered if checks is None else delivered.where(F.col("check").isin(*checks)))


def compare_headers(subject: DataFrame, order: DataFrame) -> DataFrame:
    """Header items of subjects (``doc_id, po_number, vendor_id, currency, terms``) and the orders they name."""
    sides = subject.withColumn("po_key", reference_key(F.col("po_number"))).join(
        order.select(reference_key(F.col("number")).alias("po_key"), *[F.col(c).alias(f"o_{c}") for c in ("number", "vendor_id", "currency", "terms")]), "po_key")
    no = F.lit(False)
    checks = {c: equal_status(F.col(c), F.col(f"o_{c}"), no) for c in ("vendor_id", "currency", "terms")}
    return sides.select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("check"), s.alias("status")) for n, s in checks.items()])))


def match_lines_fuzzy(left: DataFrame, right: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Pairs lines by code, then each left line in order with the best free description of at least ``threshold``.

    Both sides have ``doc_id, line, sku, description``.  The second phase depends on order,
    so a document's lines are matched together in one group; ties go to the first line.
    Returns ``doc_id, left_line, right_line`` with nulls for lines left over.
    """
    line = F.struct("line", reference_key(F.col("sku")).alias("key"), "description")
    a, b = (df.groupBy("doc_id").agg(F.collect_list(line).alias(side)) for df, side in ((left, "a"), (right, "b")))
    pairs = a.join(b, "doc_id", "full")  # a row a document
    return pairs.mapInArrow(lambda it: _matched(it, lambda x, y: greedy_pairs(x, y, threshold)), "doc_id long, left_line long, right_line long")


def pair_readings(left: DataFrame, right: DataFrame, least: float = 85.0) -> DataFrame:
    """Pairs the rows of a table that two extractors read: by code, else by the most similar description, else by place.

    Both sides have ``doc_id, line, sku, description``.  Rows pair once, in the order of the
    left side; if nothing pairs and both read as many rows, they pair in order.  Returns
    ``doc_id, left_line, right_line`` with nulls for rows left over.
    """
    flat = lambda c: F.nullif(F.regexp_replace(F.lower(c), r"\s+", ""), F.lit(""))
    row = F.struct("line", flat("sku").alias("key"), flat("description").alias("description"))
    a, b = (df.groupBy("doc_id").agg(F.collect_list(row).alias(side)) for df, side in ((left, "a"), (right, "b")))
    return a.join(b, "doc_id", "full").mapInArrow(lambda it: _matched(it, lambda x, y: reading_pairs(x, y, least)), "doc_id long, left_line long, right_line long")


def reading_pairs(left: list[dict], right: list[dict], least: float) -> list[tuple[int | None, int | None]]:
    left, free = sorted(left, key=lambda x: x["line"]), sorted(right, key=lambda x: x["line"])
    rows, pairs = list(free), []
    name = lambda x: ("code", x["key"]) if x["key"] else ("text", x["description"])
    for line in left:
        twin = next((o for o in free if name(line)[1] and name(o) == name(line)), None)
        if twin is None and line["description"]:
            scored = [(ratio(line["description"], o["description"]), o) for o in free if o["description"]]
            best = max(scored, key=lambda s: s[0], default=(0.0, None))
            twin = best[1] if best[0] >= least else None
        if twin:
            free.remove(twin)
        pairs.append((line["line"], twin["line"] if twin else None))
    if len(left) == len(rows) and all(b is None for _, b in pairs):
        return [(a["line"], b["line"]) for a, b in zip(left, rows, strict=True)]
    return pairs + [(None, o["line"]) for o in free]


def _matched(batches: Iterator[pa.RecordBatch], pair: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, a, b in zip(*(batch[c].to_pylist() for c in ("doc_id", "a", "b")), strict=True):
            rows += [(doc, x, y) for x, y in pair(a or [], b or [])]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "left_line", "right_line"])


def greedy_pairs(left: list[dict], right: list[dict], threshold: float) -> list[tuple[int | None, int | None]]:
    """Line numbers of pairs: by code first, then each left line with the best free description."""
    free = sorted(right, key=lambda o: o["line"])
    found, rest = [], []
    for line in sorted(left, key=lambda x: x["line"]):
        twin = next((o for o in free if line["key"] and o["key"] == line["key"]), None)
        (found if twin else rest).append((line, twin))
        if twin:
            free.remove(twin)
    for line, _ in rest:
        scored = [(token_set_ratio(line["description"], o["description"]), o) for o in free if line["description"] and o["description"]]
        best = max(scored, key=lambda s: s[0], default=(0, None))
        twin = best[1] if best[0] >= threshold else None
        if twin:
            free.remove(twin)
        found.append((line, twin))
    return [(a["line"], b["line"] if b else None) for a, b in found] + [(None, o["line"]) for o in free]


def pick_order(subjects: DataFrame, orders: DataFrame, on: str) -> DataFrame:
    """The order of each subject: one of the same vendor first, else the latest."""
    o = orders.select(F.col(on), F.col("doc_id").alias("order_id"), F.col("vendor_id").alias("o_vendor"), F.col("doc_date").alias("o_date"))
    joined = subjects.join(o, on)
    same = F.coalesce(F.col("vendor_id") == F.col("o_vendor"), F.lit(False))
    return joined.groupBy("doc_id").agg(F.max_by("order_id", F.struct(same, F.col("o_date"), F.col("order_id"))).alias("order_id"))


def find_duplicates(docs: DataFrame, days: int = 7, strong: bool = True) -> DataFrame:
    """Older documents that each one duplicates: ``doc_id, original_id, kind, strong``, the strongest first.

    Blocking keys make two equi-joins: vendor and number (strong), vendor, amount and
    currency with dates at most ``days`` apart.  Dates fall into buckets of ``days`` and meet
    their neighbours, so a frequent amount does not meet all its rows.  Of two documents the
    one of the earlier date (then the smaller id) is the original.  Every pair is a row here;
    ``strongest`` gives one original a document without them.  ``strong`` = False leaves out
    pairs of the same number.
    """
    d = docs.select("doc_id", reference_key(F.col("number")).alias("number"), "vendor_id", "total", "currency", "doc_date")
    o = d.select(*[F.col(c).alias(f"o_{c}") for c in d.columns])
    older = F.struct("o_doc_date", "o_doc_id") < F.struct("doc_date", "doc_id")
    by_number = d.join(o, (F.col("vendor_id") == F.col("o_vendor_id")) & (F.col("number") == F.col("o_number"))).where(older)
    bucket = lambda c: F.floor(F.unix_date(c) / (days + 1))
    near = o.withColumn("b", F.explode(F.array(bucket(F.col("o_doc_date")), bucket(F.col("o_doc_date")) + 1)))
    by_amount = d.withColumn("b", bucket(F.col("doc_date"))).join(near, "b").where(
        (F.col("vendor_id") == F.col("o_vendor_id")) & (F.col("total") == F.col("o_total")) & F.col("currency").eqNullSafe(F.col("o_currency")))
    by_amount = by_amount.where(older & (F.datediff("doc_date", "o_doc_date") <= days) & ~F.coalesce(F.col("number") == F.col("o_number"), F.lit(False)))
    out = lambda df, kind, strong: df.select("doc_id", F.col("o_doc_id").alias("original_id"), F.lit(kind).alias("kind"), F.lit(strong).alias("strong"), F.col("o_doc_date").alias("original_date"))
    possible = out(by_amount, "SAME_VENDOR_AMOUNT_AND_DATE", False)
    return out(by_number, "SAME_VENDOR_AND_NUMBER", True).unionByName(possible) if strong else possible


def strongest(docs: DataFrame, days: int = 7) -> DataFrame:
    """One original a document, ``doc_id, original_id, kind, strong``: strong before possible, then the oldest.

    The oldest document of a vendor and number is found by a partial minimum, so however many
    share a number, no pairs are made of them; only documents without such an original look
    for one of the same amount.
    """
    d = docs.withColumn("number_key", reference_key(F.col("number"))).where("vendor_id IS NOT NULL AND number_key IS NOT NULL")
    first = d.groupBy("vendor_id", "number_key").agg(F.min(F.struct("doc_date", "doc_id"))["doc_id"].alias("original_id"))
    strong = d.join(first, ["vendor_id", "number_key"]).where("doc_id <> original_id").select("doc_id", "original_id", F.lit("SAME_VENDOR_AND_NUMBER").alias("kind"), F.lit(True).alias("strong"))
    weak = find_duplicates(docs, days, strong=False).join(strong.select("doc_id"), "doc_id", "left_anti")
    oldest = weak.groupBy("doc_id").agg(F.min(F.struct("original_date", "original_id", "kind")).alias("x")).select("doc_id", "x.original_id", "x.kind", F.lit(False).alias("strong"))
    return strong.unionByName(oldest)
