"""Confidence, consistency, merging and vendor resolution of extracted fields; layout of page words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import name_score, organization
from ..functions.values import collapse
from .likeness import most_alike

# ----------------------------------------------------------------------------- confidence


def field_confidence(evidence: Column, score: Column, normal: Column, ocr: Column, anchor: Column, conflicts: Column, page_ok: Column, consistent: Column, agreement: Column, model_only: Column, human: Column) -> Column:
    """Product of eight factors, to four places; a person's value is certain."""
    one = F.lit(1.0)
    factors = [
        F.when(evidence.isin("VERIFIED", "HUMAN"), 1.0).when(evidence == "FUZZY", F.least(one, F.greatest(F.lit(0.0), score / 100))).when(evidence == "UNSUPPORTED", 0.1).otherwise(0.0),
        F.when(normal == "OK", 1.0).when(normal == "UNCERTAIN", 0.6).otherwise(0.0),
        F.when(ocr.isNotNull(), 0.5 + 0.5 * F.least(F.lit(100.0), F.greatest(F.lit(0.0), ocr)) / 100).otherwise(one),  # least and greatest pass over nulls
        F.coalesce(anchor, one),
        F.when(conflicts > 0, 0.8).otherwise(1.0),
        F.when(F.coalesce(page_ok, F.lit(True)), 1.0).otherwise(0.95),
        F.when(~F.coalesce(consistent, F.lit(True)), 0.6).otherwise(1.0),
        F.when(agreement.isNull(), F.when(model_only, 0.8).otherwise(0.9)).when(agreement, 1.0).otherwise(0.6),
    ]
    return F.when(human, 1.0).otherwise(F.round(reduce(lambda a, b: a * b, factors), 4))


def document_confidence(required: list[Column]) -> Column:
    """The weakest required field; a missing one counts as 0."""
    return F.least(*[F.coalesce(c, F.lit(0.0)) for c in required], F.lit(1.0)) if required else F.lit(1.0)


def review_level(confidence: Column, failed: Column, high: float = 0.85, medium: float = 0.6) -> Column:
    return F.when(failed | (confidence < medium), "MANDATORY_REVIEW").when(confidence < high, "ANALYST_REVIEW").otherwise("AUTO")


def agreement_confidence(label: Column, first: Column, first_score: Column, second: Column, own_cues: Column, other_cues: Column, quoted: Column) -> Column:
    start = F.when(label == first, F.greatest(F.lit(0.8), first_score)).when(label == second, 0.65).otherwise(0.45)
    cues = F.when((own_cues >= 2) & (own_cues >= other_cues), 0.1).when(other_cues > own_cues, -0.1).otherwise(0.0)
    return F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.0), start + cues + F.when(quoted, 0.0).otherwise(-0.1))), 4)


def consistency_checks(header: DataFrame, lines: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Arithmetic of a document: ``doc_id, code, passed``.

    ``header``: doc_id, subtotal, tax_amount, tax_rate, total, issued, due, terms; ``lines``:
    doc_id, quantity, unit_price, amount.  Lines are summed before they meet their header;
    a check whose values are missing is absent.
    """
    cents = lambda c: F.round(c, 2)
    known = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("amount").isNotNull()
    sums = lines.groupBy("doc_id").agg(
        F.sum("amount").alias("line_sum"), F.count("*").alias("n"), F.count("amount").alias("n_amounts"), F.count_if(known).alias("n_known"),
        F.count_if(known & (F.abs(cents(F.col("quantity") * F.col("unit_price")) - F.col("amount")) > tolerance)).alias("n_off"),
    )
    d = header.join(sums, "doc_id", "left")
    c = F.col
    target = F.coalesce("subtotal", F.when(c("tax_amount").isNull(), c("total")))
    allowed = tolerance * F.greatest(F.lit(1), F.floor(c("n_amounts") / 10) + 1)
    checks = {
        "LINE_AMOUNT": F.when(c("n_known") > 0, c("n_off") == 0),
        "LINES_SUM": F.when((c("n") > 0) & (c("n") == c("n_amounts")), F.abs(c("line_sum") - target) <= allowed),
        "TOTAL_ARITHMETIC": F.abs(c("subtotal") + c("tax_amount") - c("total")) <= tolerance,
        "TAX_RATE": F.abs(cents(c("subtotal") * c("tax_rate")) - c("tax_amount")) <= tolerance,
        "DUE_DATE_TERMS": F.when(c("terms").isNotNull(), F.date_add("issued", c("terms")) == c("due")),
        "DUE_AFTER_ISSUE": F.when(c("terms").isNull(), c("issued") <= c("due")),
    }
    return d.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("code"), v.alias("passed")) for k, v in checks.items()]))).where("passed IS NOT NULL")


def merge_readings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two extractors' ``doc_id, path, value, confidence`` field by field.

    Equal values agree; of different ones the more confident (then the first) stays and they
    conflict; a value of one side only has no agreement.
    """
    x, y = (d.select("doc_id", "path", F.struct("value", "confidence").alias(n)) for d, n in ((a, "x"), (b, "y")))
    both = x.join(y, ["doc_id", "path"], "full")
    first = F.col("y").isNull() | (F.col("x.confidence") >= F.col("y.confidence"))
    return both.select("doc_id", "path", F.when(first, F.col("x.value")).otherwise(F.col("y.value")).alias("value"), (F.col("x.value") == F.col("y.value")).alias("agreement"))


def correction_overlay(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Reviewers' values win."""
    c = corrections.select("doc_id", "path", F.col("value").alias("corrected"))
    joined = fields.join(c, ["doc_id", "path"], "left")
    return joined.select("doc_id", "path", F.coalesce("corrected", "value").alias("value"), F.col("corrected").isNotNull().alias("corrected"))


def tax_id_key(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(text, "[^0-9A-Za-z]", "")), F.lit(""))


def vendor_candidates(named: DataFrame, vendors: DataFrame, least: float = 0.2, most: int = 25) -> DataFrame:
    """The ``most`` vendors whose names share most letter triples with each ``key``, by at least ``least`` of all.

    ``named`` has distinct ``key``; ``vendors`` have ``vendor_id, v_key``.  The pairs come from
    a join of distinct names (``most_alike``); of a name that very many vendors have only the
    ``most`` of smallest id go on.
    """
    alike = most_alike(named, vendors, "key", "v_key", least, most, "vendor_id").select(F.col("name").alias("key"), F.col("other").alias("v_key"), "alike")
    first = F.row_number().over(Window.partitionBy("v_key").orderBy("vendor_id"))
    few = vendors.where("v_key <> ''").select("vendor_id", "v_key").distinct().withColumn("nr", first).where(F.col("nr") <= most).drop("nr")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("alike"), "vendor_id", "v_key"))
    return alike.join(few, "v_key").withColumn("place", place).where(F.col("place") <= most).select("key", "vendor_id", "v_key", "alike")


def resolve_vendors(docs: DataFrame, vendors: DataFrame, aliases: DataFrame | None = None, least: float = 85.0) -> DataFrame:
    """The vendor of each document (``doc_id, name, tax_id``): by tax id, by equal name or alias, by likeness; or none.

    Only names that neither an id nor an equal name resolves are compared, each distinct one
    once, with its ``vendor_candidates``; the scores are an Arrow UDF.
    """
    d = docs.select("doc_id", organization("name").alias("key"), tax_id_key(F.col("tax_id")).alias("tax"))
    v = vendors.select("vendor_id", organization("name").alias("v_key"), tax_id_key(F.col("tax_id")).alias("v_tax"))
    names = v.select("vendor_id", "v_key")
    if aliases is not None:
        names = names.unionByName(aliases.select("vendor_id", organization("alias").alias("v_key"))).distinct()
    by_tax = v.where("v_tax IS NOT NULL").groupBy("v_tax").agg(F.min("vendor_id").alias("of_tax"))
    by_name = names.where("v_key <> ''").groupBy(F.col("v_key").alias("name_key")).agg(F.min("vendor_id").alias("of_name"))
    exact = d.join(by_tax, d.tax == by_tax.v_tax, "left").join(by_name, d.key == by_name.name_key, "left").select("doc_id", "key", "of_tax", "of_name")
    open_ = exact.where("of_tax IS NULL AND of_name IS NULL AND key <> ''").select("key").distinct()
    scored = vendor_candidates(open_, names).withColumn("score", name_score("key", "v_key")).where(F.col("score") >= least)
    best = scored.groupBy(F.col("key").alias("like_key")).agg(F.min(F.struct((-F.col("score")).alias("s"), "vendor_id"))["vendor_id"].alias("of_like"))
    found = exact.join(best, (F.col("key") == F.col("like_key")) & F.col("of_tax").isNull() & F.col("of_name").isNull(), "left")
    method = F.when(F.col("of_tax").isNotNull(), "tax_id").when(F.col("of_name").isNotNull(), "name").when(F.col("of_like").isNotNull(), "likeness")
    return found.select("doc_id", F.coalesce("of_tax", "of_name", "of_like").alias("vendor_id"), method.alias("method"))


# --------------------------------------------------------------------------------- layout

LINE = "page_id long, line int, segment int, text string, x0 double, y0 double, x1 double, y1 double"


class Box(NamedTuple):
    """A word, a segment of a line, or a block."""

    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    size: float

    @classmethod
    def around(cls, parts: list[Box], glue: str = " ") -> Box:
        if len(parts) == 1:
            return parts[0]
        return cls(glue.join(w.text for w in parts), min(w.x0 for w in parts), min(w.y0 for w in parts), max(w.x1 for w in parts), max(w.y1 for w in parts), _median(w.size for w in parts))


def _median(values: Iterator[float]) -> float:
    found = sorted(values)
    n = len(found)
    return found[n // 2] if n % 2 else (found[n // 2 - 1] + found[n // 2]) / 2


def page_lines(words: list[Box], gap: float = 0.75, overlap: float = 0.5) -> list[list[Box]]:
    """Segments of each line of a page; words are of a line if they overlap its median band."""
    lines: list[list[Box]] = []
    for w in sorted(words, key=lambda w: ((w.y0 + w.y1) / 2, w.x0)):
        if lines:
            top, bottom = _median(x.y0 for x in lines[-1]), _median(x.y1 for x in lines[-1])
            if min(w.y1, bottom) - max(w.y0, top) >= overlap * min(w.y1 - w.y0, bottom - top):
                lines[-1].append(w)
                continue
        lines.append([w])
    out = []
    for line in lines:
        line.sort(key=lambda w: w.x0)
        size, segments = _median(w.size for w in line), [[line[0]]]
        for before, w in zip(line, line[1:], strict=False):
            segments[-1].append(w) if w.x0 - before.x1 <= gap * size else segments.append([w])
        out.append([Box.around(x) for x in segments])
    return out


def _per_page(words: DataFrame, read: Callable[[list[Box]], Iterator[tuple]], schema: str) -> DataFrame:
    """``read`` over the words of each page, which are one row: order matters within a page, and pages are small."""
    word = F.struct("text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "size")])
    pages = words.groupBy("page_id").agg(F.collect_list(word).alias("words"))
    names = [c.split()[0] for c in schema.split(", ")]
    fields = list(Box._fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64()}
        for batch in batches:
            rows = []
            ends, held = batch["words"].offsets.to_pylist(), batch["words"].values
            boxes = list(map(Box, *[held.field(c).to_pylist() for c in fields]))  # column by column, of all pages
            for page, start, end in zip(batch["page_id"].to_pylist(), ends, ends[1:], strict=False):
                rows += [(page, *row) for row in read(boxes[start:end])]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, kinds[k.split()[1]]) for c, k in zip(columns, schema.split(", "), strict=True)], names)

    return pages.mapInArrow(run, schema)


def lay_out(words: DataFrame, gap: float = 0.75, overlap: float = 0.5) -> DataFrame:
    """Lines and column segments of page words (``page_id, text, x0, y0, x1, y1, size``)."""

    def read(held: list[Box]) -> Iterator[tuple]:
        for i, line in enumerate(page_lines(held, gap, overlap)):
            for k, s in enumerate(line):
                yield i, k, s.text, s.x0, s.y0, s.x1, s.y1

    return _per_page(words, read, LINE)


#: Pitch and gaps in sizes of type, shares of lines, and words that make prose.
BLOCK_PITCH, CONTINUATION_GAP, PAIR_GAP, PAIR_LINES, PROSE_WORDS, HEADING_SIZE = 2.0, 1.5, 6.0, 0.6, 4, 1.25
NUMERIC = "0123456789.,-+/%()$€£¥₹"
BLOCK = "page_id long, block int, kind string, text string, x0 double, y0 double, x1 double, y1 double"


class Block:
    """Segments ``(line, segment, box)`` that read as one."""

    def __init__(self, line: int, nr: int, box: Box):
        self.parts, self.lines, self.box, self.foot = [(line, nr, box)], {line}, box, (box.y0 + box.y1) / 2

    def add(self, parts: list[tuple[int, int, Box]]) -> None:
        self.parts += parts
        self.lines.update(line for line, _, _ in parts)
        inside = [b for _, _, b in self.parts]
        self.box = Box.around(inside)._replace(size=inside[0].size)
        self.foot = max((b.y0 + b.y1) / 2 for b in inside)

    def text(self) -> str:
        rows: dict[int, list[Box]] = {}
        for line, _, box in sorted(self.parts, key=lambda p: p[:2]):
            rows.setdefault(line, []).append(box)
        return "\n".join(" ".join(b.text for b in row) for row in rows.values())

    def continues_below(self, box: Box) -> bool:
        """Whether ``box`` is the next line: close below, of about the same size, and in the same column."""
        pitch = (box.y0 + box.y1) / 2 - self.foot
        shared = min(box.x1, self.box.x1) - max(box.x0, self.box.x0)
        in_column = abs(box.x0 - self.box.x0) <= box.size or shared >= 0.3 * min(box.x1 - box.x0, self.box.x1 - self.box.x0)
        return 0 < pitch <= BLOCK_PITCH * box.size and box.y0 >= self.box.y1 - box.size and 0.7 <= box.size / self.box.size <= 1.4 and in_column


def _amounts_only(parts: list[tuple[int, int, Box]]) -> bool:
    """Whether every text is mostly digits and marks of numbers."""
    texts = [re.sub(r"\s", "", b.text) for _, _, b in parts]
    return all(re.search(r"\d", t) and 2 * sum(c in NUMERIC for c in t) >= len(t) for t in texts)


def _beside(left: Block, right: Block) -> bool:
    """Whether ``right`` holds the values of the labels in ``left``: on mostly the same lines, and near or all amounts."""
    if right.box.x0 <= left.box.x1:
        return False
    shared, most = len(left.lines & right.lines), max(len(left.lines), len(right.lines))
    if not shared or (shared == 1 and left.lines != right.lines) or shared < PAIR_LINES * most:
        return False
    return right.box.x0 - left.box.x1 <= PAIR_GAP * left.box.size or _amounts_only(right.parts)


def merge_labels(blocks: list[Block]) -> list[Block]:
    """Joins columns of labels with the columns of values beside them until no two fit, so that a form reads row by row."""
    blocks = list(blocks)
    while pair := next(((a, b) for a in blocks for b in blocks if a is not b and _beside(a, b)), None):
        pair[0].add(pair[1].parts)
        blocks.remove(pair[1])
    return blocks


def page_blocks(words: list[Box], merge: bool = True) -> list[tuple[str, Block]]:
    """Kind and block of the lines of a page, in reading order: down the page, then across."""
    blocks: list[Block] = []
    for i, line in enumerate(page_lines(words)):
        for k, box in enumerate(line):
            before = line[k - 1] if k else None
            target = None
            if before and len(before.text.split()) >= PROSE_WORDS and box.x0 - before.x1 <= CONTINUATION_GAP * before.size:
                target = next((b for b in blocks if any(p[:2] == (i, k - 1) for p in b.parts)), None)
            target = target or next((b for b in reversed(blocks) if b.continues_below(box)), None)
            target.add([(i, k, box)]) if target else blocks.append(Block(i, k, box))
    body = _median(w.size for w in words) if words else 0
    found = merge_labels(blocks) if merge else blocks
    kinds = ["heading" if len(b.lines) == 1 and body and b.box.size >= HEADING_SIZE * body else "text" for b in found]
    return sorted(zip(kinds, found, strict=True), key=lambda x: (round(x[1].box.y0 / (body / 2 or 1)), x[1].box.x0))


def blocks(words: DataFrame, merge: bool = True) -> DataFrame:
    """Blocks of page words in reading order, labels merged with their values or not: ``page_id, block, kind, text`` and the box."""

    def read(held: list[Box]) -> Iterator[tuple]:
        for nr, (kind, block) in enumerate(page_blocks(held, merge)):
            yield nr, kind, block.text(), block.box.x0, block.box.y0, block.box.x1, block.box.y1

    return _per_page(words, read, BLOCK)


def table_headers(lines: DataFrame, least: int = 3, most_words: int = 4) -> DataFrame:
    """Lines that head a table: several segments of few words without digits, half of them with letters."""
    per = lines.groupBy("page_id", "line").agg(
        F.count("*").alias("n"), F.bool_or(F.col("text").rlike(r"\d") | (F.size(F.split("text", " ")) > most_words)).alias("bad"), F.count_if(F.col("text").rlike(r"\p{L}")).alias("lettered"),
        F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("cells"))
    return per.where((F.col("n") >= least) & ~F.col("bad") & (F.col("lettered") * 2 >= F.col("n"))).select("page_id", "line", F.transform("cells", lambda c: c["text"]).alias("header"))


def body_cells(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells of the rows under each header: a segment belongs to the last header cell that starts left of its middle."""
    starts = headers.select("page_id", F.col("line").alias("header_line"), "header")
    bounds = lines.join(starts, "page_id").where("line = header_line").groupBy("page_id", "header_line").agg(F.sort_array(F.collect_list("x0")).alias("starts"))
    following = bounds.withColumn("until", F.lead("header_line", 1, 1 << 30).over(Window.partitionBy("page_id").orderBy("header_line")))
    inside = lines.join(following, "page_id").where((F.col("line") > F.col("header_line")) & (F.col("line") < F.col("until")))
    column = F.greatest(F.lit(0), F.size(F.filter("starts", lambda s: s <= (F.col("x0") + F.col("x1")) / 2)) - 1)
    return inside.select("page_id", "header_line", "line", column.alias("column"), "text")


def page_text(lines: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("line", "segment", "text")))
    return lines.groupBy("page_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def stitch_tables(tables: DataFrame) -> DataFrame:
    """Tables on consecutive pages with the same header are one: ``doc_id, page, header`` gain ``table``."""
    order = Window.partitionBy("doc_id", "header").orderBy("page")
    fresh = F.coalesce((F.col("page") != F.lag("page").over(order) + 1).cast("int"), F.lit(1))
    return tables.withColumn("fresh", fresh).withColumn("table", F.sum("fresh").over(order)).drop("fresh")


def header_offset(first: Column, second: Column, agreement: float = 0.75) -> Column:
    """How many leading cells the second header lacks if it goes on with the first one's table, else null.

    Most labels agree; a first label of at most one character may be lost, as a garbled "#"
    is read into the next column.  Null or empty headers go on with nothing.
    """
    a, b = (F.transform(x, lambda c: F.lower(collapse(c))) for x in (first, second))

    def agrees(x: Column) -> Column:
        same = F.size(F.filter(F.zip_with(x, b, lambda p, q: p.eqNullSafe(q)), lambda t: t))
        return (F.size(b) > 0) & (F.size(x) == F.size(b)) & (same >= agreement * F.size(b))

    short = F.coalesce(F.length(F.get(a, F.lit(0))), F.lit(0)) <= 1
    return F.when(agrees(a), 0).when(short & agrees(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))), 1)


def column_bounds(header: Column, words: Column) -> Column:
    """Where to part each two adjacent columns: few words cut, then far to the right.

    ``header`` are the header cells from left to right and ``words`` the words below, both
    arrays of ``struct(x0, x1)``.  Candidates lie between two header cells: the middle of
    their gap, just before the right one, and the middles between neighbouring edges of words.
    """

    def bound(left: Column, right: Column) -> Column:
        near = F.filter(words, lambda w: (w["x1"] > left["x0"]) & (w["x0"] < right["x1"]))
        edges = F.array_sort(F.array_distinct(F.flatten(F.transform(near, lambda w: F.array(w["x0"], w["x1"])))))
        gaps = F.greatest(F.size(edges) - 1, F.lit(0))
        middles = F.zip_with(F.slice(edges, 1, gaps), F.slice(edges, 2, gaps), lambda p, q: (p + q) / 2)
        places = F.concat(F.array((left["x1"] + right["x0"]) / 2, right["x0"] - 0.01), F.filter(middles, lambda m: (m >= left["x1"]) & (m < right["x0"])))
        cuts = lambda x: F.size(F.filter(near, lambda w: (w["x0"] < x) & (w["x1"] > x)))
        return -F.array_min(F.transform(places, lambda x: F.struct(cuts(x).alias("cuts"), (-x).alias("at"))))["at"]

    pairs = F.greatest(F.size(header) - 1, F.lit(0))
    return F.zip_with(F.slice(header, 1, pairs), F.slice(header, 2, pairs), bound)
