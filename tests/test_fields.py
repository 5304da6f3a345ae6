"""Fields of printed documents: nulls, empty tables, ties, values against their quotes."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import values
from paperloom.operators import extraction, fields, matching, metrics, ranking, text, tools
from paperloom.plans import QUERIES, SQL
from paperloom.plans.fields import HEADERS, LABELS

LINES = "doc_id long, line int, text string"


def test_labelled_values(spark):
    rows = [(1, 0, "Date:"), (1, 1, None), (1, 2, "Date: 2024-01-02"), (1, 3, "Terms"), (1, 4, "Vendor # Kestrel"), (2, 0, "Totals are due"), (2, 1, ""), (3, 0, "Terms:"), (3, 1, " 30 days ")]
    found = {(r.doc_id, r.field): (r.value, r.place) for r in fields.labelled_values(spark.createDataFrame(rows, LINES), LABELS).collect()}
    assert found == {(1, "date"): ("2024-01-02", "SAME_LINE"), (1, "vendor"): ("Kestrel", "SAME_LINE"), (3, "terms"): ("30 days", "BELOW")}
    assert fields.labelled_values(spark.createDataFrame([], LINES), LABELS).collect() == []


def test_columns_have_one_field(spark):
    rows = [(1, ["Qty", "Quantity", None, "unit price", "list price"]), (2, None), (3, [])]
    found = {(r.doc_id, r.field): r.position for r in fields.map_columns(spark.createDataFrame(rows, "doc_id long, headers array<string>"), HEADERS).collect()}
    assert found == {(1, "quantity"): 0, (1, "price"): 3}


def test_rows(spark):
    rows = [(1, 1, "SKU 12 - bolt", "3 pcs."), (1, 2, "Total", "9"), (1, 3, None, "1"), (1, 4, "nut", None), (1, 5, "taxi ride", "1")]
    found = fields.table_rows(spark.createDataFrame(rows, "doc_id long, row int, item string, amount string")).orderBy("row").collect()
    assert [(r.row, r.code, r.description, float(r.quantity), r.unit) for r in found] == [(1, "SKU 12", "bolt", 3.0, "pcs"), (5, None, "taxi ride", 1.0, None)]


def test_section_items(spark):
    rows = [(1, 0, "- a"), (1, 1, "Skills"), (1, 2, None), (1, 3, "- b"), (1, 4, ""), (1, 5, "3. c"), (1, 6, "Other"), (1, 7, "- d")]
    found = fields.section_items(spark.createDataFrame(rows, LINES), {"Skills": "skills"}).orderBy("line").collect()
    assert [(r.line, r.section, r.item) for r in found] == [(3, "skills", "b"), (5, "skills", "c")]


def test_document_scores(spark):
    schema = "doc_id long, name string, required boolean, in_table boolean, confidence double, bad boolean"
    rows = [(1, "a", True, False, 0.9, False), (1, "c", False, True, 0.8, None), (2, "a", True, False, None, None), (3, "a", True, False, 0.95, True), (4, "b", False, False, 0.2, False)]
    found = {r.doc_id: (r.confidence, r.status, r.level, r.reasons) for r in fields.score_documents(spark.createDataFrame(rows, schema), F.col("bad")).collect()}
    assert found == {
        1: (0.8, "SUCCEEDED", "ANALYST_REVIEW", ["EXTRACTION_UNCERTAIN"]), 2: (0.0, "FAILED", "MANDATORY_REVIEW", ["EXTRACTION_FAILED"]),
        3: (0.95, "SUCCEEDED", "MANDATORY_REVIEW", ["EXTRACTION_INCONSISTENT"]), 4: (1.0, "SUCCEEDED", "AUTO", []),
    }


def test_value_in_source(spark):
    cases = [
        ("MONEY", "1234.50", "total of 1.234,50 EUR", True), ("MONEY", "1234.50", "total of 1.234,60 EUR", False), ("MONEY", "none", "12", False), ("DATE", "2024-03-05", "on 5 March 2024", True),
        ("DATE", "2024-03-06", "on 5 March 2024", False), ("DAYS", "2 weeks", "within 14 days", True), ("CURRENCY", "EUR", "€ 5", True), ("BOOLEAN", "yes", "it renews", True),
        ("TEXT", None, "x", False), ("TEXT", "x", None, False), ("TEXT", "Kestrel", "entirely other words", False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "nr int, kind string, value string, source string, wanted boolean")
    found = df.select("nr", "wanted", fields.value_in_source(F.col("kind"), F.col("value"), F.col("source")).alias("found")).collect()
    assert [r.nr for r in found if r.found != r.wanted] == []


def test_metric_paths(spark):
    reports = ['{"a": {"b": 1}}', '{"a": {"b": 0.5}}', '{"a": {"b": null}}', '{"a": 3}', '{"a": {"b": "1"}}', '{"a": {"b": false}}', "no json", None]
    df = spark.createDataFrame([*enumerate(reports)], "nr int, report string").select("nr", metrics.metric_at(F.col("report"), "$.a.b").alias("m")).orderBy("nr")
    assert [(r.m.value, r.m.problem) for r in df.collect()] == [(1.0, None), (0.5, None), *[(None, "missing")] * 2, *[(None, "not a number")] * 2, *[(None, "missing")] * 2]


def test_headings():
    assert text.heading("Section 4.1 - Late payment.") == ("4.1", "Late payment")
    assert text.heading("12) Term") == ("12", "Term")
    assert text.heading("4. the buyer pays") is None
    assert text.heading("4. Where the buyer is late,") is None


def test_header_offset_and_bounds(spark):
    rows = [(["#", "Item", "Qty", "Price"], ["Item", "Qty", "Price"], 1), (["Item", "Qty"], ["Item", "Qty"], 0), (["Nr", "Item"], ["Item"], None), ([], [], None), (None, ["a"], None), (["a", "b"], ["c", "b"], None), (["#"], [], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "nr int, a array<string>, b array<string>, wanted int")
    found = df.select("nr", "wanted", extraction.header_offset(F.col("a"), F.col("b")).alias("found")).collect()
    assert [r.nr for r in found if r.found != r.wanted] == []
    box = "array<struct<x0: double, x1: double>>"
    df = spark.createDataFrame([([(0.0, 10.0), (20.0, 30.0), (50.0, 60.0)], [(0.0, 12.0), (16.0, 44.0)]), ([(0.0, 1.0)], []), ([], None)], f"h {box}, w {box}")
    # Between the first two headers the gap of the words; before the third, free from 44 on.
    assert [r[0] for r in df.select(extraction.column_bounds(F.col("h"), F.coalesce("w", F.array().cast(box)))).collect()] == [[15.0, 49.99], [], []]


WORD = "page_id long, text string, x0 double, y0 double, x1 double, y1 double, size double"


def words(*cells):
    return [(1, s, float(x), float(y), x + 5.0 * len(s), y + 10.0, 10.0) for x, y, s in cells]


def test_blocks_and_labels(spark):
    """Columns of labels read with their values, prose in columns reads down, empty pages give nothing."""
    page = words((10, 10, "Date"), (60, 10, "2024"), (10, 24, "No"), (60, 24, "17"), (10, 100, "left"), (30, 100, "side"), (10, 114, "goes"), (400, 100, "right"), (400, 114, "too"))
    df = spark.createDataFrame(page, WORD)
    apart = [r.text for r in extraction.blocks(df, merge=False).orderBy("block").collect()]
    merged = [r.text for r in extraction.blocks(df).orderBy("block").collect()]
    assert apart == ["Date\nNo", "2024\n17", "left side\ngoes", "right\ntoo"] and merged == ["Date 2024\nNo 17", "left side\ngoes", "right\ntoo"]
    assert extraction.blocks(df.limit(0)).count() == 0 and extraction.lay_out(df.limit(0)).count() == 0


def test_vendor_recall(spark):
    """Names with a letter changed, dropped or doubled anywhere still find their vendor, however common their letters are."""
    names = ["Kestrel Marine", "Osprey Marine", "Harbor and Pine", "Pine Marine Supply", "North Sea Freight", "Marine Freight Nord", "Albatross Lines", "Petrel Lines Freight"]
    vendors = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "vendor_id long, name string, tax_id string")
    printed = [(100 * i + k, n[:k] + n[k] * 2 + n[k + 1 :], None) for i, n in enumerate(names) for k in range(len(n)) if n[k].isalpha()]
    printed += [(100 * i + 50 + k, n[:k] + n[k + 1 :], None) for i, n in enumerate(names) for k in range(1, len(n)) if n[k].isalpha()] + [(-1, None, None), (-2, "Nobody", None)]
    found = {r.doc_id: r.vendor_id for r in extraction.resolve_vendors(spark.createDataFrame(printed, "doc_id long, name string, tax_id string"), vendors).collect()}
    assert {d: v for d, v in found.items() if d >= 0} == {d: d // 100 for d, _, _ in printed if d >= 0} and found[-1] is None and found[-2] is None
    aliases = spark.createDataFrame([(3, "PMS Group")], "vendor_id long, alias string")
    one = spark.createDataFrame([(1, "P.M.S. group ltd", "x")], "doc_id long, name string, tax_id string")
    assert [(r.vendor_id, r.method) for r in extraction.resolve_vendors(one, vendors, aliases).collect()] == [(3, "name")]


def test_places_of_a_hot_key(spark):
    df = spark.range(1000).selectExpr("IF(id % 10 < 9, 1, NULL) AS k", "id % 7 AS o", "id")
    got = {(r.k, r.o, r.id): r.place for r in ranking.places(df, "k", ["o", "id"], "place").collect()}
    for k in (1, None):
        assert [got[x] for x in sorted(x for x in got if x[0] == k)] == list(range(1, 1 + sum(x[0] == k for x in got)))


def test_tools(spark):
    docs = spark.createDataFrame([(1, "INVOICE", 10.0, None), (2, "INVOICE", 5000.0, None)], "doc_id long, document_type string, total double, doc_date date")
    tables = {"documents": docs, "tasks": spark.createDataFrame([(1, "OPEN")], "doc_id long, state string")}
    assert [r.doc_id for r in tools.call("search_documents", tables, query="invoices over 1k").collect()] == [2]
    assert tools.call("create_review_task", tables, document_id=1, reason="x").count() == 0 and tools.call("create_review_task", tables, document_id=2, reason="x").count() == 1
    with pytest.raises(KeyError):
        tools.call("drop_everything", tables)
    with pytest.raises(PermissionError):
        tools.call("generate_report", tables, allowed={"get_document"}, document_id=1)
    with pytest.raises(ValueError, match="document_id"):
        tools.call("get_document", tables)


def test_readings_pair_by_place_when_nothing_else_helps():
    rows = lambda *names: [{"line": i, "key": None, "description": n} for i, n in enumerate(names)]
    assert matching.reading_pairs(rows("aaaa", "bbbb"), rows("cccc", "dddd"), 85) == [(0, 0), (1, 1)]
    assert matching.reading_pairs(rows("blue steel pipe"), rows("red", "blue steel pipes"), 85) == [(0, 1), (None, 0)]
    assert matching.reading_pairs([], rows("a"), 85) == [(None, 0)] and matching.reading_pairs(rows(None), rows(None, "x"), 85) == [(0, None), (None, 0), (None, 1)]


def plain_bounds(header, words):
    """Column bounds by trying every place."""
    out = []
    for (a0, a1), (b0, b1) in zip(header, header[1:], strict=False):
        near = [w for w in words if w[1] > a0 and w[0] < b1]
        edges = sorted({e for w in near for e in w})
        places = [(a1 + b0) / 2, b0 - 0.01, *[(p + q) / 2 for p, q in zip(edges, edges[1:], strict=False) if a1 <= (p + q) / 2 < b0]]
        out.append(min(places, key=lambda x: (sum(w[0] < x < w[1] for w in near), -x)))
    return out


def test_column_bounds_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        edges = sorted(rng.sample(range(0, 400), 6))
        header = [(float(edges[k]), float(edges[k + 1])) for k in (0, 2, 4)][: rng.randrange(1, 4)]
        words = [(float(x), float(x + rng.randrange(5, 90))) for x in rng.sample(range(0, 400), rng.randrange(0, 9))]
        rows.append((i, header, words))
    box = "array<struct<x0 double, x1 double>>"
    df = spark.createDataFrame(rows, f"id long, header {box}, words {box}")
    found = {r.id: r.bounds for r in df.select("id", extraction.column_bounds(F.col("header"), F.col("words")).alias("bounds")).collect()}
    assert {i: pytest.approx(plain_bounds(h, w)) for i, h, w in rows} == found


def test_notice_days_of_any_length(spark):
    """More than four digits are a period too; what no number can hold is none, and no error."""
    said = ["12345 days written notice", "notice of at least 900123 days, or thirty (30) days notice", f"notice period of {'9' * 30} days", "notice"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "nr int, said string")
    found = df.select("nr", text.notice_days(F.col("said")).alias("days")).orderBy("nr").collect()
    assert [r.days for r in found] == [12345, 900123, None, None]


def test_payment_terms_of_any_length(spark):
    said = ["net 30", "Net 1234, late ones due in 7 days", "payment within 900123 calendar days", f"terms: {'9' * 30}", "1234 days"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "nr int, said string")
    found = df.select("nr", text.payment_terms(F.col("said")).alias("days")).orderBy("nr").collect()
    assert [r.days for r in found] == [[30], [1234, 7], [900123], [None], []]


def test_yes_no_has_the_edges_of_sql(spark, duck):
    """A letter outside ASCII ends a word for SQL, on either side; the long s is an s."""
    said = ["noñra", "ñno", "ñno1", "nové", "not renewé", "éyes", "yeſ", "aſhall renew", "ſhall renew", "falſe", "anyes", "no_", "renews automatically", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "doc_id long, text string")
    wanted = duck.execute(f"WITH documents(doc_id, text) AS (SELECT unnest(range({len(said)})), unnest(?)) {SQL['x17_yes_no']}", [said]).fetchall()
    assert [tuple(r) for r in df.select("doc_id", values.yes_no(F.col("text"))).orderBy("doc_id").collect()] == sorted(wanted)


def test_pages_are_laid_out_once(spark, folder):
    """Cells and headers read the same stored lines; a block knows its lines and does not count them again."""
    cells = QUERIES["g07_table_cells"](spark, folder)
    assert "MapInArrow" not in cells._jdf.queryExecution().executedPlan().toString()
    block = extraction.Block(3, 0, extraction.Box("a", 0.0, 0.0, 5.0, 9.0, 9.0))
    lines = block.lines
    block.add([(4, 0, extraction.Box("b", 0.0, 12.0, 5.0, 21.0, 9.0))])
    assert block.lines is lines and lines == {3, 4}
