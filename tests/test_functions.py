"""Plain functions behind the UDFs, against hand-computed values."""

import datetime as dt
import timeit
from collections import Counter
from decimal import Decimal
from types import SimpleNamespace

import pytest
from hypothesis import given
from hypothesis import strategies as st

from paperloom.functions import embed, similarity, values
from paperloom.operators import metrics, search, text
from paperloom.sources.files import safe_name
from paperloom.streaming import timed


@pytest.mark.parametrize(("printed", "value", "ambiguous"), [
    ("Total 1,234.56", "1234.56", False), ("1.234,56 EUR", "1234.56", False), ("1,234", "1234", True), ("12,5", "12.5", False), ("1.234.567", "1234567", False),
    ("(45.00)", "-45.00", False), ("45.00-", "-45.00", False), ("VAT (20%) 10.00", "10.00", False), ("12 345,67", "12345.67", False), ("-3", "-3", False),
])
def test_amounts(printed, value, ambiguous):
    assert values.parse_amount(printed) == (Decimal(value), ambiguous)


def test_decimal_comma_decides():
    assert values.parse_amount("1,234", True) == (Decimal("1.234"), False)
    assert values.parse_amount("none") is None


@pytest.mark.parametrize(("printed", "readings"), [
    ("2026-03-04", [dt.date(2026, 3, 4)]), ("4 March 2026", [dt.date(2026, 3, 4)]), ("March 4th, 2026", [dt.date(2026, 3, 4)]), ("4. März 26", [dt.date(2026, 3, 4)]),
    ("04.03.2026", [dt.date(2026, 3, 4)]), ("13/04/2026", [dt.date(2026, 4, 13)]), ("03/04/2026", [dt.date(2026, 4, 3), dt.date(2026, 3, 4)]), ("01.02.75", [dt.date(1975, 2, 1)]),
])
def test_dates(printed, readings):
    assert values.find_dates(printed) == [readings]


def test_date_order_decides():
    assert values.find_dates("03/04/2026", "MDY") == [[dt.date(2026, 3, 4)]]
    assert values.find_dates("31/31/2026") == []


def test_similarity():
    assert similarity.ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)
    assert similarity.token_set_ratio("red steel pipe", "pipe steel red") == 100
    assert similarity.token_set_ratio("", "a") == 0
    assert similarity.partial_ratio("abcd", "xxabcdxx") == 100
    assert similarity.organization_key("Kestrel & Söns, G.m.b.H.") == "kestrel and sons"
    assert similarity.organization_key("Kestrel Inc. Co. Ltd") == "kestrel"


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_by_dynamic_programming(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    assert similarity.common_subsequence(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_clopper_pearson():
    assert metrics.clopper_pearson(0, 59) == pytest.approx(1 - 0.05 ** (1 / 59), abs=1e-9)
    assert metrics.clopper_pearson(5, 5) == 1 and metrics.clopper_pearson(0, 0) == 1


def test_units_and_chunks():
    units = text.markdown_units("---\ntitle: X\n---\n# T\n\n## A\nfirst\nsecond\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n### B\nthird")
    assert units == [("heading", "T", 1), ("heading", "A", 2), ("text", "first\nsecond", 0), ("table", "| a | b |\n| 1 | 2 |", 0), ("heading", "B", 3), ("text", "third", 0)]
    chunks = list(text.chunk_units(units, "T"))
    assert [(i, s) for i, s, _, _ in chunks] == [(0, "A"), (1, "A › B")]
    long = [("text", " ".join(f"Sentence number {i} is here." for i in range(200)), 0)]
    parts = list(text.chunk_units(long, "T", target=50, most=80, overlap=10))
    assert all(text.tokens(c) <= 80 + 12 for _, _, _, c in parts)
    assert parts[1][3].split("\n\n")[0] in parts[0][3]


@pytest.mark.parametrize("said", [
    "Short one. " * 40 + "Never " * 500 + ". " + "Again. " * 500, "x" * 10_000, "One here. " * 3 + "y" * 319 + "z" * 700 + ". Done.", "End. " + " ".join(["w" * 61] * 40),
])
def test_no_chunk_is_above_the_most(said):
    """Neither by what it repeats nor by a word that is longer than any chunk; nothing gets lost."""
    parts = [c for _, _, _, c in text.chunk_units([("text", said, 0)], "T", target=50, most=80, overlap=30)]
    assert max(map(text.tokens, parts)) <= 80
    assert Counter("".join(said.split())) <= Counter("".join("".join(parts).split()))


def test_clause_changes():
    old = text.segment("Agreement\n1. Term\nOne year.\n2. Payment\nNet 30 days.\n3. Liability\nNone whatsoever.")
    new = text.segment("Agreement\n1. Term\nTwo years.\n2. Notices\nQuarterly shipping reports.\n3. Payment\nNet 30 days.")
    assert [(c[0], c[1], c[2]) for c in text.compare_clauses(old, new)] == [
        ("UNCHANGED", "Preamble", "Preamble"), ("MODIFIED", "Term", "Term"), ("ADDED", None, "Notices"), ("UNCHANGED", "Payment", "Payment"), ("REMOVED", "Liability", None)]


def test_search_grammar():
    p = search.parse('purchase orders from "Harbor and Pine" between 2024-01-01 and 2024-02-01 with payment terms over 30 days')
    assert (p.types, p.vendor, p.terms, p.since, p.until) == (["PURCHASE_ORDER"], "Harbor and Pine", ("gt", 30), dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    p = search.parse("invoices net 45 at least 2.5m in 2025")
    assert (p.types, p.terms, p.amount, p.since, p.until) == (["INVOICE"], ("eq", 45), ("gte", 2.5e6), dt.date(2025, 1, 1), dt.date(2025, 12, 31))


def test_stems_and_vectors():
    assert embed.stem("tolerances") == embed.stem("tolerance")
    v = embed.hash_vector("late payment of invoices")
    assert abs((v @ v) - 1) < 1e-12 and v @ embed.hash_vector("payment of late invoices") > 0.7
    assert not embed.hash_vector("of the").any()
    assert embed.cover_density([[1], [2]]) > embed.cover_density([[1], [9]]) > embed.cover_density([[1], []]) == 0


def steps_of(rule, rows):
    """What a rule says to rows (time, good) of one key."""
    state, out = None, []
    for at, good in rows:
        if state is not None and rule.end(state) is not None and rule.end(state) <= at:
            state = None
        state, accepted = rule.step(state, SimpleNamespace(at=float(at), good=good))
        out.append(accepted)
    return out


def test_limits():
    assert steps_of(timed.TokenBucket(2, 0.1), [(0, None), (0, None), (0, None), (10, None)]) == [True, True, False, True]
    assert steps_of(timed.Lockout(2, 10), [(0, False), (1, False), (5, True), (11, True)]) == [True, True, False, True]
    assert steps_of(timed.Lockout(2, 10), [(0, False), (1, True), (5, False), (6, False), (7, False), (16, False), (17, False), (18, True)]) == [True, True, True, True, False, True, True, False]


def test_names():
    assert safe_name("a/b\\c:d?.pdf") == "cd.pdf" and safe_name(" .. ") == "document" and safe_name(None) == "document"
    assert len(safe_name("ü" * 300 + ".pdf").encode()) <= 200 and safe_name("ü" * 300 + ".pdf").endswith(".pdf")


@pytest.mark.parametrize(("question", "wanted"), [
    ("invoices from Kestrel Industrial Supply, Inc.", {"types": ["INVOICE"], "vendor": "Kestrel Industrial Supply", "text": "Inc"}),
    ("purchase orders from Harbor and Pine", {"types": ["PURCHASE_ORDER"], "vendor": "Harbor and Pine"}),
    ("documents from Bank of Ohio about loans", {"vendor": "Bank of Ohio", "text": "loans"}),
    ("documents with payment terms longer than 30 days", {"terms": ("gt", 30)}),
    ("documents with payment terms of at least 60 days", {"terms": ("gte", 60)}),
    ("documents with payment terms shorter than 45 days", {"terms": ("lt", 45)}),
    ("payment terms longer  than\t30 calendar days", {"terms": ("gt", 30)}),
    ("net 45", {"terms": ("eq", 45)}), ("payment terms net30 days", {"terms": ("eq", 30)}),
    ("invoices over 2,000", {"types": ["INVOICE"], "amount": ("gt", 2000.0)}), ("purchase orders under 1,000", {"types": ["PURCHASE_ORDER"], "amount": ("lt", 1000.0)}),
    ("contracts with a total of at most 1.5 million euros", {"types": ["CONTRACT"], "amount": ("lte", 1.5e6)}), ("invoices >= $12,345.67", {"types": ["INVOICE"], "amount": ("gte", 12345.67)}),
    ("over 30 days", {"text": "over 30 days"}), ("over 20% discount", {"text": "over 20 discount"}),
    ("invoices in March 2026", {"types": ["INVOICE"], "since": dt.date(2026, 3, 1), "until": dt.date(2026, 3, 31)}),
    ("receipts during 2025", {"types": ["RECEIPT"], "since": dt.date(2025, 1, 1), "until": dt.date(2025, 12, 31)}),
    ("in February 2024", {"since": dt.date(2024, 2, 1), "until": dt.date(2024, 2, 29)}),
    ("between 2026-01-01 and 2026-02-01", {"since": dt.date(2026, 1, 1), "until": dt.date(2026, 2, 1)}),
    ("between 2026-13-01 and 2026-14-01", {}), ("since 2026-02-30", {"text": "since 2026-02-30"}),
    ("after 2026-01-31 before 2026-03-01", {"since": dt.date(2026, 2, 1), "until": dt.date(2026, 2, 28)}), ("from 2026-01-01 until 2026-01-31", {"since": dt.date(2026, 1, 1), "until": dt.date(2026, 1, 31)}),
    ("delivery notes", {"types": ["DELIVERY_NOTE"]}), ("goods received notes and packing slips", {"types": ["DELIVERY_NOTE"], "text": "packing slips"}), ("p.o.s", {"types": ["PURCHASE_ORDER"]}),
    ("résumés and CVs", {"types": ["RESUME"], "text": "CVs"}), ("insurance policies", {"types": ["POLICY"]}), ("bank statements billed by \"Acme & Co\"", {"types": ["BANK_STATEMENT"], "vendor": "Acme & Co"}),
    ("contracts containing termination clauses", {"types": ["CONTRACT"], "text": "termination clauses"}), ("from all", {"text": "from"}), ("", {}), ("Flüge nach Köln", {"text": "Flüge nach Köln"}),
    ("agreements issued by the supplier O'Neil with notes", {"types": ["CONTRACT"], "vendor": "O'Neil", "text": "notes"}), ("find all invoices from Vendor Kestrel", {"types": ["INVOICE"], "vendor": "Kestrel"}),
])
def test_search_sentences(question, wanted):
    parsed = search.parse(question)
    assert {k: v for k, v in vars(parsed).items() if v and k != "recognized"} == wanted
    assert bool(parsed.recognized) == any(k != "text" for k in wanted)


def test_search_says_what_it_understood():
    assert search.parse("invoices over 10,000 net 30 in 2026 from Kestrel").recognized == ["dated 2026-01-01 to 2026-12-31", "payment terms exactly 30 days", "total more than 10,000", "type INVOICE", "vendor 'Kestrel'"]


def test_reading_costs_little_more_than_cutting():
    """Words that begin no phrase are passed over: reading a sentence takes under 12 times as long as cutting it into tokens."""
    said = "find all purchase orders from Harbor and Pine 77 over $5,000 in March 1996 mentioning steel pipes of good make"
    cut, read = (min(timeit.repeat(lambda f=f: f(said), number=100, repeat=7)) for f in (search.Sentence, search.parse))
    assert read < 12 * cut


@pytest.mark.parametrize(("line", "wanted"), [
    ("Clause 7 - Fees", ("7", "Fees")), ("Article 3: Term.", ("3", "Term")), ("7.2 Cap", ("7.2", "Cap")), ("7. Fees", ("7", "Fees")), ("7) Fees", ("7", "Fees")), ("7 Fees", None), ("1.2.3.4. Scope", ("1.2.3.4", "Scope")),
    ("1.2.3.4.5 Deep", None), ("30 Days after", None), ("2. the buyer pays", None), ("2. Where the buyer is late,", None), ("3. " + "Word " * 11, None), ("", None), ("SECTION 12", None), ("section 4.1) Late payment", ("4.1", "Late payment")),
])
def test_headings(line, wanted):
    assert text.heading(line) == wanted


def test_token_bucket_of_thirds():
    """A third of a token and two thirds are a whole one, whatever doubles make of it; less is refused."""
    rows = lambda *times: [(t, None) for t in times]
    assert steps_of(timed.TokenBucket(2, 1 / 3), rows(0, 1, 3)) == [True, True, True]
    assert steps_of(timed.TokenBucket(2, 1 / 3), rows(0, 1, 3, 6, 9, 12)) == [True] * 6
    assert steps_of(timed.TokenBucket(2, 1 / 3), rows(0, 1, 2.999, 3)) == [True, True, False, True]
    assert steps_of(timed.TokenBucket(2, 1 / 3600), rows(0, 1200, 3600)) == [True, True, True]


@given(st.lists(st.tuples(st.floats(0, 50), st.integers(1, 3)), max_size=40))
def test_token_bucket_by_hand(steps):
    """A bucket of two tokens that gains one in three seconds; what it lacks is refused."""
    times, at = [], 0.0
    for gap, _ in steps:
        at += gap
        times.append(at)
    passed = steps_of(timed.TokenBucket(2, 1 / 3), [(t, None) for t in times])
    left, last, wanted = 2.0, None, []
    for now in times:
        left = 2.0 if last is None else min(2.0, left + (now - last) / 3)
        last = now
        wanted.append(left >= 1 - 1e-9)
        left -= wanted[-1]
    close = [abs(x) for x in times]  # at the very edge either is right
    assert len(passed) == len(close) and sum(a != b for a, b in zip(passed, wanted, strict=True)) == 0


@given(st.lists(st.tuples(st.integers(0, 9), st.booleans()), max_size=60))
def test_lockouts_by_hand(attempts):
    """Three failures in a row lock for ten seconds and start the count anew."""
    now, rows = 0, []
    for gap, good in attempts:
        now += gap
        rows.append((now, good))
    locked_until, in_a_row, wanted = -1, 0, []
    for now, good in rows:
        wanted.append(now >= locked_until)
        if wanted[-1]:
            in_a_row = 0 if good else in_a_row + 1
            if in_a_row == 3:
                locked_until, in_a_row = now + 10, 0
    assert steps_of(timed.Lockout(3, 10), rows) == wanted



def test_cover_density_prefers_close_terms():
    import pandas as pd

    rank = embed.text_rank(["red", "pipe"]).func
    near, far, none, empty = rank(pd.Series(["a red pipe here", "red " + "word " * 30 + "pipe", "nothing", None]))
    assert near > far > 0 and none == 0 and not empty > 0


@given(st.text("abcde ", max_size=30), st.text("abcde ", max_size=30))
def test_name_similarity_is_symmetric_and_bounded(a, b):
    x, y = similarity.token_set_ratio(a, b), similarity.token_set_ratio(b, a)
    assert x == pytest.approx(y) and 0 <= x <= 100 and (similarity.ratio(a, a) == 100)


def test_hash_vectors_are_unit_and_alike_for_like_texts():
    a, b, c = (embed.hash_vector(x, 256) for x in ("red steel pipes", "red steel pipe", "holiday photographs"))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert dot(a, a) == pytest.approx(1) and dot(a, b) > 0.5 > dot(a, c)
