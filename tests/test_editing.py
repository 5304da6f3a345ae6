"""Edit distances against the plain table."""

import random
import time

from hypothesis import given
from hypothesis import strategies as st

from paperloom.operators.editing import edit_distance, word_errors


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40))
def test_edit_distance(a, b):
    assert edit_distance(a, b) == plain(a, b)


def test_long_texts():
    rng = random.Random(1)
    a = [rng.choice("abcdefgh") for _ in range(20_000)]
    b = [x for x in a if rng.random() > 0.05]
    began = time.time()
    found = edit_distance(a, b)
    assert time.time() - began < 20 and found == len(a) - len(b)
    short = [rng.choice("ab") for _ in range(1500)], [rng.choice("ab") for _ in range(1200)]
    assert edit_distance(*short) == plain(*short)


def test_word_errors(spark):
    rows = [("the cat sat", "the cat sat"), ("the cat sat", "a cat"), ("", ""), (None, "x y"), ("x", None), ("one  two\nthree", "one two four three")]
    out = spark.createDataFrame(rows, "t string, r string").select(word_errors("t", "r").alias("e")).select("e.*").collect()
    assert [tuple(r) for r in out] == [(0, 3, 0.0), (2, 3, 2 / 3), (0, 0, 0.0), (2, 0, 1.0), (1, 1, 1.0), (1, 3, 1 / 3)]
