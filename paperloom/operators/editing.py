"""Edit distances over tokens: word error rates of texts of any length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and substitutions between two sequences of any tokens.

    What both begin and end with is set aside.  A column of the table of distances is two bit
    sets, where it rises and where it falls, and a token of ``b`` moves all of it at once, so
    the work is a few operations on long whole numbers a token.
    """
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for token in b:
        here = where.get(token, 0)
        level = (((here & up) + up) ^ up) | here | down
        rise = down | ~(level | up) & full
        fall = up & level
        distance += bool(rise & top) - bool(fall & top)
        rise = rise << 1 | 1
        up = (fall << 1 | ~(level | rise)) & full
        down = rise & level & full
    return distance


@F.pandas_udf(T.StructType([T.StructField("edits", T.LongType()), T.StructField("words", T.LongType()), T.StructField("rate", T.DoubleType())]))
def word_errors(truth: pd.Series, read: pd.Series) -> pd.DataFrame:
    """Edits between the words of a text and of its reading, the text's words, and their ratio.

    Words stand between white space.  A null text or reading has none; the rate of a text
    without words is 0 if nothing was read, else 1.
    """
    out = []
    for t, r in zip(truth, read, strict=True):
        a, b = (t or "").split(), (r or "").split()
        edits = edit_distance(a, b)
        out.append((edits, len(a), edits / len(a) if a else float(bool(b))))
    return pd.DataFrame(out, columns=["edits", "words", "rate"])
