"""Fuzzy similarity of short strings, 0 to 100: indel ratio, token set, best partial alignment."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit parallelism."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    row = mask
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 times the common subsequence over both lengths; two empty strings are equal."""
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with each side's rest; 100 if one side is all shared."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not left or not right):
        return 100.0
    with_left, with_right = f"{shared} {left}".strip(), f"{shared} {right}".strip()
    best = ratio(with_left, with_right)
    return max(best, ratio(shared, with_left), ratio(shared, with_right)) if shared else best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    known = set(a)
    best = 0.0
    for i in range(-len(a) + 1, len(b)):
        window = b[max(0, i) : i + len(a)]
        if window and (window[-1] in known or window[0] in known):
            best = max(best, ratio(a, window))
    return best


#: Legal forms that end a company's name.
LEGAL_FORMS = (
    "inc incorporated llc ltd limited gmbh pvt private co corp corporation company plc ag sa bv nv oy ab srl spa llp lp kg ohg pty sarl se".split()
)


def organization_key(name: str) -> str:
    """A company's name without case, accents, marks and legal forms at its end."""
    text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().casefold().replace("&", " and ")
    text = re.sub(r"\b([a-z])\.(?=[a-z]\.)", r"\1", text)
    words = re.sub(r"[^\w\s]", " ", text).split()
    while words and words[-1] in LEGAL_FORMS:
        words.pop()
    for form in (["l", "l", "c"], ["g", "m", "b", "h"], ["s", "a"]):
        if words[-len(form) :] == form and len(words) > len(form):
            words = words[: -len(form)]
    return " ".join(words)


def name_similarity(a: str, b: str) -> float:
    return max(token_set_ratio(a, b), ratio(a, b)) if a and b else 0.0


def _pairwise(score):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(score(x, y)) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, T.DoubleType())


indel_ratio, token_set, partial, name_score = (_pairwise(f) for f in (ratio, token_set_ratio, partial_ratio, name_similarity))


@F.pandas_udf(T.StringType())
def organization(names: pd.Series) -> pd.Series:
    return names.map(organization_key, na_action="ignore")
