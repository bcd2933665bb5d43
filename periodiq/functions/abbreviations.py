"""Learning abbreviations from pairs of names (FS-25 to FS-27), and full entity decoding.

Sequence matching has no built-in expression; both run over Arrow batches and
are meant for distinct strings.
"""

from __future__ import annotations

import html
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def unescape_html(values: pd.Series) -> pd.Series:
    return values.map(lambda s: html.unescape(s) if isinstance(s, str) and "&" in s else s)


def valid_abbreviation(short: str, full: str) -> bool:
    """A dotted beginning, initials of the words, or another spelling (not a plural) of one word."""
    a, b = short.lower(), full.lower()
    if not a or not b or a == b:
        return False
    if a.endswith("."):
        return b.startswith(a[:-1]) and len(b) > len(a) + 1
    words = b.split()
    if len(words) > 1:
        return a == "".join(w[0] for w in words)
    if a in (b + "s", b + "es") or b in (a + "s", a + "es"):
        return False
    return SequenceMatcher(None, a, b).ratio() > 0.85


def _confidence(short: str, full: str) -> float:
    if short.endswith("."):
        return 0.7 if len(short) > 4 else 0.5
    return 0.6 if " " in full else 0.7


def learned(short: str, long: str) -> list[tuple[str, str, float]]:
    """Word pairs that the aligned names replace by each other and that are valid abbreviations."""
    x, y = ([w.rstrip(",;:!?") for w in s.lower().split()] for s in (short, long))
    out = []
    for op, i, j, k, m in SequenceMatcher(None, x, y).get_opcodes():
        if op == "replace" and j - i == m - k:
            for a, b in zip(x[i:j], y[k:m], strict=True):
                for p, q in ((a, b), (b, a)):
                    if len(p) <= len(q) and p != q and valid_abbreviation(p, q):
                        out.append((p, q, _confidence(p, q)))
                        break
    return out


def learn_abbreviations(pairs: DataFrame, short: str, long: str) -> DataFrame:
    """(abbreviation, word, n, confidence) over all pairs of names; null names teach nothing."""

    def run(batches):
        for pdf in batches:
            rows = [t for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True) if isinstance(a, str) and isinstance(b, str) for t in learned(a, b)]
            yield pd.DataFrame(rows, columns=["abbreviation", "word", "confidence"])

    d = pairs.select(F.col(short).alias("a"), F.col(long).alias("b")).distinct()
    d = d.mapInPandas(run, "abbreviation string, word string, confidence double")
    return d.groupBy("abbreviation", "word").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
