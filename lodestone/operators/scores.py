"""Corpus BLEU and chrF++ from pooled n-gram statistics.

Statistics of a pair are arrays of counts; corpora pool them by sums, which
combine before the shuffle, and a closed form gives the score. ``macro`` averages
scores of groups instead.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLEU_ORDER, CHAR_ORDER, WORD_ORDER, BETA = 4, 6, 2, 2.0
_SIZE_BLEU, _SIZE_CHRF = 2 + 2 * BLEU_ORDER, 3 * (CHAR_ORDER + WORD_ORDER)


def tokens_13a(text: str) -> list[str]:
    """Tokens by the mteval-v13a rules: punctuation apart, but not within numbers."""
    text = " " + text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ") + " "
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(a, b)
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", text)
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def _grams(items, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def bleu_statistics(pred: str, ref: str) -> list[int]:
    """Lengths, then matches and totals of each order."""
    p, r = tokens_13a(pred), tokens_13a(ref)
    out = [len(p), len(r)]
    for n in range(1, BLEU_ORDER + 1):
        a = _grams(p, n)
        out += [(a & _grams(r, n)).total(), a.total()]
    return out


def bleu(s: list[int]) -> float:
    """0 to 100; an order without matches counts half of the one before (exponential smoothing)."""
    if not s[0] or not any(s[2::2]):
        return 0.0
    logs, halves = 0.0, 1.0
    for right, total in zip(s[2::2], s[3::2], strict=True):
        if not total:
            return 0.0
        if not right:
            halves *= 2
        logs += math.log(right / total if right else 1 / (halves * total))
    brevity = min(0.0, 1 - s[1] / s[0])
    return 100 * math.exp(brevity + logs / BLEU_ORDER)


def _words(text: str) -> list[str]:
    """Words with one mark at an end split off."""
    out = []
    for w in text.split():
        if len(w) > 1 and not w[-1].isalnum() and w[-1].isascii():
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and not w[0].isalnum() and w[0].isascii():
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf_statistics(pred: str, ref: str) -> list[int]:
    """For each order of characters, then words: predicted, true and matching n-grams."""
    out: list[int] = []
    sides = ("".join(pred.split()), "".join(ref.split())), (_words(pred), _words(ref))
    for (p, r), order in zip(sides, (CHAR_ORDER, WORD_ORDER), strict=True):
        for n in range(1, order + 1):
            a, b = _grams(p, n), _grams(r, n)
            out += [a.total(), b.total(), (a & b).total()]
    return out


def chrf(s: list[int]) -> float:
    """chrF++ of 0 to 100: the mean over orders that both sides have."""
    scores = []
    for p, r, m in zip(s[::3], s[1::3], s[2::3], strict=True):
        if p and r:
            a, b = m / p, m / r
            scores.append((1 + BETA**2) * a * b / (BETA**2 * a + b) if m else 0.0)
    return 100 * sum(scores) / len(scores) if scores else 0.0


def _statistics(make, pred: Column, ref: Column) -> Column:
    import pandas as pd

    return F.pandas_udf(lambda p, r: pd.Series([make(a or "", b or "") for a, b in zip(p, r, strict=True)]), "array<bigint>")(pred, ref)


def pooled(df: DataFrame, keys: list[str], pred: str = "pred", ref: str = "ref") -> DataFrame:
    """(keys, n, bleu, chrf) of the rows of each group, over summed statistics."""
    rows = df.select(*keys, _statistics(bleu_statistics, F.col(pred), F.col(ref)).alias("b"), _statistics(chrf_statistics, F.col(pred), F.col(ref)).alias("c"))
    sums = [F.sum(F.get("b", F.lit(i))).alias(f"b{i}") for i in range(_SIZE_BLEU)] + [F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(_SIZE_CHRF)]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    score = lambda f: F.pandas_udf(lambda s: s.map(lambda x: float(f(list(map(int, x))))), "double")
    return out.select(
        *keys, "n", score(bleu)(F.array(*(f"b{i}" for i in range(_SIZE_BLEU)))).alias("bleu"), score(chrf)(F.array(*(f"c{i}" for i in range(_SIZE_CHRF)))).alias("chrf")
    )


def macro(scores: DataFrame) -> DataFrame:
    """Plain means over groups, whatever their sizes."""
    return scores.agg(F.sum("n").alias("n"), F.avg("bleu").alias("bleu"), F.avg("chrf").alias("chrf"))
