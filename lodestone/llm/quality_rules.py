"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each document gets a handful of counts from its whole text; rules are boolean
expressions over the text and those counts. On a bounded sample every rule's
cost (its own time on the sample, beside that of counting rows) and selectivity
(share of documents that it rejects) are estimated, and the cascade evaluates
rules by falling rejections per cost. A document that one rule rejects skips the
later ones, as ``CASE WHEN`` does. The order changes the work, never the verdict.

Words are split once a text and shared by all rules; every other count is made
only where a rule that needs it is reached. Repeated windows, most of all cost,
are sorted only in texts that have some.

Nothing is shuffled but the sample: every count is a function of one row, so a
hot source or a group of copies costs no more than other rows do.

Defined results: a null text counts as empty (no words: rejected); repeated
rows each get their own row; an empty table gives an empty table; further
columns of the input are left alone, and those called like a result column are
replaced by it.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SEPARATORS, let, unused, written

#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000
SAMPLE_TASKS = 8
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


_SEPARATORS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATORS))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash another one has, each counted once. A window's hash stands at its first word's place."""

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        repeated = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == F.get(s, k)["h"])),
        )
        return F.sort_array(F.transform(repeated, lambda k: F.get(s, k)["i"]))

    def words(a: Column) -> Column:
        steps = F.aggregate(
            F.sequence(F.lit(1), F.size(a) - 1),
            F.lit(3),
            lambda total, k: total + F.least(F.lit(3), F.get(a, k) - F.get(a, k - 1)),
        )
        return F.when(F.size(a) == 0, 0).when(F.size(a) == 1, 3).otherwise(steps)

    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(ranked, starts), words)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each counted once."""

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h))

    return F.when(F.size(words) < 4, 0).otherwise(let(let(F.transform(words, lambda x: F.xxhash64(x)), windows), counted))


def counts(text: Column, words: Column) -> dict[str, Column]:
    """The counts of a text that has these words, each as an expression of its own."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SEPARATORS, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """``rejects``: an expression that is true for documents to reject."""

    name: str
    rejects: Column


def _kept_chars(text: Column, pattern: str) -> Column:
    """Number of characters of a text that a character class holds."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))


def default_rules(text: Column, c: dict[str, Column]) -> list[Rule]:
    """The two base rules and further ones that clean prose, lists and tables pass."""
    return [
        Rule("few_words", c["n_words"] < MIN_WORDS),
        Rule("repeated_windows", 100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]),
        Rule("symbols", _kept_chars(text, "#*$%&<>") > c["n_words"]),
        Rule("shouting", 2 * _kept_chars(text, "A-Z") > c["word_chars"]),
        Rule("exclamations", 2 * _kept_chars(text, "!") > c["n_words"]),
        Rule("long_words", c["word_chars"] > 40 * c["n_words"]),
        Rule("duplicate_lines", 10 * c["n_dup_lines"] > 8 * F.size(F.split(text, "\n"))),
    ]


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A sample of at most ``rows`` rows from all partitions, written once."""
    total = docs.count()
    share = min(1.0, 2.0 * rows / max(total, 1))
    return written(docs.sample(fraction=share, seed=42).orderBy(F.rand(42)).limit(rows).repartition(SAMPLE_TASKS), "sample")


def _seconds(sample: DataFrame, what: Column) -> float:
    """The lesser time of two runs of an aggregate over the sample."""
    times = []
    for _ in range(2):
        began = time.perf_counter()
        sample.agg(what).first()
        times.append(time.perf_counter() - began)
    return min(times)


def ordered(rules: list[Rule], sample: DataFrame) -> list[Rule]:
    """Rules by falling (share rejected) / (cost on the sample); those that reject none there by rising cost.

    Costs are in powers of two over that of counting rows, so that a clock's noise does not reorder rules.
    """
    total = F.count(F.lit(1)).alias("total")
    shares = sample.agg(total, *(F.count_if(r.rejects).alias(r.name) for r in rules)).first()
    base = _seconds(sample, F.count(F.lit(1)))
    rank = {}
    for r in rules:
        cost = 2.0 ** round(math.log2(max(_seconds(sample, F.count_if(r.rejects)) - base, 1e-3)))
        rank[r.name] = (-(shares[r.name] or 0) / max(shares["total"], 1) / cost, cost, r.name)
    return sorted(rules, key=lambda r: rank[r.name])


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.rejects, F.lit(r.name)).otherwise(out)
    return out


def _order(docs: DataFrame, text: str, sample_rows: int) -> list[str]:
    sample = sample_of(docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), sample_rows)
    t = F.col("text")
    return [r.name for r in ordered(default_rules(t, counts(t, words_of(t))), sample)]


def _first_rejecting(text: Column, order: list[str], c: dict[str, Column]) -> Column:
    by = {r.name: r for r in default_rules(text, c)}
    return cascade([by[k] for k in order])


def quality_filter(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``."""
    order = _order(docs, text, sample_rows)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.where(let(words_of(t), lambda w: _first_rejecting(t, order, counts(t, w))).isNull())


def quality_report(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without its text, with the counts, ``base_failed`` and ``kept``."""
    order = _order(docs, text, sample_rows)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    result = (*COUNTS, "base_failed", "kept")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, *result)]

    def found(w: Column) -> Column:
        return F.struct(*(v.alias(k) for k, v in counts(t, w).items()))

    def judged(c: Column) -> Column:
        c = {k: c[k] for k in COUNTS}
        by = {r.name: r for r in default_rules(t, c)}
        base = by["few_words"].rejects | by["repeated_windows"].rejects
        rest = cascade([by[k] for k in order if k not in ("few_words", "repeated_windows")])
        return F.struct(*(v.alias(k) for k, v in c.items()), base.alias("base_failed"), (~base & rest.isNull()).alias("kept"))

    report = unused("__report", docs)
    out = docs.select(*kept, let(let(words_of(t), found), judged).alias(report))
    return out.select(*kept, f"{report}.*")
