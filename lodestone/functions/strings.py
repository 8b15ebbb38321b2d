"""Text expressions. All are built-in functions, so they stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters per second of speech, by block of code points (fixed values).
LATIN_CPS, DEVANAGARI_CPS, CJK_CPS, OTHER_CPS = 14.0, 12.0, 5.0, 12.0
#: Tokens per second of speech, and the most that one generation may take (fixed values).
TOKENS_PER_SECOND, TOKEN_CEILING = 82.0, 2048

SENTENCE_MARKS = ".!?…।॥。！？"
CLOSERS = "\"'”’»)]}」』）】》〉"
CLAUSE_MARKS = ",;:，；：、"

_WORD = r"[\p{L}\p{N}_]"
_HYPHENS = r"[-‐-—−]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fill(template: Column, target: Column, source: Column, text: Column) -> Column:
    """``{tgt}``, ``{src}`` and ``{text}`` replaced in this order; braces in text survive."""
    return F.replace(
        F.replace(F.replace(template, F.lit("{tgt}"), target), F.lit("{src}"), source), F.lit("{text}"), text
    )


def path_segment(c: Column) -> Column:
    """A value as one path segment: odd characters to ``_``, none of ``._-`` at its ends."""
    odd = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^A-Za-z0-9._-]+", "_")
    bare = F.regexp_replace(odd, r"^[._-]+|[._-]+$", "")
    return F.when(bare == "", "unknown").otherwise(bare)


def dehyphenate(c: Column, passes: int = 2) -> Column:
    """Words rejoined that a dash breaks at a line's end.

    A match takes the letters on both sides, so a one-letter word between two
    breaks needs a second pass; after two, none is left.
    """
    for _ in range(passes):
        c = F.regexp_replace(c, f"({_WORD}){_HYPHENS}\n[ \t]*({_WORD})", "$1$2")
    return c


def join_pieces(pieces: Column) -> Column:
    """Subword pieces to text: the mark ``▁`` is a space."""
    return strip(F.replace(F.array_join(pieces, ""), F.lit("▁"), F.lit(" ")))


def language_token(c: Column) -> Column:
    """The code of a language token such as ``<|hi|>``; null for any other token."""
    code = F.regexp_extract(c, r"^<\|([a-z]{2,3})\|>$", 1)
    return F.when((code != "") & ~code.isin("itn", "pnc"), code)


def chat(messages: Column, open_reply: bool = False) -> Column:
    """Role turns in chat form after a ``<bos>``; roles other than the two are left out."""
    turn = lambda m: (
        F.when(m["role"] == "user", F.concat(F.lit("<|turn>user\n"), strip(m["content"]), F.lit("<turn|>\n")))
        .when(m["role"] == "assistant", F.concat(F.lit("<|turn>model\n"), strip(m["content"]), F.lit("<turn|>\n")))
        .otherwise("")
    )
    body = F.concat(F.lit("<bos>"), F.array_join(F.transform(messages, turn), ""))
    return F.concat(body, F.lit("<|turn>model\n")) if open_reply else body


def dialogue(turns: Column) -> Column:
    """Turns (speaker, text) serialised, a blank line between them; blank texts are left out."""
    spoken = F.filter(turns, lambda t: strip(t["text"]) != "")
    one = lambda t: F.concat(F.lit("<|speaker>"), strip(t["speaker"]), F.lit("<speaker|>\n"), strip(t["text"]))
    return F.array_join(F.transform(spoken, one), "\n\n")


def _count(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{pattern}]", ""))


def speech_seconds(c: Column) -> Column:
    """Spoken length of a text, from its characters' scripts."""
    c = F.coalesce(c, F.lit(""))
    latin = _count(c, "\\x{0}-\\x{2FF}")
    devanagari = _count(c, "\\x{900}-\\x{97F}")
    cjk = _count(c, "\\x{3000}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}")
    other = F.length(c) - latin - devanagari - cjk
    return latin / LATIN_CPS + devanagari / DEVANAGARI_CPS + cjk / CJK_CPS + other / OTHER_CPS


def char_budget(c: Column, seconds: float, least: int = 16) -> Column:
    """Characters of this text that take about so many seconds."""
    spoken = speech_seconds(c)
    return F.when(spoken > 0, F.greatest(F.lit(least), F.floor(F.length(c) / spoken * seconds).cast("int")))


def boundary(c: Column) -> Column:
    """What a chunk ends with: ``sentence``, ``clause`` or ``hard``."""
    last = F.substring(F.regexp_replace(c, r"(?U)\s+$", ""), -1, 1)
    return (
        F.when(last.isin(*(SENTENCE_MARKS + CLOSERS)), "sentence")
        .when(last.isin(*CLAUSE_MARKS), "clause")
        .otherwise("hard")
    )


def speech_estimates(chars: Column) -> tuple[Column, Column]:
    """Seconds (2 places) and tokens that so many characters take, half to even."""
    seconds = chars / LATIN_CPS
    return F.bround(seconds, 2), F.bround(seconds * TOKENS_PER_SECOND).cast("long")


def degenerate(prediction: Column, source: Column) -> Column:
    """Whether a generation is blank, or long and over 1/0.15 times its source."""
    length = F.length(prediction)
    return (
        F.when(strip(F.coalesce(prediction, F.lit(""))) == "", True)
        .when(length < 200, False)
        .otherwise((F.length(source) > 0) & (F.length(source) / length < 0.15))
    )


def output_name(row: Column, path: Column, text: Column) -> Column:
    """``NNNN_<8 hex digits>.wav`` of a row and of its path and text."""
    digits = F.lpad(row.cast("string"), 4, "0")
    number = F.when(F.length(row.cast("string")) > 4, row.cast("string")).otherwise(digits)
    key = F.concat(F.coalesce(path, F.lit("")).cast("binary"), F.lit(b"\0"), F.coalesce(text, F.lit("")).cast("binary"))
    return F.concat(number, F.lit("_"), F.substring(F.sha2(key, 256), 1, 8), F.lit(".wav"))


def md5_bucket(c: Column, buckets: int = 100) -> Column:
    """``int(md5, 16) mod buckets``, from the digest's two halves."""
    digest = F.md5(c.cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    shift = pow(2, 64, buckets)
    mod = lambda x: F.pmod(x, F.lit(buckets).cast("decimal(20,0)")).cast("int")
    return F.pmod(mod(half(1)) * shift + mod(half(17)), F.lit(buckets))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts fix: 13 hex digits of the MD5 of their join."""
    digest = F.md5(F.concat_ws("\x1f", *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
