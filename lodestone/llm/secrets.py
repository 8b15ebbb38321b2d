"""Secret scans by assignment-aware lexing.

Source and configuration syntax in a text is lexed into pairs of a name and a
value: ``name = "literal"``, ``"name": "literal"``, ``name => 'literal'``,
``export NAME=literal``, ``<name>literal</name>`` and ``key="name"
value="literal"``. A value is a term or a concatenation of terms (by ``+``, ``.``
between blanks, or side by side): quoted strings with escapes, triple-quoted ones,
bare words and names of constants. Constants are propagated: a name stands for
the value that it was last given before, in the innermost block around that
gives it one, else for the first one after. Blocks are by indentation. Pairs in
comments are scanned but define no constants. A call's result is no literal.

A pair is scored by how sensitive the words of its target name are, less what
speaks for a harmless value, plus the look of its literal (all strings joined) or
of a constant in it; for pairs at or over the threshold each string of the value
and of its constants is a span of kind ``named``.

Three base patterns are always reported: ``assign``, ``access`` and ``hex``.

Lexing starts at assignment signs and never looks back over what it has read, so
a scan is linear in the text; no length is bounded. All is done within one row,
so hot sources and large groups of copies spread as the input's partitions do.
Positions are code points, ends exclusive.

Defined results: a null text counts as empty; repeated rows each get a row; an
empty table gives an empty table; ``redact`` keeps all columns of its input;
``report`` keeps all but the text, and those called like a result column are
replaced by it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import unused

KINDS = ("assign", "access", "hex", "named")

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGNED = 8

# Weights of the words of a name: fixed values of this operator.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "pass": 2, "secret": 3, "token": 3, "apikey": 3,
    "credential": 3, "credentials": 3, "private": 2, "access": 1, "auth": 2, "authorization": 2, "bearer": 2,
    "api": 1, "key": 1, "signing": 1, "encryption": 1, "session": 1, "client": 1, "license": 1,
}
HARMLESS = {
    "example": -2, "sample": -2, "placeholder": -3, "dummy": -2, "name": -2, "field": -2, "length": -3, "len": -3,
    "count": -3, "max": -2, "min": -2, "url": -2, "uri": -2, "path": -2, "file": -2, "type": -2, "public": -2,
    "hint": -2, "policy": -2, "expires": -2, "expiry": -2, "header": -1, "id": -1,
}
THRESHOLD = 4.0
MIN_LITERAL = 8

_SIGN = re.compile(r":=|=>|(?<![=!<>+:])=(?!=)|(?<!:):(?![:/])")
#: Before a sign, read backwards: blanks, a bracket and a quote that close, the name.
_BEFORE = re.compile(r"""[ \t]*+(?:\][ \t]*+)?["'`]?([A-Za-z0-9_.\-]*+)""")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
_BLANKS, _SPACE = re.compile(r"[ \t]*+"), re.compile(r"\s*+")
_OPENING = re.compile(r"""(?i:[rbuf]{0,2})(\"{3}|'{3}|["'`])""")
_STRING = {q: re.compile(rf"(?s:[^{q}\\\n]|\\.)*+{q}") for q in "\"'`"}
_LONG_STRING = {q: re.compile(rf"(?s:[^{q}\\]|\\.|{q}(?!{q}{q}))*+{q}{q}{q}") for q in "\"'"}
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_PLUS = re.compile(r"[ \t]*+(?:\+|\.(?=[ \t\"'])|\\\n)[ \t]*+(?:\n[ \t]*+)?")
_TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.\-]*+)(?:\s[^<>]*+)?>\s*+([^<>]*?)\s*</([A-Za-z_][A-Za-z0-9_.\-]*+)\s*+>")
_COMMENT = re.compile(r"(?:(?<=\s)|^)(?:#|//|--|;)[^\n]*|/\*|<!--", re.MULTILINE)
_LINE = re.compile(r"^([ \t]*)\S", re.MULTILINE)
_SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    start: int
    kind: str
    end: int


def _order(s: Span) -> tuple[int, int, int]:
    return s.start, KINDS.index(s.kind), s.end


def base_spans(text: str) -> list[Span]:
    out = [Span(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    out += [Span(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [Span(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=_order)


class Term(NamedTuple):
    """A literal's place, or that of a constant's name."""

    start: int
    end: int
    constant: bool


class Pair(NamedTuple):
    name: str
    at: int  # of its sign
    terms: list[Term]


class Lexer:
    """Reads values; what was found to be without an end is not looked for again."""

    def __init__(self, text: str):
        self.text = text
        self.unclosed: dict[str, int] = {}  # of a quote: up to where no string closes

    def _string(self, at: int) -> tuple[Term, int] | None:
        """A quoted string that starts at ``at``, and where it ends."""
        m = _OPENING.match(self.text, at)
        if not m or self.unclosed.get(m[1], -1) > m.end():
            return None
        end = (_STRING if len(m[1]) == 1 else _LONG_STRING)[m[1][0]].match(self.text, m.end())
        if end:
            return Term(m.end(), end.end() - len(m[1]), False), end.end()
        stop = self.text.find("\n", m.end()) if len(m[1]) == 1 else -1
        self.unclosed[m[1]] = stop if stop >= 0 else len(self.text)
        return None

    def _term(self, at: int) -> tuple[Term, int] | None:
        if found := self._string(at):
            return found
        m = _BARE.match(self.text, at)
        if not m:
            return None
        end, name = m.end(), _IDENTIFIER.fullmatch(self.text, at, m.end())
        if name and self.text[end : end + 1] in ("(", "["):
            return None  # a call or a part of something
        return Term(at, end, bool(name)), end

    def value(self, at: int) -> tuple[list[Term], int]:
        """The terms of the value at ``at``, and where it ends."""
        at = _BLANKS.match(self.text, at).end()
        between = _BLANKS
        if self.text[at : at + 1] == "(":
            at, between = _SPACE.match(self.text, at + 1).end(), _SPACE
        terms: list[Term] = []
        found = self._term(at)
        while found:
            terms.append(found[0])
            at = found[1]
            if m := _PLUS.match(self.text, at):
                found = self._term(m.end())
            elif self.text[terms[-1].end : at]:  # a string; another may stand beside it
                found = self._string(between.match(self.text, at).end())
            else:
                break
        return terms, at


def assigned(text: str) -> list[Pair]:
    """Pairs made by a sign, in order of the text."""
    out, lexer, at = [], Lexer(text), 0
    while m := _SIGN.search(text, at):
        # The name ends at the sign and does not reach back over the line's start or the value before.
        start = max(at, text.rfind("\n", at, m.start()) + 1)
        name = _BEFORE.match(text[start : m.start()][::-1])[1][::-1].lstrip("0123456789.-")
        at = m.end()
        if not name:
            continue
        terms, end = lexer.value(at)
        if terms:
            key = out[-1] if out and name.lower() == "value" else None
            if key and key.name.lower() in ("key", "name") and not key.terms[-1].constant and not re.search(r"[<>\n]", text[key.terms[-1].end : m.start()]):
                name = text[key.terms[0].start : key.terms[0].end]
            out.append(Pair(name, m.start(), terms))
            # A bare word may hold a sign of its own, as in "a=b=c".
            at = end if text[terms[-1].end : end] else max(at, terms[0].start)
    return out


def pairs(text: str) -> list[Pair]:
    """Pairs made by signs, then those of tags."""
    tags = _TAG.finditer(text) if "</" in text else ()
    return assigned(text) + [Pair(m[1], m.start(2), [Term(*m.span(2), False)]) for m in tags if m[1] == m[3] and m[2]]


def comments(text: str) -> list[tuple[int, int]]:
    """[start, end) of comments, in order."""
    out, at = [], 0
    closed = {"/*": "*/", "<!--": "-->"}
    while m := _COMMENT.search(text, at):
        end = m.end()
        if m[0] in closed:
            stop = text.find(closed[m[0]], end)
            if stop < 0:  # nothing closes it: no comment, nor is any later one of its kind
                del closed[m[0]]
                at = end
                continue
            end = stop + len(closed[m[0]])
        elif m[0] in ("/*", "<!--"):
            at = end
            continue
        out.append((m.start(), end))
        at = end
    return out


class Constants:
    """What names stand for at a place of a text."""

    def __init__(self, text: str, found: list[Pair]):
        self.text, self.found = text, found
        self.starts, self.blocks = [0], [(0,)]  # of lines: their start and the blocks around, outermost first
        indents, stack = [0], [0]
        for n, m in enumerate(_LINE.finditer(text)):
            indent = len(m[1].expandtabs(8))
            while indents and indent < indents[-1]:
                indents.pop()
                stack.pop()
            if not indents or indent > indents[-1]:
                indents.append(indent)
                stack.append(n + 1)
            self.starts.append(m.start())
            self.blocks.append(tuple(stack))
        spans = comments(text)
        begun = [a for a, _ in spans]
        self.of: dict[tuple[str, int], list[int]] = defaultdict(list)
        for k, p in enumerate(found):
            c = bisect_left(begun, p.at) - 1
            if c < 0 or spans[c][1] <= p.at:
                self.of[p.name, self._around(p.at)[-1]].append(k)
        for ks in self.of.values():
            ks.sort(key=lambda k: found[k].at)
        self.memo: dict[int, tuple[list[Term], list[int]]] = {}

    def _around(self, at: int) -> tuple[int, ...]:
        return (0, *self.blocks[bisect_left(self.starts, at + 1) - 1])

    def _definition(self, name: str, at: int) -> int | None:
        """The pair that gives ``name`` its value at a place."""
        late = None
        for block in reversed(self._around(at)):
            ks = self.of.get((name, block))
            if not ks:
                continue
            k = bisect_left(ks, at, key=lambda k: self.found[k].at)
            if k:
                return ks[k - 1]
            if late is None and self.found[ks[0]].at > at:
                late = ks[0]
        return late

    def split(self, k: int) -> tuple[list[Term], list[int]]:
        """Pair k's own literals (and bare words that no constant has), and the pairs that its constants are from."""
        if k not in self.memo:
            own, others = [], []
            for t in self.found[k].terms:
                d = self._definition(self.text[t.start : t.end], self.found[k].at) if t.constant else None
                if d is None or d == k:
                    own.append(t)
                else:
                    others.append(d)
            self.memo[k] = own, others
        return self.memo[k]


class Values:
    """Looks of pairs' values, and which of them are to be reported; each pair is looked at once."""

    def __init__(self, text: str, found: list[Pair], constants: Constants | None):
        self.text, self.found, self.constants = text, found, constants
        self.looks: dict[int, float] = {}
        self.reported: dict[int, list[Term]] = {}

    def _split(self, k: int) -> tuple[list[Term], list[int]]:
        return self.constants.split(k) if self.constants else (self.found[k].terms, [])

    def look(self, k: int) -> float:
        """The score of a value's own literal, all its strings joined, or of a constant in it if that is higher."""
        todo, active = [k], set()
        while todo:
            k = todo[-1]
            own, others = self._split(k)
            missing = [d for d in others if d not in self.looks and d not in active]
            active.add(k)
            if missing and k not in self.looks:
                todo += missing
                continue
            todo.pop()
            if k not in self.looks:
                score = literal_score("".join(self.text[t.start : t.end] for t in own).strip()) if own else -4.0
                self.looks[k] = max([score, *(self.looks[d] for d in others if d in self.looks)])
        return self.looks[k]

    def report(self, k: int) -> None:
        todo = [k]
        while todo:
            k = todo.pop()
            if k not in self.reported:
                self.reported[k], others = self._split(k)
                todo += others


def entropy(literal: str) -> float:
    """Bits a character under the literal's own character counts."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) if n else 0.0


def name_score(name: str) -> int:
    words = [w.lower() for w in _SUBWORD.findall(name)]
    if words and words[-1] in HARMLESS:  # about a secret, but none: a path, a length, a hint
        return 0
    if "key" in words and {"api", "access", "private", "secret", "signing", "encryption"} & set(words):
        words.append("secret")
    return sum(SENSITIVE.get(w, 0) + HARMLESS.get(w, 0) for w in words)


def literal_score(literal: str) -> float:
    """From -4 for text with blanks, variables and addresses to 2 for random-looking strings and private keys."""
    if "PRIVATE KEY-----" in literal:
        return 2.0
    if len(literal) < MIN_LITERAL or re.search(r"\s|^\$|^<.*>$|^%|\*{3}|x{4}|://", literal):
        return -4.0
    classes = sum(bool(re.search(c, literal)) for c in ("[a-z]", "[A-Z]", r"\d", "[^A-Za-z0-9]"))
    return 1.0 * (entropy(literal) >= 3) + 0.5 * (classes >= 2) + 0.5 * (classes >= 3)


def named_spans(text: str) -> list[Span]:
    """Literals whose target's name, or that of a target they reach as a constant, is sensitive."""
    if ":" not in text and "=" not in text and "</" not in text:
        return []
    found = pairs(text)
    sensitive = [(k, n) for k, p in enumerate(found) if (n := name_score(p.name)) >= 2]
    constants = Constants(text, found) if any(t.constant for k, _ in sensitive for t in found[k].terms) else None
    values = Values(text, found, constants)
    for k, n in sensitive:
        if n + values.look(k) >= THRESHOLD:
            values.report(k)
    places = {t[:2] for terms in values.reported.values() for t in terms if t.end > t.start}
    return [Span(a, "named", b) for a, b in sorted(places)]


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and literals that none of them covers."""
    base, more, k, reach = base_spans(text), [], 0, -1
    for s in named_spans(text):
        while k < len(base) and base[k].start <= s.start:
            reach = max(reach, base[k].end)
            k += 1
        if s.end > reach:
            more.append(s)
    return base, sorted(base + more, key=_order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


REPORT = "struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base_sha256: string, spans: string, n_named: bigint>"


def _report(texts):
    import pandas as pd

    rows = []
    for text in texts:
        base, every = scan(text or "")
        n = Counter(s.kind for s in every)
        rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), n["named"]))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"])


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with counts and spans of each row."""
    result = T.StructType.fromDDL(REPORT[7:-1]).names
    found = unused("__found", docs)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, *result)]
    return docs.select(*kept, F.pandas_udf(_report, REPORT)(F.col(f"`{text}`")).alias(found)).select(*kept, f"{found}.*")


def masked(text: str, mask: str = "[SECRET]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for s in scan(text)[1]:
        if s.start >= at:
            out += [text[at : s.start], mask]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets masked in its text; null stays null."""

    @F.pandas_udf(T.StringType())
    def mask_all(texts):
        return texts.map(lambda x: None if x is None else masked(x, mask))

    return docs.withColumn(text, mask_all(F.col(text)))
