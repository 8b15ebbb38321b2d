"""Quotation linking against a brute-force linker over generated conversations."""

from collections import Counter

import numpy as np
import pytest

from lodestone.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def norm(lines):
    joined = " ".join(lines)
    return " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in joined).split())


def slow_level(line):
    """Quote level of a line, and the line without its marks."""
    k = 0
    while k < 3 and line[k : k + 1] in (" ", "\t"):
        k += 1
    n = 0
    while line[k : k + 1] == ">":
        n, k = n + 1, k + 1
        if line[k : k + 1] in (" ", "\t"):
            k += 1
    return (n, line[k:]) if n else (0, line)


def paragraphs(lines):
    out = [[]]
    for x in lines:
        if x.strip():
            out[-1].append(x)
        else:
            out.append([])
    out = [p for p in out if p]
    return [[x for p in out for x in p], *out]


def slow_parse(text):
    """(own passages, own lines, quoted passages as (level, passage, lines))."""
    runs = []
    for line in (text or "").split("\n"):
        level, rest = slow_level(line)
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(rest)
    own = [lines for level, lines in runs if level == 0 and any(x.strip() for x in lines)]
    passages = {norm(p) for lines in [*own, [x for lines in own for x in lines]] for p in paragraphs(lines)} - {""}
    quoted = []
    for level, lines in runs:
        for p in paragraphs(lines) if level else ():
            item = (level, norm(p), sorted({norm([x]) for x in p} - {""}))
            if item[1] and item not in quoted:
                quoted.append(item)
    return passages, {norm([x]) for lines in own for x in lines} - {""}, quoted


def slow_links(rows):
    """Counter-like list of (conv, turn, level, origin) of each quoted passage."""
    parsed = [(c, t, *slow_parse(x)) for c, t, _, x in rows]

    def origin(conv, turn, text, lines):
        held = [(c, t) for c, t, passages, own, _ in parsed if text in passages or (lines and text in own)]
        first = min((t for c, t in held if c == conv), default=None)
        if first is not None and first < turn:
            return (conv, first)
        return min((p for p in held if p[0] != conv), default=None)

    out = []
    for conv, turn, _, _, quoted in parsed:
        for level, text, lines in quoted:
            found = origin(conv, turn, text, False)
            if not found:
                every = [origin(conv, turn, x, True) for x in lines]
                if all(every):
                    found = max(every) if all(c == conv for c, _ in every) else min(every)
            out.append((conv, turn, level, found))
    return out


def generated(seed, conversations, turns):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "eta", "theta"]
    line = lambda: " ".join(rng.choice(words, rng.integers(2, 5)))
    said, rows = [], []
    for c in range(conversations):
        here = []
        for t in range(turns):
            parts = []
            for _ in range(rng.integers(1, 4)):
                paragraph = [line() for _ in range(rng.integers(1, 4))]
                kind = rng.random()
                if kind < 0.45 or not said:
                    parts.append("\n".join(paragraph))
                    here.append(paragraph)
                    continue
                source = (here if here and rng.random() < 0.6 else said)[-int(rng.integers(1, 30)) :][0]
                source = source[int(rng.integers(0, len(source))) :] if rng.random() < 0.3 else source
                source = [x.lower() if rng.random() < 0.3 else x for x in source]
                marks = str(rng.choice(["> ", ">", "> > ", ">> ", " > "]))
                parts.append("\n".join(marks + x for x in source))
            rows.append((c, t, "user", str(rng.choice(["\n", "\n\n"])).join(parts)))
            said += here[-2:]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_links_equal_brute_force(spark, seed):
    rows = generated(seed, 30, 10)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Counter((r["conv_id"], r["turn"], r["level"], r["origin_conv"] is not None and (r["origin_conv"], r["origin_turn"])) for r in quotes.link_quotes(df).collect())
    want = Counter((c, t, k, o or False) for c, t, k, o in slow_links(rows))
    assert got == want
    want = list(want.elements())
    assert sum(1 for *_, o in want if o) > 150 and sum(1 for c, *_, o in want if o and o[0] != c) > 30
    # What format_chat counts and whom a message replies to.
    chat = {(r["conv_id"], r["turn"]): r for r in quotes.format_chat(df).collect()}
    assert len(chat) == len(rows)
    for c, t, _, _ in rows:
        mine = [(k, o) for a, b, k, o in want if (a, b) == (c, t)]
        r = chat[c, t]
        assert (r["n_quotes"], r["max_level"], r["n_linked"]) == (len(mine), max((k for k, _ in mine), default=0), sum(bool(o) for _, o in mine))
        assert r["parent_turn"] == max((o[1] for k, o in mine if k == 1 and o and o[0] == c), default=None)


def test_the_next_conversation_is_the_origin_where_the_least_is_the_quoting_one(spark):
    rows = [(1, 3, "a", "> said later\nx"), (1, 5, "a", "said later"), (2, 4, "a", "said later"), (2, 9, "b", "said later"), (3, 0, "a", "said later"), (4, 0, "a", "> said later")]
    got = {(r["conv_id"], r["turn"]): (r["origin_conv"], r["origin_turn"]) for r in quotes.link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 3): (2, 4), (4, 0): (1, 5)}


def test_attributions_of_any_length_go(spark):
    for head in ("On Monday" + ", and so on" * 60 + " Ann wrote:", "Ann " * 50 + "said:", "Ann wrote:"):
        assert quotes.parse(f"{head}\n> q\nmine").own_text == "mine"
    assert quotes.parse("I came. Ann said:\n> q").own_text == "I came. Ann said:"


def test_odd_rows(spark):
    rows = [(None, 0, "a", "x y"), (None, 1, "a", "> x y"), (1, None, "a", "x y"), (1, 2, None, "> x y"), (1, 3, "b", None), (1, 3, "b", None), (1, 4, "b", ""), (1, 5, "b", ">\n> \n>>"), (2, 0, "b", "> z\n" * 3000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", h string, row long")
    got = quotes.format_chat(df)
    assert got.count() == len(rows) and not got.where("n_linked > 0").count()
    assert got.columns == ["conv_id", "turn", "role", "position", "parent_turn", "n_quotes", "max_level", "n_linked", "text"]
    assert quotes.link_quotes(df.limit(0)).count() == 0
    texts = quotes.conversations(got, per_row=2).where("conv_id = 1").orderBy("part").collect()
    assert [r["n_messages"] for r in texts] == [2, 2, 2]
