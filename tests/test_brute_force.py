"""Queries that SQL does not express, against slow versions over whole tables; and parts of others against simple loops."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from oracle import connect
from pyspark.sql import functions as F

from lodestone.operators import mixing as M
from lodestone.operators.running import numbered, running_totals
from lodestone.plans import catalog
from lodestone.plans.tokens import CHUNKS, RATE

COVERED = [
    "a14_macro_scores", "a15_pooled_scores", "n5_stable_seeds", "st1_speech_segments", "st7_session_events", "t1_sentences", "t4_chunks", "t7_dialogue_plan", "v1_cut_points",
]


def rows_of(name, spark, sf_dir):
    return [tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).collect()]


# Scores


def slow_tokens(text):
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(a, b)
    out, text = "", f" {text} "
    for c in text:
        out += f" {c} " if c.isascii() and not c.isalnum() and c not in " ,-." + "'" and c.isprintable() else c
    digit = lambda c: c.isascii() and c.isdigit()
    for mark, left in ((",.", True), (",.", False), ("-", None)):
        new = ""
        for k, c in enumerate(out):
            before, after = out[k - 1 : k], out[k + 1 : k + 2]
            if left is True and c in mark and before and not digit(before):
                new += f" {c} "
            elif left is False and c in mark and after and not digit(after):
                new += f" {c} "
            elif left is None and c == "-" and digit(before):
                new += f" {c} "
            else:
                new += c
        out = new
    return out.split()


def slow_scores(pairs):
    """BLEU and chrF++ of a corpus by their definitions."""
    grams = lambda x, n: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
    matches = lambda a, b: sum(min(a.count(g), b.count(g)) for g in set(a))
    right, total, length, reference = [0] * 4, [0] * 4, 0, 0
    kinds = [[0, 0, 0] for _ in range(8)]
    for pred, ref in pairs:
        p, r = slow_tokens(pred), slow_tokens(ref)
        length, reference = length + len(p), reference + len(r)
        for n in range(4):
            a, b = grams(p, n + 1), grams(r, n + 1)
            right[n] += matches(a, b)
            total[n] += len(a)
        sides = [("".join(pred.split()), "".join(ref.split()))] * 6 + [tuple([w for x in t.split() for w in split_mark(x)] for t in (pred, ref))] * 2
        for k, (p, r) in enumerate(sides):
            n = k + 1 if k < 6 else k - 5
            a, b = Counter(grams(p, n)), Counter(grams(r, n))
            for j, v in enumerate((a.total(), b.total(), (a & b).total())):
                kinds[k][j] += v
    precision, smooth = 1.0, 1.0
    for n in range(4):
        smooth *= 1 if right[n] else 2
        precision *= (right[n] or 1 / smooth) / total[n]
    bleu = 100 * precision**0.25 * (1 if length > reference else math.exp(1 - reference / length))
    f = [5 * m / p * m / r / (4 * m / p + m / r) if m else 0.0 for p, r, m in kinds if p and r]
    return bleu, 100 * sum(f) / len(f)


def split_mark(w):
    """A word and a mark of ASCII at its end, or else at its start."""
    mark = lambda c: c.isascii() and not c.isalnum()
    if len(w) > 1 and mark(w[-1]):
        return [w[:-1], w[-1]]
    return [w[0], w[1:]] if len(w) > 1 and mark(w[0]) else [w]


def test_scores(spark, sf_dir):
    texts = connect(sf_dir).execute("SELECT conv_id, text FROM conversations WHERE role = 'assistant'").fetchall()
    by = {}
    for conv, text in texts:
        words = text.split(" ")
        by.setdefault(conv % 4, []).append((" ".join(w for k, w in enumerate(words) if k % 7 != 3), text))
    want = {d: slow_scores(p) for d, p in by.items()}
    got = {d: (n, bleu, chrf) for d, n, bleu, chrf in rows_of("a15_pooled_scores", spark, sf_dir)}
    assert got.keys() == want.keys()
    for d, (bleu, chrf) in want.items():
        assert got[d] == (len(by[d]), pytest.approx(bleu, abs=1e-5), pytest.approx(chrf, abs=1e-5))
    (macro,) = rows_of("a14_macro_scores", spark, sf_dir)
    assert macro == (len(texts), *(pytest.approx(np.mean([w[k] for w in want.values()]), abs=1e-5) for k in (0, 1)))


def test_seeds(spark, sf_dir):
    docs = connect(sf_dir).execute("SELECT doc_id, source FROM documents").fetchall()
    want = {(d, str(int.from_bytes(hashlib.blake2b(f"{s}\x1f{d}".encode(), digest_size=8).digest(), "big"))) for d, s in docs}
    assert set(rows_of("n5_stable_seeds", spark, sf_dir)) == want


# Sentences, chunks, dialogues

ALWAYS, MAYBE = "।॥。！？", ".!?…"
CLOSE = "\"'”’»)]}」』）】》〉"
SHORT = "dr mr mrs ms prof sr jr st smt etc vs e.g i.e cf viz approx डॉ प्रो".split()


def slow_boundary(left, marks, closers, right):
    """Whether ``left + marks + closers`` ends a sentence before ``right``."""
    if any(m in ALWAYS for m in marks):
        return True
    follows = right.lstrip()
    if right and right == follows:
        return False
    if closers and follows and follows[0] in "abcdefghijklmnopqrstuvwxyz":
        return False
    if "?" in marks or "!" in marks:
        return True
    if marks != "." or follows.startswith("."):
        return False
    bare = left.rstrip()
    if bare != left and bare.endswith("."):
        return False
    if left and left[-1] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and (len(left) == 1 or left[-2].isspace() or left[-2] in ".\"'“‘«([{—–-"):
        return False
    word = re.search(r"\S*\Z", left)[0]
    letters = lambda x: bool(x) and all(c.isascii() and c.isalpha() or "\u0900" <= c <= "\u0963" or "\u0970" <= c <= "\u097f" for c in x)
    parts, tail = word.split("."), []
    for k, part in enumerate(reversed(parts)):
        own = part if letters(part) else next((part[i:] for i in range(len(part)) if letters(part[i:])), "")
        if not own:
            break
        tail.insert(0, own)
        if own != part or k == len(parts) - 1:
            break
    name = ".".join(tail).lower()
    number = bool(follows) and (follows[0] in "0123456789" or "\u0966" <= follows[0] <= "\u096f")
    return not (name in SHORT or (name in ("no", "rs") and number))


def slow_sentences(text):
    out = []
    for paragraph in re.split(r"\n\s*\n", (text or "").replace("\r\n", "\n").replace("\u200b", " ")):
        start = k = 0
        while k < len(paragraph):
            if paragraph[k] not in ALWAYS + MAYBE:
                k += 1
                continue
            j = k
            while j < len(paragraph) and paragraph[j] in ALWAYS + MAYBE:
                j += 1
            e = j
            while e < len(paragraph) and paragraph[e] in CLOSE:
                e += 1
            if slow_boundary(paragraph[:k], paragraph[k:j], paragraph[j:e], paragraph[e:]):
                out.append(paragraph[start:e].strip())
                start = e
            k = e
        out.append(paragraph[start:].strip())
    return [s for s in out if s]


def slow_fit(text, most):
    """Pieces of a text by the best place of three kinds to cut at."""
    out = []
    while len(text) > most:
        window = range(1, most + 1)
        clause = [k for k in window if k >= max(1, most // 4) and (text[k - 1] in "，；：、" or (text[k - 1] in ",;:" and text[k].isspace()))]
        places = clause or [k for k in window if text[k] == "\n"] or [k for k in window if text[k].isspace()] or [most]
        k = places[-1]
        out.append(text[:k].rstrip())
        text = text[k:].lstrip()
    return [x for x in [*out, text] if x]


def slow_join(parts, most, first=None):
    out = []
    for p in parts:
        limit = first if first and len(out) == 1 else most
        if out and len(out[-1]) + 1 + len(p) <= limit:
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(p)
    return out


def test_sentences_and_chunks(spark, sf_dir):
    docs = connect(sf_dir).execute("SELECT doc_id, text FROM documents").fetchall()
    want = {(d, k, s) for d, t in docs for k, s in enumerate(slow_sentences(t))}
    assert set(rows_of("t1_sentences", spark, sf_dir)) == want
    want = set()
    for d, t in docs:
        t = (t or "").strip()
        parts = [p for s in (slow_sentences(t) or [t]) for p in slow_fit(s, 300)]
        head = slow_fit(parts[0], 120) if parts else []
        if len(head) > 1:  # the first part is cut, so the first chunk is its start alone
            chunks = [head[0], *slow_join(head[1:] + parts[1:], 300)]
        else:
            n = 1
            while n < len(parts) and len(" ".join(parts[: n + 1])) <= 120:
                n += 1
            chunks = [" ".join(parts[:n]), *slow_join(parts[n:], 300)] if parts else []
        want |= {(d, k, c) for k, c in enumerate(chunks)}
    assert set(rows_of("t4_chunks", spark, sf_dir)) == want


def test_sentences_of_odd_texts():
    from lodestone.functions import segmentation as G

    rng = np.random.default_rng(0)
    parts = ["Dr", ".", "A", "b", "word", " ", " ", "\n", "?", "!", "…", "।", "”", '"', "'", "(", ")", "No", ". ", "5", "५", "e.g", "डॉ", "。", ",", "\n\n", "\u200b", "。」", "...", "-", "U.S.A"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        assert G.sentences(text) == slow_sentences(text), text
        if len(text) > 12:
            assert list(G.fitting([text.strip()], 12)) == slow_fit(text.strip(), 12), text


def test_long_texts_are_cut_in_linear_time():
    import time

    from lodestone.functions import segmentation as G

    began = time.perf_counter()
    assert sum(map(len, G.chunks("x" * 2_000_000, 300))) == 2_000_000
    assert len(G.sentences("a.b. " * 200_000)) == 200_000
    assert len(G.sentences("A. " * 200_000)) == 1
    assert time.perf_counter() - began < 30


def test_dialogue_plan(spark, sf_dir):
    turns = connect(sf_dir).execute("SELECT conv_id, role, text FROM conversations ORDER BY conv_id, turn").fetchall()
    by = {}
    for c, role, text in turns:
        by.setdefault(c, []).append((role.strip(), (text or "").strip()))
    want = set()
    for c, said in by.items():
        pieces, ends, seen = [], set(), 0
        for role, text in said:
            room = 300 - 21 - len(role)
            if text:
                whole = [p for s in (slow_sentences(text) or [text]) for p in slow_fit(s, room)]
                pieces += [(role, p) for p in ([text] if len(text) <= room else slow_join(whole, room))]
            seen += len("".join(text.split()))
            ends.add(seen)
        chunks = []
        for piece in pieces:
            cost = lambda ch: sum(21 + len(r) + len(t) for r, t in ch) + 2 * (len(ch) - 1)
            if chunks and cost([*chunks[-1], piece]) <= (200 if len(chunks) == 1 else 300):
                chunks[-1].append(piece)
            else:
                chunks.append([piece])
        seen = 0
        for k, ch in enumerate(chunks):
            seen += sum(len("".join(t.split())) for _, t in ch)
            last = ch[-1][1].rstrip()[-1:]
            kind = "sentence" if last in ".!?…।॥。！？" + CLOSE else "clause" if last in ",;:，；：、" else "hard"
            speakers = ",".join(dict.fromkeys(r for r, _ in ch))
            want.add((c, k, cost(ch), sum(len(t) for _, t in ch), len(ch), seen in ends, speakers, kind))
    assert set(rows_of("t7_dialogue_plan", spark, sf_dir)) == want


# Recordings


def recordings(sf_dir):
    out = {}
    for (e,) in connect(sf_dir).execute("SELECT event_id FROM events ORDER BY event_id").fetchall():
        loud = 0.501 if e % 23 < 15 else 0.001
        out.setdefault(e // CHUNKS, []).append(np.array([loud * (1 if i % 4 < 2 else -1) * (1 + i % 3) for i in range(200)]))
    return {k: np.concatenate(v) for k, v in out.items()}


def level(x, start):
    """Decibels of 25 ms from a place on."""
    return 10 * math.log10(max(float(np.mean(x[start : start + 25] ** 2)), 1e-12))


def quiet_runs(flags, least):
    out, k = [], 0
    while k < len(flags):
        j = k
        while j < len(flags) and flags[j] == flags[k]:
            j += 1
        if flags[k] and j - k >= least:
            out.append((k, j))
        k = j
    return out


def threshold(levels):
    return min(float(np.percentile(levels, 10)) + 8, max(levels) - 20)


def slow_segments(x, said):
    """Segments of a recording, looked at every 0.1 s; frames are 25 ms every 10 ms."""
    db = [level(x, k) for k in range(0, len(x) - 24, 10)]
    out, start, waiting, told = [], 0, True, 0  # start and told in frames

    def text(a, b):
        levels = [level(x[a:b], k) for k in range(0, max(1, b - a - 24), 10)]
        return said(x[a:b]) if max(levels) >= -50 else ""

    for now in range(100, len(x) // 100 * 100 + 100, 100):
        now = min(now, len(x))
        frames = max(0, (now - 25) // 10 + 1)
        mine = db[start:frames]
        known = db[max(0, start - 2000) : frames]
        quiet = [v < threshold(known) for v in mine] if len(known) >= 100 and mine else None
        if waiting and quiet is not None:
            heard = [k for k, q in enumerate(quiet) if not q]
            start, told = start + (heard[0] if heard else len(mine)), 0
            waiting = not heard
            if waiting:
                continue
            mine, quiet = db[start:frames], quiet[heard[0] :]
        n, long = len(mine), now // 10 - start
        cut = None
        if long >= 500:
            pauses = [p for p in quiet_runs(quiet, 20) if p[0] >= 60] if quiet else []
            cut = pauses[-1] if pauses else (long, long)
        elif quiet and not all(quiet):
            spoken = max(k for k, q in enumerate(quiet) if not q) + 1
            if n - spoken >= 50 and spoken >= 60:
                cut = spoken, n
        if cut:
            a, b = start * 10, (start + cut[0]) * 10
            out.append(("final", a / RATE, b / RATE, text(a, b)))
            start, waiting, told = start + cut[1], True, 0
        elif long - told >= 200 and long >= 60:
            told = long
            out.append(("partial", start * 10 / RATE, now / RATE, text(start * 10, now)))
    if len(x) - start * 10 >= 600:
        out.append(("final", start * 10 / RATE, len(x) / RATE, text(start * 10, len(x))))
    return out


def test_speech_segments(spark, sf_dir):
    said = lambda x: f"{len(x)} samples"
    want = {s: slow_segments(x, said) for s, x in recordings(sf_dir).items()}
    rows = Counter((s, kind, round(a, 6), round(b, 6), text) for s, out in want.items() for kind, a, b, text in out)
    got = Counter((s, kind, round(a, 6), round(b, 6), text) for s, kind, a, b, text in rows_of("st1_speech_segments", spark, sf_dir))
    assert got == rows and len(rows) > 50
    events = rows_of("st7_session_events", spark, sf_dir)
    ends = {s: text for s, kind, _, _, text in events if kind == "end"}
    finals = {s: " ".join(t for kind, _, _, t in slow_segments(np.trunc(np.clip(x / 4, -1, 1) * 32767) / 32768, said) if kind == "final" and t) for s, x in recordings(sf_dir).items()}
    assert ends == finals
    assert {kind for _, kind, *_ in events} == {"update:final", "update:partial", "end"}


def slow_cuts(x):
    """[start, end) of chunks of at most 15 s, cut at pauses of 0.2 s."""
    db = [level(np.pad(x, (0, 25)), k) if k + 25 > len(x) else level(x, k) for k in range(0, max(1, len(x) - 24), 10)]
    pauses = [(a + b) // 2 * 10 for a, b in quiet_runs([v < threshold(db) for v in db], 20)]
    out, at = [], 0
    while len(x) - at > 15 * RATE:
        late = [p for p in pauses if at + 10 * RATE <= p <= at + 15 * RATE]
        some = [p for p in pauses if at + RATE // 2 < p <= at + 15 * RATE]
        end = (late or some or [at + 15 * RATE])[-1]
        out.append((at, end))
        at = end
    if out and len(x) - at < 2 * RATE:
        at = out.pop()[0]
    return [*out, (at, len(x))]


def test_cut_points(spark, sf_dir):
    want = {(s, k, a / RATE, b / RATE) for s, x in recordings(sf_dir).items() for k, (a, b) in enumerate(slow_cuts(x))}
    assert set(rows_of("v1_cut_points", spark, sf_dir)) == want


# Packing and running sums


def test_first_fit_finds_the_lowest_bin():
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 60, 600).tolist()
    rooms, want = [], []
    for n in lengths:
        b = next((k for k, r in enumerate(rooms) if r >= n), None) if n <= 50 else None
        if b is None:
            b = len(rooms)
            rooms.append(50 if n <= 50 else n)
        rooms[b] -= n
        want.append(b)
    assert M.bins_of(lengths, 50, M.FirstFit()) == want


def test_affinity_prefers_the_dataset_that_lacks_most():
    rng = np.random.default_rng(2)
    lengths, names = sorted(rng.integers(1, 30, 800).tolist(), reverse=True), rng.choice(["a", "b", "c"], 800).tolist()
    expected = {"a": 500, "b": 200, "c": 100}
    rooms, held, lead, seen, want = [], [], [], Counter(), []
    for n, d in zip(lengths, names, strict=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            equal = [k for k, r in enumerate(rooms) if r == min(fits)]
            b = max(equal, key=lambda k: (expected[lead[k]] - seen[lead[k]], -k))
        else:
            b = len(rooms)
            rooms.append(28)
            held.append(Counter())
            lead.append(d)
            if n > 28:
                rooms[b] = n
        held[b][d] += 1
        if held[b][d] > held[b][lead[b]] or (held[b][d] == held[b][lead[b]] and d < lead[b]):
            lead[b] = d
        seen[d] += 1
        rooms[b] -= n
        if rooms[b] == 0 or n > 28:
            rooms[b] = -1
        want.append(b)
    assert M.affinity_bins(lengths, names, expected, 28) == want


def test_running_sums_of_a_hot_key(spark, tmp_path):
    rows = [("hot" if i % 3 else (None if i % 2 else f"k{i % 7}"), (i * 7919) % 5000, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "key string, place long, value long").repartition(7)
    got = {r["place"]: (r["total"], r["n"]) for r in running_totals(df, ["key"], [F.desc("place")], {"total": F.col("value"), "n": F.lit(1)}, f"file://{tmp_path}/a").collect()}
    want, sums = {}, {}
    for key, place, value in sorted(rows, key=lambda r: -r[1]):
        t, n = sums.get(key, (0, 0))
        sums[key] = want[place] = t + value, n + 1
    assert got == want
    assert sorted(r["k"] for r in numbered(df, [], ["place"], f"file://{tmp_path}/b").collect()) == list(range(5000))


def test_slots(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 10)], "x string, n long")
    got = sorted((r["x"], r["at"]) for r in M.slots(df, "n", "at", chunk=4).collect())
    assert got == [("a", k) for k in range(3)] + [("c", k) for k in range(10)]
