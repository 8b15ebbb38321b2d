"""Array, map and token expressions, all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of a codebook, tokens of a frame (fixed values), and the codebooks' places in a frame.
CODES, FRAME = 4096, 7


def let(value: Column, body) -> Column:
    """``body(value)`` where ``value`` is evaluated once."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column | int, start: int = 0) -> Column:
    """start..n-1, empty if there are none."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > start, F.sequence(F.lit(start), n - 1)).otherwise(F.array().cast("array<int>"))


def interleave(c0: Column, c1: Column, c2: Column, base: int = 0) -> Column:
    """Tokens of three codebooks (n, 2n and 4n codes): seven a frame, each slot with its own range of ids."""
    slot = lambda c, i, k: F.get(c, i) + (base + k * CODES)
    frame = lambda i: F.array(
        slot(c0, i, 0), slot(c1, 2 * i, 1), slot(c2, 4 * i, 2), slot(c2, 4 * i + 1, 3),
        slot(c1, 2 * i + 1, 4), slot(c2, 4 * i + 2, 5), slot(c2, 4 * i + 3, 6),
    )
    return F.flatten(F.transform(upto(F.size(c0)), frame))


def frames(tokens: Column, width: int = FRAME) -> Column:
    """Whole frames of a token array; what is left over is cut off."""
    return F.transform(upto(F.floor(F.size(tokens) / width).cast("int")), lambda i: F.slice(tokens, i * width + 1, width))


def codes(tokens: Column, base: int = 0) -> Column:
    """Codes without their slots' offsets. Null if an id is out of range; frames with a wrong code are left out."""
    inside = F.forall(tokens, lambda t: (t >= base) & (t < base + FRAME * CODES))
    plain = F.transform(frames(tokens), lambda f: F.transform(f, lambda t, k: t - base - k * CODES))
    valid = F.filter(plain, lambda f: F.forall(f, lambda c: (c >= 0) & (c < CODES)))
    return F.when(inside, F.flatten(valid))


def clamped_codes(tokens: Column, base: int = 0) -> Column:
    """Codes without offsets, clipped into range rather than left out."""
    clip = lambda t, k: F.greatest(F.lit(0), F.least(F.lit(CODES - 1), t - base - k * CODES))
    return F.flatten(F.transform(frames(tokens), lambda f: F.transform(f, clip)))


def without_repeats(tokens: Column) -> Column:
    """Frames whose first token is that of the frame before are left out."""
    f = frames(tokens)
    kept = lambda fs: F.filter(fs, lambda x, i: (i == 0) | (x[0] != F.get(F.get(fs, F.greatest(i - 1, F.lit(0))), F.lit(0))))
    return F.flatten(let(f, kept))


def windows(items: Column, width: int, before: int = 1, pad: Column | None = None) -> Column:
    """For each item k the window [k - before, k - before + width), padded beyond the ends."""
    pad = F.lit(0) if pad is None else pad
    at = lambda k: F.transform(
        F.sequence(k - before, k - before + width - 1), lambda j: F.when((j >= 0) & (j < F.size(items)), F.get(items, F.greatest(j, F.lit(0)))).otherwise(pad)
    )
    return F.transform(upto(F.size(items)), at)


def between_markers(tokens: Column, start: int, end: int) -> Column:
    """Tokens after the last start marker, up to the first end marker after it; none without a start."""
    after = F.when(
        F.array_contains(tokens, start), F.slice(tokens, F.size(tokens) - F.array_position(F.reverse(tokens), start).cast("int") + 2, F.size(tokens))
    ).otherwise(F.array().cast("array<int>"))
    stop = lambda a: F.array_position(a, end).cast("int")
    return let(after, lambda a: F.when(stop(a) > 0, F.slice(a, F.lit(1), stop(a) - 1)).otherwise(a))


def without_prompt(ids: Column, prompt: Column, trailing: list[int]) -> Column:
    """Ids after a prompt, which they must start with, less trailing pad and end ids."""
    head = F.slice(ids, F.lit(1), F.size(prompt))
    rest = F.slice(ids, F.size(prompt) + 1, F.size(ids))
    bad = F.array(*map(F.lit, trailing))
    last = lambda r: F.coalesce(F.array_max(F.filter(F.transform(r, lambda x, i: F.when(~F.array_contains(bad, x), i + 1)), lambda i: i.isNotNull())), F.lit(0))
    trimmed = let(rest, lambda r: F.slice(r, F.lit(1), last(r)))
    return F.when(head == prompt, trimmed).otherwise(F.raise_error(F.lit("the ids do not start with the prompt")))


def best_of(scores: Column, candidates: list[str] | None = None) -> Column:
    """(key, score) of the highest score among candidates, of equals the first in the map; (null, 0) of none."""
    entries = F.map_entries(scores)
    if candidates is not None:
        entries = F.filter(entries, lambda e: e["key"].isin(*candidates))
    ranked = F.transform(entries, lambda e, i: F.struct((-e["value"]).alias("s"), i.alias("i"), e["key"].alias("key"), e["value"].alias("score")))
    first = F.array_min(ranked)
    return F.struct(first["key"].alias("key"), F.coalesce(first["score"], F.lit(0.0)).alias("score"))


def top_scores(scores: Column, k: int, always: list[str]) -> Column:
    """The k highest entries of a map, and those of ``always``; of equal scores the lower key."""
    ranked = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("key"))))
    kept = F.transform(F.slice(ranked, 1, k), lambda e: e["key"])
    return F.map_filter(scores, lambda key, _: F.array_contains(kept, key) | key.isin(*always))


def probe_indices(n: Column, k: int) -> Column:
    """k places spread evenly over 0..n-1."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.least(n - 1, F.floor(n / (k + 1) * i).cast("int"))))


def collated(sequences: Column, labels: Column, width: int, pad: int = 0) -> Column:
    """Sequences and their labels in one row: ids, labels, positions that restart, mask, and the share that is used."""
    ids = F.slice(F.flatten(sequences), 1, width)
    positions = F.slice(F.flatten(F.transform(sequences, lambda s: upto(F.size(s)))), 1, width)
    padded = lambda a, value: F.concat(a, F.array_repeat(F.lit(value), width - F.size(a)))
    return F.struct(
        padded(ids, pad).alias("input_ids"),
        padded(F.slice(F.flatten(labels), 1, width), -100).alias("labels"),
        padded(positions, 0).alias("position_ids"),
        padded(F.transform(ids, lambda _: F.lit(1)), 0).alias("attention_mask"),
        (F.size(ids) / width).alias("efficiency"),
    )


def training_sequence(text: Column, audio: Column, marks: dict[str, list[int]], prefix: Column | None = None) -> Column:
    """(input_ids, prompt_end): human turn with the text's ids, then the reply with the audio's.

    ``marks``: ids of human, bos, eot, end_human, ai, speech, end_speech and end_ai. ``prefix`` holds the ids of
    a speaker's description; a conversation has none, as its text names its speakers.
    """
    of = lambda *names: F.array(*(F.lit(x) for n in names for x in marks[n])).cast("array<int>")
    head = [of("human", "bos"), *([prefix] if prefix is not None else []), text, of("eot", "end_human", "ai")]
    prompt = F.concat(*head)
    return F.struct(F.concat(prompt, of("speech"), audio, of("end_speech", "end_ai")).alias("input_ids"), F.size(prompt).alias("prompt_end"))


def slots(filled: dict[int, Column], width: int, pad: int = 0) -> Column:
    """Exactly ``width`` ids: those filled by place, the others ``pad``."""
    if not all(0 <= k < width for k in filled):
        raise ValueError("a place lies outside the row")
    return F.array(*(filled.get(k, F.lit(pad)) for k in range(width)))


def resampled_length(samples: Column, rate: int, to: int) -> Column:
    """Samples at another rate, half up."""
    doubled = samples.cast("long") * (2 * to) + rate
    return ((doubled - F.pmod(doubled, F.lit(2 * rate))) / (2 * rate)).cast("long")


def valid_frames(samples: Column, hop: int = 512, group: int = 4) -> Column:
    """Frames that hold samples: hops rounded up, and frames of ``group`` hops rounded up."""
    return F.ceil(F.ceil(samples / hop) / group).cast("int")


def centre_padded(samples: Column, least: int) -> Column:
    """At least so many samples, zeros on both sides; the left gets half, to even."""
    short = F.greatest(F.lit(0), least - F.size(samples))
    left = F.bround(short / 2).cast("int")
    return F.concat(F.array_repeat(F.lit(0.0), left), samples, F.array_repeat(F.lit(0.0), short - left))


def real_time_factor(seconds: Column, audio_seconds: Column) -> Column:
    return F.when(audio_seconds > 0, seconds / audio_seconds).otherwise(0.0)


def interpolated(low: Column, high: Column, part: Column) -> Column:
    """``part`` of the way between two doubles, as DuckDB's quantile_cont: a fused multiply-add, where F.percentile rounds both products."""
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double")
    return F.when(part == 0, low).when((low + high + part).isNotNull(), fused)
