"""Chat formatting by quotation linking.

A message's lines are parsed into its own text and nested quotes: the level is
the number of leading ``>``. Passages are runs of lines of one level between
blank lines, the whole of a run and the whole own text; they are normalised
(ASCII lower case, single blanks) and hashed. A quoted passage is joined to its
original, the earliest message that has it as its own text: in the same
conversation, if earlier there, else in the other conversation of least conv_id
that has it. A passage without one, such
as a quote trimmed to some lines, is joined by its lines: it is linked if each
of them has an original, to the latest of these if all are earlier in the same
conversation, else to the one of least conv_id and turn. ``link_quotes`` returns
a row for each quoted passage with its original. A message replies to the latest message of its
conversation that its first-level quotes name. Messages without such a link are
the trunk; each other one belongs to the trunk message that its links lead to.
Conversations are returned reply-ordered and without quotes: trunk messages by
turn, each followed by its replies by turn.

Originals are pre-aggregated to one row a passage, so a passage that very many
messages hold or quote joins once for each quote. Positions are counted within
ranges of the sorted table and added up, so a conversation of any length is
spread over tasks.

Defined results: a null text counts as empty; a null role is ``unknown``; rows
that share conv_id and turn are kept and ordered by role and text; an empty table
gives an empty table; further columns are ignored. A null conv_id is a conversation
of its own, without links; a null turn comes first and is no original.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written

_QUOTED = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.DOTALL)
#: "On <date>, <name> wrote:", or a name without a sentence's end in it that wrote or said.
_ATTRIBUTION = re.compile(r"[ \t]*(?:On\b.*\bwrote|(?:(?![.!?;:][ \t]).)+ (?:wrote|said)):[ \t]*$")

#: Messages that one row of ``conversations`` holds at most.
MESSAGES_PER_ROW = 1000

_PARSED = (
    "row long, conv_id long, turn long, role string, text string, own array<string>, lines array<string>, "
    "quotes array<struct<level: int, h: string, lines: array<string>>>"
)


def normalised(lines: list[str]) -> bytes:
    return b" ".join(" ".join(lines).encode().lower().split())


def passage_hash(lines: list[str]) -> str | None:
    data = normalised(lines)
    return hashlib.sha256(data).hexdigest()[:32] if data else None


def levels(text: str) -> list[tuple[int, str]]:
    """(level, line without its quote marks) of each line."""
    out = []
    for line in text.split("\n"):
        m = _QUOTED.fullmatch(line)
        out.append((m[1].count(">"), m[2]) if m else (0, line))
    return out


def runs(lines: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Lines joined to runs of one level."""
    out: list[tuple[int, list[str]]] = []
    for level, line in lines:
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return out


def passages(lines: list[str]) -> list[list[str]]:
    """The whole of some lines, and its parts between blank lines if there are several."""
    parts: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            parts[-1].append(line)
        elif parts[-1]:
            parts.append([])
    parts = [p for p in parts if p]
    return [lines, *parts] if len(parts) > 1 else [lines] if parts else []


def line_hashes(lines: list[str]) -> list[str]:
    return list(dict.fromkeys(h for line in lines if (h := passage_hash([line]))))


class Message(NamedTuple):
    own_text: str  # without quotes and their attributions, a blank line for each quote between
    own: list[str]  # hashes of its passages
    lines: list[str]  # hashes of its lines that are no passages
    quotes: dict[tuple[int, str], list[str]]  # (level, hash) of quoted passages, with hashes of their lines


def parse(text: str) -> Message:
    found = runs(levels(text))
    own: list[list[str]] = []
    quotes: dict[tuple[int, str], list[str]] = {}
    for k, (level, lines) in enumerate(found):
        if level:
            for p in passages(lines):
                if h := passage_hash(p):
                    quotes.setdefault((level, h), line_hashes(p))
            continue
        quoted_next = k + 1 < len(found)
        while quoted_next and lines and not lines[-1].strip():
            lines = lines[:-1]
        if quoted_next and lines and _ATTRIBUTION.match(lines[-1]):
            lines = lines[:-1]
        if any(map(str.strip, lines)):
            own.append(lines)
    own_text = "\n\n".join("\n".join(lines).strip("\n") for lines in own)
    glued = [line for lines in own for line in lines]
    wholes = own if len(own) < 2 else [glued, *own]
    hashes = list(dict.fromkeys(h for w in wholes for p in passages(w) if (h := passage_hash(p))))
    known = set(hashes)
    return Message(own_text, hashes, [h for h in line_hashes(glued) if h not in known], quotes)


def _parse_all(messages: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        strings = pa.list_(pa.string())
        kind = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.string()), ("lines", strings)]))
        for b in batches:
            found = [parse(t or "") for t in b.column(3).to_pylist()]
            rows = pa.array(range(row, row + len(found)), pa.int64())
            row += len(found)
            quotes = [[{"level": k, "h": h, "lines": x} for (k, h), x in m.quotes.items()] for m in found]
            columns = [
                rows, *b.columns[:3], pa.array([m.own_text for m in found], pa.string()),
                pa.array([m.own for m in found], strings), pa.array([m.lines for m in found], strings), pa.array(quotes, kind),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "conv_id", "turn", "role", "text", "own", "lines", "quotes"])

    picked = messages.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("unknown")).alias("role"), "text"
    )
    return written(picked.mapInArrow(run, _PARSED), "messages")


def _with_originals(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """``quotes`` (conv_id, turn, h and more) with ``here``, and ``origin`` (conv_id, turn) or null.

    here is the first turn of h in the same conversation, if earlier; origin is
    that, or h's first turn in the other conversation of least conv_id.
    """
    originals = originals.where("conv_id IS NOT NULL AND turn IS NOT NULL").join(quotes.select("h").distinct(), "h", "left_semi")
    first = written(originals.groupBy("conv_id", "h").agg(F.min("turn").alias("first")), "originals")
    place = F.struct(F.col("conv_id"), F.col("first").alias("turn"))
    least = first.groupBy("h").agg(F.min(place).alias("least"))
    joined = quotes.join(first.withColumnRenamed("first", "here"), ["conv_id", "h"], "left").join(least, "h", "left")
    joined = written(joined.withColumn("here", F.when(F.col("here") < F.col("turn"), F.col("here"))), "joined")
    # Where the least conversation is the quoting one and does not say it before: the next one.
    own = F.col("here").isNull() & (F.col("least.conv_id") == F.col("conv_id"))
    asked = joined.where(own).groupBy("h").agg(F.min("least.conv_id").alias("but"))
    second = first.join(asked, "h").where(F.col("conv_id") != F.col("but")).groupBy("h").agg(F.min(place).alias("second"))
    joined = joined.join(second, "h", "left")
    far = F.when(F.col("least.conv_id") != F.col("conv_id"), F.col("least")).otherwise(F.col("second"))
    near = F.struct(F.col("conv_id"), F.col("here").alias("turn"))
    return joined.withColumn("origin", F.when(F.col("here").isNotNull(), near).otherwise(far)).drop("least", "second")


def _links(parsed: DataFrame) -> DataFrame:
    """A row for each quoted passage: row, conv_id, turn, place, level, here, origin."""
    quotes = parsed.select("row", "conv_id", "turn", F.posexplode("quotes").alias("place", "q")).select("row", "conv_id", "turn", "place", "q.*")
    whole = _with_originals(quotes, parsed.select("conv_id", "turn", F.explode("own").alias("h")))
    whole = written(whole.withColumn("lines", F.when(F.col("origin").isNull(), F.col("lines"))).drop("h"), "whole")
    lines = whole.where("origin IS NULL").select("row", "conv_id", "turn", "place", "level", F.explode("lines").alias("h"))
    by_line = _with_originals(lines, parsed.select("conv_id", "turn", F.explode(F.concat("own", "lines")).alias("h")))
    here = F.when(F.every(F.col("here").isNotNull()), F.max("here"))
    trimmed = by_line.groupBy("row", "place").agg(
        F.first("conv_id").alias("conv_id"),
        F.first("turn").alias("turn"),
        F.first("level").alias("level"),
        here.alias("here"),
        F.when(F.every(F.col("origin").isNotNull()), F.min("origin")).alias("least"),
    )
    near = F.struct(F.col("conv_id"), F.col("here").alias("turn"))
    trimmed = trimmed.withColumn("origin", F.when(F.col("here").isNotNull(), near).otherwise(F.col("least")))
    columns = ("row", "conv_id", "turn", "place", "level", "here", "origin")
    return whole.where("origin IS NOT NULL").select(*columns).unionByName(trimmed.select(*columns))


def link_quotes(messages: DataFrame) -> DataFrame:
    """A row for each quoted passage of ``messages``: conv_id, turn, place (in the message), level, origin_conv, origin_turn.

    The last two are null for a passage without an original.
    """
    links = _links(_parse_all(messages))
    return links.select(
        "conv_id", "turn", "place", "level", F.col("origin.conv_id").alias("origin_conv"), F.col("origin.turn").alias("origin_turn")
    )


def _by_message(links: DataFrame) -> DataFrame:
    """(row, conv_id, turn, n_quotes, max_level, n_linked, parent_turn) of messages that quote."""
    return links.groupBy("row").agg(
        F.first("conv_id").alias("conv_id"),
        F.first("turn").alias("turn"),
        F.count(F.lit(1)).alias("n_quotes"),
        F.max("level").alias("max_level"),
        F.count("origin").alias("n_linked"),
        F.max(F.when(F.col("level") == 1, F.col("here"))).alias("parent_turn"),
    )


def _roots(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(conv_id, turn, root): the trunk message that each reply leads to, by pointer jumping."""
    up = links.where("parent_turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("root"))
    up = written(up, "roots")
    for _ in range(most_rounds):
        above = up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"))
        step = written(up.join(above, ["conv_id", "root"], "left"), "roots")
        moved = step.where("higher IS NOT NULL").limit(1).count()
        up = step.select("conv_id", "turn", F.coalesce("higher", "root").alias("root"))
        if not moved:
            return up
    raise RuntimeError("replies do not lead to a trunk")


def _positions(messages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``position`` from 0 within ``key`` by ``order``, however long a key's rows are."""
    spread = messages.repartitionByRange(key, *order).withColumn("range", F.spark_partition_id())
    spread = written(spread, "ordered")
    sizes = spread.groupBy(key, "range").count()
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col(key).alias("__key"), F.col("range").alias("__range"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")
    )
    inside = F.row_number().over(Window.partitionBy(key, "range").orderBy(*order)) - 1
    out = spread.withColumn("inside", inside).join(sizes, F.col(key).eqNullSafe(F.col("__key")) & (F.col("range") == F.col("__range")))
    return out.withColumn("position", F.col("base") + F.col("inside")).drop("range", "inside", "base", "__key", "__range")


def format_chat(messages: DataFrame) -> DataFrame:
    """A row for each message of ``messages`` (conv_id, turn, role, text), without its quotes.

    position: in its conversation's reply order; parent_turn: what it replies to;
    n_quotes, max_level, n_linked: its quoted passages, how deep, how many with a
    known original; text: the message in chat form.
    """
    parsed = _parse_all(messages)
    links = written(_by_message(_links(parsed)), "links")
    roots = _roots(links)
    of_row = links.select("row", "n_quotes", "max_level", "n_linked", "parent_turn")
    out = parsed.drop("own", "lines", "quotes").join(of_row, "row", "left").join(roots, ["conv_id", "turn"], "left")
    out = out.withColumn("root", F.coalesce("root", "turn"))
    out = _positions(out, "conv_id", ["root", "turn", "role", "text", "row"])
    chat = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    none = F.lit(0)
    return out.select(
        "conv_id", "turn", "role", F.col("position").cast("long"), "parent_turn",
        F.coalesce("n_quotes", none).cast("long").alias("n_quotes"), F.coalesce("max_level", none).cast("long").alias("max_level"),
        F.coalesce("n_linked", none).cast("long").alias("n_linked"), chat.alias("text"),
    )


def conversations(formatted: DataFrame, per_row: int = MESSAGES_PER_ROW) -> DataFrame:
    """(conv_id, part, n_messages, text): the conversations of ``format_chat``'s rows as texts of at most ``per_row`` messages each."""
    part = F.floor(F.col("position") / per_row).alias("part")
    items = F.array_sort(F.collect_list(F.struct("position", "text")))
    return formatted.groupBy("conv_id", part).agg(
        F.count(F.lit(1)).alias("n_messages"), F.array_join(F.transform(items, lambda x: x["text"]), "").alias("text")
    )
