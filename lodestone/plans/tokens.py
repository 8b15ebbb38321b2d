"""Queries over token arrays, waveforms and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.functions import signal as G
from lodestone.operators import routing as Q
from lodestone.operators.runs import per_group
from lodestone.plans.registry import query, table
from lodestone.streaming.sessions import Endpoints, FrameWindows, InOrder, Loudness, MicroBatches, Session
from lodestone.streaming.stateful import replay

_CODE = "CAST((l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 4096 AS INTEGER)"
_ROWS = f"""c AS (SELECT l_orderkey AS id, list({_CODE} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS c FROM lineitem GROUP BY 1)"""


def code_arrays(spark, d):
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.expr(_CODE).alias("code"))
    out = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return out.select("id", F.transform("r", lambda x: x["code"]).alias("c"))


@query(f"""WITH {_ROWS}, n AS (SELECT id, c, list_concat(c, c) AS c1, list_concat(list_concat(c, c), list_concat(c, c)) AS c2 FROM c)
 SELECT id, flatten(list_transform(range(len(c)), lambda i: [c[i + 1], c1[2 * i + 1] + 4096, c2[4 * i + 1] + 8192, c2[4 * i + 2] + 12288, c1[2 * i + 2] + 16384, c2[4 * i + 3] + 20480, c2[4 * i + 4] + 24576])) AS tokens FROM n""")
def f4_interleaved_tokens(spark, d):
    c = F.col("c")
    return code_arrays(spark, d).select("id", A.interleave(c, F.concat(c, c), F.concat(c, c, c, c)).alias("tokens"))


@query(f"WITH {_ROWS} SELECT id, flatten(list_transform(range(len(c)), lambda i: [c[i + 1], c[i + 1], c[i + 1], c[i + 1], c[i + 1], c[i + 1], c[i + 1]])) AS codes FROM c")
def f5_codes(spark, d):
    tokens = F.flatten(F.transform("c", lambda x: F.array(*(x + k * A.CODES for k in range(7)))))
    return code_arrays(spark, d).select("id", A.codes(F.concat(tokens, F.array(F.lit(5)))).alias("codes"))


@query(f"WITH {_ROWS} SELECT id, list_transform(c[1:(len(c) // 7) * 7], lambda x, i: greatest(0, least(4095, x - ((i - 1) % 7) * 4096))) AS codes FROM c")
def f6_clamped_codes(spark, d):
    return code_arrays(spark, d).select("id", A.clamped_codes(F.col("c")).alias("codes"))


@query("SELECT o_orderkey AS id, CAST(ceil(ceil(o_custkey * 37 / 512.0) / 4) AS INTEGER) AS frames FROM orders")
def f7_valid_frames(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), A.valid_frames(F.col("o_custkey") * 37).alias("frames"))


@query(f"""WITH {_ROWS}, f AS (SELECT id, list_transform(c, lambda x: x % 3) AS k FROM c)
 SELECT id, list_filter(k, lambda x, i: i = 1 OR x <> k[i - 1]) AS kept FROM f""")
def w9_without_repeated_frames(spark, d):
    frames = F.flatten(F.transform("c", lambda x: F.array(x % 3, *(F.lit(0) for _ in range(6)))))
    out = code_arrays(spark, d).select("id", A.without_repeats(frames).alias("t"))
    return out.select("id", F.filter("t", lambda _, i: i % 7 == 0).alias("kept"))


@query(f"WITH {_ROWS} SELECT id, list_transform(range(len(c)), lambda k: list_transform(range(k - 1, k + 3), lambda j: CASE WHEN j >= 0 AND j < len(c) THEN c[j + 1] ELSE 0 END)) AS windows FROM c")
def w11_sliding_windows(spark, d):
    return code_arrays(spark, d).select("id", A.windows(F.col("c"), 4).alias("windows"))


@query(f"WITH {_ROWS} SELECT id, c AS inner_ids FROM c")
def pf21_between_markers(spark, d):
    marked = F.concat(F.array(F.lit(-1), F.lit(7), F.lit(-1)), "c", F.array(F.lit(-2), F.lit(9), F.lit(-2)))
    return code_arrays(spark, d).select("id", A.between_markers(marked, -1, -2).alias("inner_ids"))


@query(f"WITH {_ROWS} SELECT id, c AS ids FROM c")
def pf20_without_prompt(spark, d):
    prompt = F.array(F.lit(-5), F.lit(-6))
    return code_arrays(spark, d).select("id", A.without_prompt(F.concat(prompt, "c", F.array(F.lit(-9), F.lit(-9), F.lit(-8))), prompt, [-8, -9]).alias("ids"))


@query(f"WITH {_ROWS}, s AS (SELECT id, list_filter(c, lambda x: x % 3 = 0) AS c FROM c) SELECT id, [1, 10, 20] || c || [11, 2, 3] AS ids FROM s WHERE len(c) > 0")
def pf10_prompt_slice(spark, d):
    """Prompts of training sequences; rows without audio are left out (pf7)."""
    audio = F.filter("c", lambda x: x % 3 == 0)
    rows = code_arrays(spark, d).select("id", audio.alias("audio")).where(F.size("audio") > 0)
    out = rows.select("id", A.training_sequence(F.col("audio"), F.col("audio"), MARKS).alias("s"))
    return out.select("id", F.slice("s.input_ids", F.lit(1), F.col("s.prompt_end")).alias("ids"))


#: Ids of the marks around a sequence's parts, as made up as the table's codes.
MARKS = {"human": [1], "bos": [10, 20], "eot": [11], "end_human": [2], "ai": [3], "speech": [4], "end_speech": [5], "end_ai": [6]}


@query(f"WITH {_ROWS} SELECT id, [1, 10, 20] || [id % 100] || c || [11, 2, 3, 4] || list_reverse(c) || [5, 6] AS input_ids, CAST(len(c) + 7 AS INTEGER) AS prompt_end FROM c")
def pf8_training_sequences(spark, d):
    """Sequences with a speaker's prefix."""
    prefix = F.array((F.col("id") % 100).cast("int"))
    return code_arrays(spark, d).select("id", A.training_sequence(F.col("c"), F.reverse("c"), MARKS, prefix).alias("s")).select("id", "s.*")


@query(f"WITH {_ROWS} SELECT id, [1, 10, 20] || c || [11, 2, 3, 4] || list_reverse(c) || [5, 6] AS input_ids, CAST(len(c) + 6 AS INTEGER) AS prompt_end FROM c")
def pf9_conversation_sequences(spark, d):
    """The same for a conversation, which has no prefix."""
    return code_arrays(spark, d).select("id", A.training_sequence(F.col("c"), F.reverse("c"), MARKS).alias("s")).select("id", "s.*")


@query("SELECT doc_id, [10, CASE WHEN lang = 'en' THEN 1 ELSE 2 END, 0, 0, CASE WHEN n_chars > 1000 THEN 5 ELSE 6 END, 0, 0, 0, 0, 11] AS prompt FROM documents")
def pf19_prompt_slots(spark, d):
    language, mode = F.when(F.col("lang") == "en", 1).otherwise(2), F.when(F.col("n_chars") > 1000, 5).otherwise(6)
    return table(spark, d, "documents").select("doc_id", A.slots({0: F.lit(10), 1: language, 4: mode, 9: F.lit(11)}, 10).alias("prompt"))


@query("SELECT event_id, CASE WHEN value > 50 THEN value END AS big, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def pf22_optional_columns(spark, d):
    """Absent scores are left out of a map, and read back as nulls."""
    scores = F.map_filter(F.create_map(F.lit("big"), F.when(F.col("value") > 50, F.col("value")), F.lit("k"), F.get_json_object("props", "$.k").cast("double")), lambda _, v: v.isNotNull())
    out = table(spark, d, "events").select("event_id", F.from_json(F.to_json(scores), "map<string,double>").alias("m"))
    return out.select("event_id", F.col("m")["big"].alias("big"), F.col("m")["k"].cast("int").alias("k"))


@query(f"WITH {_ROWS} SELECT id, greatest(0, 5 - len(c)) + len(c) AS n, CAST(round_even(greatest(0, 5 - len(c)) / 2.0, 0) AS INTEGER) AS lead FROM c")
def f13_centre_padding(spark, d):
    padded = A.centre_padded(F.transform("c", lambda x: x.cast("double") + 1), 5)
    lead = F.array_position(F.transform(padded, lambda x: x > 0), True).cast("int") - 1
    return code_arrays(spark, d).select("id", F.size(padded).cast("long").alias("n"), lead.alias("lead"))


@query("SELECT o_orderkey AS id, CAST((2 * o_custkey * 16000 + 44100) // (2 * 44100) AS BIGINT) AS samples FROM orders")
def f14_resampled_lengths(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), A.resampled_length(F.col("o_custkey"), 44100, 16000).alias("samples"))


@query("SELECT event_id, CASE WHEN value - 20 > 0 THEN round(event_id / (value - 20), 6) ELSE 0 END AS rtf FROM events")
def f18_real_time_factor(spark, d):
    return table(spark, d, "events").select("event_id", F.round(A.real_time_factor(F.col("event_id").cast("double"), F.col("value") - 20), 6).alias("rtf"))


_LEVELS = "l AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query(f"""WITH {_LEVELS}, t AS (SELECT user_id, least(quantile_cont(value, 0.1) + 8, max(value) - 20) AS level FROM l GROUP BY user_id),
 s AS (SELECT l.user_id, k, k - row_number() OVER (PARTITION BY l.user_id ORDER BY k) AS island FROM l JOIN t ON l.user_id = t.user_id WHERE value < level)
 SELECT user_id, min(k) AS first, max(k) + 1 AS past FROM s GROUP BY user_id, island HAVING count(*) >= 2""")
def w10_silence_islands(spark, d):
    """Runs of at least two quiet rows (w13: the level is the floor's and the peak's)."""
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events")
    # The floor lies between the values at two places, found over value counts.
    counts = e.where("value IS NOT NULL").groupBy("user_id", "value").agg(F.count(F.lit(1)).alias("n"))
    place = (F.sum("n").over(w) - 1) * F.lit(0.1)
    counts = counts.withColumns({"place": place, "up_to": F.sum("n").over(w.orderBy("value"))})
    low, high = (F.min(F.when(F.col("up_to") > at("place"), F.col("value"))).alias(name) for at, name in ((F.floor, "low"), (F.ceil, "high")))
    users = counts.groupBy("user_id").agg(low, high, F.max("value").alias("peak"), F.max(F.col("place") - F.floor("place")).alias("part"))
    level = F.least(A.interpolated(F.col("low"), F.col("high"), F.col("part")) + 8, F.col("peak") - 20)
    order = w.orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    rows = e.select("user_id", "value", F.row_number().over(order).alias("k"))
    quiet = rows.join(users.select("user_id", level.alias("level")), "user_id").where("value < level")
    quiet = quiet.withColumn("island", F.col("k") - F.row_number().over(w.orderBy("k")))
    runs = quiet.groupBy("user_id", "island").agg(F.min("k").alias("first"), (F.max("k") + 1).alias("past"), F.count(F.lit(1)).alias("n"))
    return runs.where("n >= 2").select("user_id", F.col("first").cast("long").alias("first"), F.col("past").cast("long").alias("past"))


RATE = 1000
#: Chunks of a session's recording.
CHUNKS = 512


def audio(spark, d):
    """Chunks of 0.2 s: a tone for some events, near silence for others; a session is ``CHUNKS`` events in a row."""
    loud = (F.col("event_id") % 23 < 15).cast("double") * 0.5 + 0.001
    wave = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: loud * F.when(i % 4 < 2, 1.0).otherwise(-1.0) * (1 + i % 3))
    return table(spark, d, "events").select(F.floor(F.col("event_id") / CHUNKS).alias("session"), "event_id", wave.alias("samples"))


def _said(x) -> str:
    return f"{len(x)} samples"


@query()
def st1_speech_segments(spark, d):
    """Segments of each session."""
    make = lambda: Endpoints(_said, rate=RATE)
    return replay(audio(spark, d), "session", ["event_id"], "samples", make, "session long, kind string, start_s double, end_s double, text string")


@query()
def st7_session_events(spark, d):
    """The same as a client's events: start, PCM audio and eof to updates and an end."""

    def events(sessions, ids, firsts, lasts, samples):
        import pandas as pd

        out = []
        for first, last, s in zip(firsts, lasts, samples, strict=True):
            rows = [("audio", G.to_pcm16(np.asarray(s, float) / 4))]
            out.append([("start", None)] * bool(first) + rows + [("eof", None)] * bool(last))
        return pd.Series(out)

    rows = audio(spark, d)
    ends = rows.groupBy("session").agg(F.min("event_id").alias("least"), F.max("event_id").alias("greatest"))
    rows = rows.join(ends, "session").withColumns({"first": F.col("event_id") == F.col("least"), "last": F.col("event_id") == F.col("greatest")})
    kind = "array<struct<kind: string, data: binary>>"
    rows = rows.withColumn("e", F.pandas_udf(events, kind)("session", "event_id", "first", "last", "samples"))
    rows = rows.select("session", "event_id", F.posexplode("e").alias("pos", "event")).withColumn("event", F.array(F.col("event.kind").cast("binary"), F.col("event.data")))

    class Client(Session):
        def push(self, event):
            kind, data = event
            return super().push((bytes(kind).decode(), data))

    make = lambda: Client(lambda: Endpoints(_said, rate=RATE))
    out = replay(rows, "session", ["event_id", "pos"], "event", make, "session long, event string, start_s double, end_s double, text string")
    return out.select("session", "event", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "text")


@query(f"""WITH {_ROWS}, f AS (SELECT id // 16 AS request, flatten(list(c ORDER BY id)) AS c FROM c GROUP BY 1),
 k AS (SELECT request, c, unnest(range(len(c))) AS frame FROM f)
 SELECT request, CAST(frame AS INTEGER) AS frame, flatten(list_transform(range(frame - 1, frame + 3), lambda j: list_transform(range(7), lambda s: CASE WHEN j >= 0 AND j < len(c) THEN c[j + 1] ELSE 0 END))) AS codes FROM k""")
def st2_frame_windows(spark, d):
    """A request's tokens come in pieces that do not keep to frames."""
    tokens = F.flatten(F.transform("c", lambda x: F.array(*(x + k * A.CODES for k in range(7)))))
    rows = code_arrays(spark, d).withColumn("request", F.floor(F.col("id") / 16))
    first = rows.groupBy("request").agg(F.min("id").alias("least"))
    rows = rows.join(first, "request").withColumn("tokens", F.concat(F.when(F.col("id") == F.col("least"), F.array(F.lit(7), F.lit(-1))).otherwise(F.array().cast("array<int>")), tokens))
    # Each row's last five tokens come with the next piece.
    cut = F.size("tokens") - 5
    pieces = F.array(F.struct(F.lit(0).alias("part"), F.slice("tokens", F.lit(1), cut).alias("t")), F.struct(F.lit(1).alias("part"), F.slice("tokens", cut + 1, 5).alias("t")))
    rows = rows.select("request", "id", F.explode(pieces).alias("p")).select("request", "id", "p.part", "p.t")
    return replay(rows, "request", ["id", "part"], "t", lambda: FrameWindows(-1, -2), "request long, frame int, codes array<int>")


@query("""SELECT l_orderkey // 8 AS request, CAST(row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS idx,
 CAST(l_quantity AS INTEGER) AS n FROM lineitem""")
def st3_in_order(spark, d):
    """Rows of a request that arrive in any order, given in theirs."""
    request = Window.partitionBy("request").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, d, "lineitem").withColumn("request", F.floor(F.col("l_orderkey") / 8)).withColumn("idx", (F.row_number().over(request) - 1).cast("int"))
    rows = rows.select("request", F.pmod(F.xxhash64("request", "idx"), F.lit(1 << 40)).alias("arrival"), F.array("idx", F.col("l_quantity").cast("int")).alias("row"))
    return replay(rows, "request", ["arrival"], "row", lambda: InOrder(1024), "request long, idx int, n int")


@query("""WITH RECURSIVE e AS (SELECT event_type, event_id, CAST(event_id * 3 + event_id % 7 AS DOUBLE) AS came, row_number() OVER (PARTITION BY event_type, event_id // 512 ORDER BY event_id * 3 + event_id % 7, event_id) AS k, event_id // 512 AS span FROM events),
 w AS (SELECT event_type, span, event_id, k, came, 0 AS batch, 1 AS n, came + 40 AS due FROM e WHERE k = 1 UNION ALL
  SELECT e.event_type, e.span, e.event_id, e.k, e.came, batch + CAST(n = 8 OR e.came >= due AS INTEGER), CASE WHEN n = 8 OR e.came >= due THEN 1 ELSE n + 1 END, CASE WHEN n = 8 OR e.came >= due THEN e.came + 40 ELSE due END
  FROM w JOIN e ON e.event_type = w.event_type AND e.span = w.span AND e.k = w.k + 1)
 SELECT event_type || '/' || span AS request, batch, CASE WHEN count(*) = 8 THEN max(came) ELSE max(due) END AS left_at, list(event_id ORDER BY k) AS items FROM w GROUP BY event_type, span, batch""")
def st3_micro_batches(spark, d):
    """Batches of up to 8 events that wait 40 ms at most."""
    at = F.col("event_id") * 3 + F.col("event_id") % 7
    e = table(spark, d, "events").select(F.concat_ws("/", "event_type", F.floor(F.col("event_id") / 512).cast("string")).alias("request"), "event_id", at.alias("at"))
    rows = e.withColumn("row", F.array("at", "event_id"))
    make = lambda: MicroBatches(8, 40)
    out = replay(rows, "request", ["at", "event_id"], "row", make, "request string, batch int, left_at double, items array<long>")
    return out


@query(f"""SELECT event_id // {CHUNKS} AS session, count(*) AS frames, count(*) * 400 AS n_bytes FROM events GROUP BY 1""")
def st4_loudness(spark, d):
    def pcm(samples):
        return samples.map(lambda x: G.to_pcm16(np.asarray(x, float) / 4))

    rows = audio(spark, d).withColumn("pcm", F.pandas_udf(pcm, "binary")("samples"))
    out = replay(rows, "session", ["event_id"], "pcm", Loudness, "session long, pcm binary")
    return out.groupBy("session").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.length("pcm")).alias("n_bytes"))


@query()
def v1_cut_points(spark, d):
    """Chunks of each session's whole recording (v2, w12: framed levels)."""

    def cut(group: dict) -> dict:
        x = np.concatenate([np.asarray(s, float) for s in group["samples"]])
        spans = G.cut_points(x, RATE)
        return {"session": [group["session"][0]] * len(spans), "idx": list(range(len(spans))), "start_s": [a / RATE for a, _ in spans], "end_s": [b / RATE for _, b in spans]}

    return per_group(audio(spark, d), ["session"], ["event_id"], cut, "session long, idx int, start_s double, end_s double")


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice / 4000 > 45 THEN 'chunk' ELSE 'whole' END AS route FROM orders")
def v3_duration_routing(spark, d):
    """Long recordings are chunked, others are not."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), Q.route(F.col("o_totalprice") / 4000, 45).alias("route"))


def _model(name: str):
    """Stands in for a model: its name with the text's length; the one for whole recordings refuses every seventh length."""

    def make():
        def run(texts):
            if name == "whole" and any(len(t) % 7 == 0 for t in texts):
                raise ValueError("refused")
            return [f"{name} {len(t)}" for t in texts]

        return run

    return make


@query("""WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 11 <> 0 AND n_chars > 2000 THEN 'chunk' ELSE 'whole' END AS route FROM documents)
 SELECT doc_id, route, CASE WHEN route = 'chunk' OR length(text) % 7 <> 0 THEN route || ' ' || length(text) END AS result,
  CASE WHEN route = 'whole' AND length(text) % 7 = 0 THEN 'ValueError: refused' END AS error FROM r""")
def v5_routed_results(spark, d):
    """Results of both routes with their rows; recordings of unknown length go whole, failures are rows."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("seconds"))
    out = Q.transcribed(rows, F.col("seconds"), 2000, F.col("text"), _model("whole"), _model("chunk"), "string")
    return out.select("doc_id", "route", "result", "error")


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) FILTER (turn % 3 <> 0) AS text FROM conversations GROUP BY conv_id HAVING count(*) FILTER (turn % 3 <> 0) > 0")
def v4_joined_chunks(spark, d):
    item = F.struct("turn", F.when(F.col("turn") % 3 == 0, F.lit(" ")).otherwise(F.col("role")).alias("t"))
    out = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("r"))
    kept = F.filter(F.transform("r", lambda x: x["t"]), lambda t: F.trim(t) != "")
    return out.where(F.size(kept) > 0).select("conv_id", F.array_join(kept, " ").alias("text"))


_RMS = "sqrt(list_avg(list_transform({0}, lambda v: v * v)))"


@query(f"""WITH w AS (SELECT DISTINCT CASE WHEN event_id % 23 < 15 THEN 0.501 ELSE 0.001 END::DOUBLE AS loud FROM events),
 x AS (SELECT loud, list_transform(range(200), lambda i: trunc(greatest(-1.0, least(1.0, loud * CASE WHEN i % 4 < 2 THEN 1.0 ELSE -1.0 END::DOUBLE * (1 + i % 3) / 4)) * 32767) / 32768.0::DOUBLE) AS x FROM w),
 f AS (SELECT loud, x, list_transform(range(10), lambda k: {_RMS.format('x[20 * k + 1:20 * k + 20]')}) AS fr FROM x),
 a AS (SELECT loud, x, fr, {_RMS.format('x')} AS rms, list_filter(fr, lambda v: v > pow(10.0, -45 / 20.0)) AS act, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM f),
 b AS (SELECT *, CASE WHEN len(act) > 0 THEN {_RMS.format('act')} ELSE 0.0 END AS active FROM a),
 c AS (SELECT *, CASE WHEN active <= pow(10.0, -45 / 20.0) THEN 1.0 ELSE pow(10.0, greatest(-12.0, least(12.0, -20 - 20 * log10(rms))) / 20) END AS gain,
  list_filter(range(10), lambda k: fr[k + 1] > list_max(fr) * pow(10.0, -30 / 20.0)) AS heard FROM b),
 l AS (SELECT loud, round(rms, 6) AS rms, round(active, 6) AS active, round(rms * gain, 6) AS louder, round(CASE WHEN peak > 1e-9 THEN pow(10.0, -1 / 20.0) ELSE peak END, 6) AS peak,
  CAST(CASE WHEN list_max(fr) > 1e-9 THEN 20 * (list_max(heard) - list_min(heard) + 1) ELSE 200 END + 50 + 200 AS INTEGER) AS n FROM c)
 SELECT event_id // {CHUNKS} AS session, event_id, l.rms, active, louder, peak, n FROM events JOIN l ON loud = CASE WHEN event_id % 23 < 15 THEN 0.501 ELSE 0.001 END::DOUBLE""")
def f8_levels(spark, d):
    """Levels of chunks before and after normalisation (f9, f10, f11, f12)."""

    def levels(samples):
        import pandas as pd

        rows = []
        for s in samples:
            x = G.from_pcm16(G.to_pcm16(np.asarray(s, float) / 4))
            louder = G.loudness_normalised(x, RATE)
            whole = G.joined([G.trimmed(x, RATE), louder], RATE, 0.05)
            rows.append((round(G.rms(x), 6), round(G.active_rms(x, RATE), 6), round(G.rms(louder), 6), round(float(np.abs(G.peak_normalised(x)).max()), 6), len(whole)))
        return pd.DataFrame(rows, columns=["rms", "active", "louder", "peak", "n"])

    udf = F.pandas_udf(levels, "struct<rms: double, active: double, louder: double, peak: double, n: int>")
    return audio(spark, d).withColumn("l", udf("samples")).select("session", "event_id", "l.*")
