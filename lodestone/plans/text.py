"""Queries over texts, chats and rendered pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.functions import segmentation as G
from lodestone.functions import strings as S
from lodestone.operators import render as R
from lodestone.plans.registry import query, table

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_U = "(('0x' || substr(md5({0}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0)"
TEMPLATES = ["Translate to {tgt}: {text}", "{src} to {tgt}\n{text}", "Say this in {tgt}.\n\n{text}"]


def turns(spark, d):
    return table(spark, d, "conversations")


def conversations(spark, d):
    """(conv_id, turns): turns as an ordered array of (speaker, text)."""
    row = F.struct("turn", F.col("role").alias("speaker"), "text")
    return turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))


_PAIRS = f"""pairs AS (SELECT u.conv_id AS conv_id, u.turn AS turn, u.conv_id * 100 + u.turn AS row, {_STRIP.format("u.text")} AS src, {_STRIP.format("a.text")} AS tgt
 FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
 both_ways AS (SELECT row, src, tgt, 'eng_Latn' AS src_lang, 'hin_Deva' AS tgt_lang, 'forward' AS direction, 0 AS ord FROM pairs WHERE src <> '' AND tgt <> ''
 UNION ALL SELECT row, tgt AS src, src AS tgt, 'hin_Deva', 'eng_Latn', 'reverse', 1 FROM pairs WHERE src <> '' AND tgt <> ''
 AND {_U.format("'17' || chr(31) || 'reverse' || chr(31) || 'chat' || chr(31) || row")} < 0.25)"""


def pairs(spark, d):
    u = turns(spark, d).where("role = 'user'").select("conv_id", "turn", S.strip("text").alias("src"))
    a = turns(spark, d).where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), S.strip("text").alias("tgt"))
    rows = u.join(a, ["conv_id", "turn"]).where("src <> '' AND tgt <> ''").withColumn("row", F.col("conv_id") * 100 + F.col("turn"))
    rows = rows.withColumns({"corpus": F.lit("chat"), "src_lang": F.lit("eng_Latn"), "tgt_lang": F.lit("hin_Deva")})
    return R.directed(rows, 0.25, 17)


@query(f"WITH {_PAIRS} SELECT row, direction, src_lang, tgt_lang, src, tgt FROM both_ways")
def u2_both_directions(spark, d):
    """Forward pairs and a share of reverse ones (n3: chosen by hash)."""
    return pairs(spark, d).select("row", "direction", "src_lang", "tgt_lang", "src", "tgt")


@query(f"""WITH {_PAIRS} SELECT row, direction, count(*) OVER () > 0 AS kept FROM
 (SELECT *, row_number() OVER (PARTITION BY src_lang, tgt_lang, src, tgt ORDER BY row, ord) AS k FROM both_ways) WHERE k = 1""")
def w1_direction_aware_dedup(spark, d):
    from lodestone.operators.corpus import first_occurrence

    kept = first_occurrence(pairs(spark, d), ["src_lang", "tgt_lang", "src", "tgt"], ["row", "ord"])
    return kept.select("row", "direction", F.lit(True).alias("kept"))


@query(f"""WITH {_PAIRS}, t AS (SELECT *, CAST(floor({_U.format("'17' || chr(31) || 'template' || chr(31) || 'chat' || chr(31) || direction || chr(31) || row")} * 3) AS INTEGER) AS template_id FROM both_ways),
 n AS (SELECT *, CASE src_lang WHEN 'eng_Latn' THEN 'English' ELSE 'Hindi' END AS s, CASE tgt_lang WHEN 'eng_Latn' THEN 'English' ELSE 'Hindi' END AS g FROM t)
 SELECT row, direction, template_id, CASE template_id WHEN 0 THEN 'Translate to ' || g || ': ' || src WHEN 1 THEN s || ' to ' || g || chr(10) || src
 ELSE 'Say this in ' || g || '.' || chr(10) || chr(10) || src END AS prompt, tgt AS reply FROM n""")
def pf2_rendered_rows(spark, d):
    """Prompts from hashed template choices (n4, pf3, pf4)."""
    out = R.rendered(pairs(spark, d), TEMPLATES, 17)
    m = F.col("messages")
    return out.select("row", "direction", "template_id", m[0]["content"].alias("prompt"), m[1]["content"].alias("reply"))


@query(f"""WITH {_PAIRS} SELECT row, direction FROM both_ways WHERE len(list_filter(regexp_split_to_array(src || ' ' || tgt, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) + 4 <= 120""")
def pf5_length_filter(spark, d):
    words = F.size(F.filter(F.split(F.concat_ws(" ", "src", "tgt"), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    return R.checked_length(pairs(spark, d), 120, words + 4).select("row", "direction")


@query(f"""WITH u AS (SELECT doc_id, {_U.format("'5' || chr(31) || 'dev' || chr(31) || doc_id")} AS u FROM documents),
 v AS (SELECT doc_id FROM u WHERE u < 0.1 ORDER BY u, doc_id LIMIT 40)
 SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM v) THEN 'dev' ELSE 'train' END AS split FROM documents""")
def n2_capped_dev_split(spark, d):
    return R.dev_split(table(spark, d, "documents").select("doc_id"), 0.1, 40, 5, "doc_id")


_NAMES = ["hin_Deva", "HINDI", " Manipuri ", "sindhi", "mni_Beng", "urd_Arab"]


@query(f"""SELECT doc_id, ['Hindi', 'Hindi', 'Manipuri (Meitei script)', 'Sindhi (Devanagari script)', 'Manipuri (Bengali script)', 'Urdu'][doc_id % 6 + 1] AS name FROM documents""")
def pf4_language_names(spark, d):
    value = F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 6).cast("int"))
    return table(spark, d, "documents").select("doc_id", R.language_name(value).alias("name"))


@query()
def n5_stable_seeds(spark, d):
    """BLAKE2b seeds of source and doc_id, as decimal strings."""
    return table(spark, d, "documents").select("doc_id", R.stable_seed_of(F.col("source"), F.col("doc_id")).alias("seed"))


@query("""SELECT doc_id, src_lang, tgt_lang, src, ref FROM (
 SELECT doc_id, 'text' AS src_lang, unnest(['lang', 'source']) AS tgt_lang, text AS src, unnest([lang, source]) AS ref FROM documents
 UNION ALL SELECT doc_id, unnest(['lang', 'source']), 'text', unnest([lang, source]), text FROM documents)""")
def sc14_parallel_tasks(spark, d):
    return R.parallel_tasks(table(spark, d, "documents"), "doc_id", "text", ["lang", "source"])


_SER = f"""SELECT conv_id, string_agg('<|speaker>' || {_STRIP.format("role")} || '<speaker|>' || chr(10) || {_STRIP.format("text")}, chr(10) || chr(10) ORDER BY turn) AS dialogue
 FROM conversations WHERE {_STRIP.format("text")} <> '' GROUP BY conv_id"""


@query(_SER)
def t12_serialised_dialogue(spark, d):
    return conversations(spark, d).select("conv_id", S.dialogue(F.col("turns")).alias("dialogue"))


@query(f"""SELECT conv_id, '<bos>' || string_agg(CASE role WHEN 'user' THEN '<|turn>user' || chr(10) || {_STRIP.format("text")} || '<turn|>' || chr(10)
 WHEN 'assistant' THEN '<|turn>model' || chr(10) || {_STRIP.format("text")} || '<turn|>' || chr(10) ELSE '' END, '' ORDER BY turn) || '<|turn>model' || chr(10) AS chat FROM conversations GROUP BY conv_id""")
def t17_chat_template(spark, d):
    c = conversations(spark, d)
    messages = F.transform("turns", lambda t: F.struct(t["speaker"].alias("role"), t["text"].alias("content")))
    return c.select("conv_id", S.chat(messages, open_reply=True).alias("chat"))


@query("SELECT conv_id, turn AS idx, role AS speaker, length(text) AS chars FROM conversations")
def w14_turn_expansion(spark, d):
    out = conversations(spark, d).select("conv_id", F.posexplode_outer("turns").alias("idx", "t"))
    return out.select("conv_id", F.col("t.turn").alias("idx"), F.col("t.speaker").alias("speaker"), F.length("t.text").cast("long").alias("chars"))


_N = lambda c: f"length(regexp_replace(coalesce(text, ''), '[^{c}]', '', 'g'))"


@query(f"""SELECT doc_id, round({_N(chr(92) + 'x00-' + chr(92) + 'x{2FF}')} / 14.0 + {_N(chr(92) + 'x{900}-' + chr(92) + 'x{97F}')} / 12.0 + {_N(chr(92) + 'x{3000}-' + chr(92) + 'x{9FFF}')} / 5.0
 + (length(text) - {_N(chr(92) + 'x00-' + chr(92) + 'x{2FF}')} - {_N(chr(92) + 'x{900}-' + chr(92) + 'x{97F}')} - {_N(chr(92) + 'x{3000}-' + chr(92) + 'x{9FFF}')}) / 12.0, 4) AS seconds FROM documents""")
def t5_speech_seconds(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(S.speech_seconds(F.col("text")), 4).alias("seconds"))


@query(f"""WITH s AS (SELECT doc_id, length(text) AS n, {_N(chr(92) + 'x00-' + chr(92) + 'x{2FF}')} AS a FROM documents WHERE length(text) > 0)
 SELECT doc_id, greatest(16, CAST(floor(n / (a / 14.0 + (n - a) / 12.0) * 20.0) AS INTEGER)) AS budget FROM s""")
def t6_char_budget(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    return docs.select("doc_id", S.char_budget(F.col("text"), 20.0).alias("budget"))


@query(r"""WITH c AS (SELECT doc_id, right(regexp_replace(text, '\s+$', ''), 1) AS last, length(text) AS n FROM documents)
 SELECT doc_id, CASE WHEN last IN ('.', '!', '?', '…', '"', '''', ')', ']', '}', '»', '”', '’') THEN 'sentence' WHEN last IN (',', ';', ':') THEN 'clause' ELSE 'hard' END AS kind,
 round_even(n / 14.0, 2) AS est_seconds, CAST(round_even(n / 14.0 * 82.0, 0) AS BIGINT) AS est_tokens, round_even(n / 14.0 * 82.0, 0) > 2048 AS too_long FROM c""")
def t8_boundary_and_estimates(spark, d):
    seconds, tokens = S.speech_estimates(F.length("text"))
    return table(spark, d, "documents").select(
        "doc_id", S.boundary(F.col("text")).alias("kind"), seconds.alias("est_seconds"), tokens.alias("est_tokens"), (tokens > S.TOKEN_CEILING).alias("too_long")
    )


@query()
def t1_sentences(spark, d):
    out = table(spark, d, "documents").select("doc_id", G.sentences_of(F.col("text")).alias("s"))
    return out.select("doc_id", F.posexplode("s").alias("idx", "sentence"))


@query()
def t4_chunks(spark, d):
    """Chunks of at most 300 characters (t2: cut by ladder, t3: packed)."""
    out = table(spark, d, "documents").select("doc_id", G.chunks_of(F.col("text"), 300, 120).alias("c"))
    return out.select("doc_id", F.posexplode("c").alias("idx", "chunk"))


@query()
def t7_dialogue_plan(spark, d):
    """Dialogues in chunks of at most 300 serialised characters (w15: turn ends)."""
    plan = G.dialogue_plan_of(F.transform("turns", lambda t: F.struct(t["speaker"].alias("speaker"), t["text"].alias("text"))), 300, None, 200)
    out = conversations(spark, d).select("conv_id", F.explode(plan).alias("p"))
    out = out.select("conv_id", "p.*")
    return out.withColumn("kind", S.boundary(F.col("last"))).withColumn("speakers", F.array_join("speakers", ",")).drop("last")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])[-‐‑‒–—−]' || chr(10) || '[ \t]*([\p{L}\p{N}_])', '\1\2', 'g'),
 '([\p{L}\p{N}_])[-‐‑‒–—−]' || chr(10) || '[ \t]*([\p{L}\p{N}_])', '\1\2', 'g') AS text
 FROM (SELECT doc_id, regexp_replace(text, '(\p{L})(\p{L}{3}) ', '\1-' || chr(10) || '  \2 ', 'g') AS t FROM documents)""")
def t9_dehyphenated(spark, d):
    broken = F.regexp_replace("text", r"(\p{L})(\p{L}{3}) ", "$1-\n  $2 ")
    return table(spark, d, "documents").select("doc_id", S.dehyphenate(broken).alias("text"))


@query(r"""SELECT doc_id, 'x $$' || regexp_replace(regexp_replace(replace(text, '$', '') || chr(10) || ' \text{क} = 9 \text{ख}', '^\s+|\s+$', '', 'g'), '\s*\n\s*', ' \\\\ ', 'g') || '$$ $\text{ग}+1$' AS text FROM documents""")
def t10_repaired_math(spark, d):
    text = F.concat(F.lit("x $$"), F.replace(F.col("text"), F.lit("$"), F.lit("")), F.lit("\n क = 9 \\text{ख}$$ $ग+1$"))
    return table(spark, d, "documents").select("doc_id", G.repaired_math_of(text).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(replace(array_to_string(list_transform(string_split(text, ' '), lambda x: '▁' || x), ''), '▁', ' '), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def t14_joined_pieces(spark, d):
    pieces = F.transform(F.split("text", " "), lambda x: F.concat(F.lit("▁"), x))
    return table(spark, d, "documents").select("doc_id", S.join_pieces(pieces).alias("text"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN NULL ELSE lang END AS code FROM documents""")
def t15_language_tokens(spark, d):
    token = F.when(F.col("doc_id") % 5 == 0, F.lit("<|itn|>")).when(F.col("doc_id") % 5 == 1, F.col("lang")).otherwise(F.concat(F.lit("<|"), "lang", F.lit("|>")))
    return table(spark, d, "documents").select("doc_id", S.language_token(token).alias("code"))


@query(f"SELECT doc_id, {_STRIP.format('text')} AS text, length({_STRIP.format('text')}) AS n FROM documents")
def t18_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", S.strip("text").alias("text"), F.length(S.strip("text")).cast("long").alias("n"))


@query(r"""SELECT conv_id, turn, levenshtein(a, b) AS distance FROM (SELECT u.conv_id, u.turn,
 regexp_replace(u.text, '[^\x00-\x7F]', '?', 'g') AS a, regexp_replace(v.text, '[^\x00-\x7F]', '?', 'g') AS b
 FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1)""")
def t16_character_distance(spark, d):
    """Distance of whole texts, turn by turn; SQL's counts bytes, so any other letter than ASCII's is one mark."""
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    u = turns(spark, d).select("conv_id", "turn", plain(F.col("text")).alias("a"))
    v = turns(spark, d).select("conv_id", (F.col("turn") - 1).alias("turn"), plain(F.col("text")).alias("b"))
    return u.join(v, ["conv_id", "turn"]).select("conv_id", "turn", F.levenshtein("a", "b").cast("long").alias("distance"))


@query("SELECT DISTINCT lang AS l, lang IN ('en', 'fr', 'de', 'es', 'hi') AS ok FROM documents")
def pf18_allowed_languages(spark, d):
    named = F.create_map(F.lit("all"), F.array(*map(F.lit, ["en", "fr", "de", "es", "hi"])))
    asked = F.split(F.concat("lang", F.lit(",all")), ",")
    parts = F.array_distinct(F.flatten(F.transform(asked, lambda x: F.coalesce(named[x], F.array(x)))))
    out = table(spark, d, "documents").select(F.col("lang").alias("l"), parts.alias("p")).distinct()
    return out.select("l", F.forall("p", lambda x: F.array_contains(named["all"], x)).alias("ok"))


def _stand_in():
    """A model's stand-in: the text's length; it refuses every fifth length."""

    def run(texts):
        if any(len(t) % 5 == 0 for t in texts):
            raise ValueError("refused")
        return [len(t) for t in texts]

    return run


@query("SELECT doc_id, CASE WHEN length(text) % 5 <> 0 THEN length(text) END AS value, CASE WHEN length(text) % 5 = 0 THEN 'ValueError: refused' END AS error FROM documents")
def pf15_isolated_errors(spark, d):
    """Rows that a model fails on become error rows; the others keep their values."""
    from lodestone.operators import models

    out = table(spark, d, "documents").select("doc_id", models.applied(_stand_in, F.col("text"), "bigint").alias("r"))
    good, bad = models.split_errors(out, "r")
    return good.unionByName(bad).select("doc_id", "r.value", "r.error")
