"""Queries over mixes, packs and language reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.operators import lid as I
from lodestone.operators import mixing as M
from lodestone.plans.files import scratch
from lodestone.plans.registry import query, table

_U = "(('0x' || substr(md5({0}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0)"
RATIOS = {"en": 0.1, "fr": 0.3, "de": 0.4, "es": 0.2}


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query(f"""WITH c AS (SELECT lang, doc_id, n_chars, count(*) OVER (PARTITION BY lang) AS size, count(*) OVER () AS total FROM documents),
 t AS (SELECT *, greatest(1, CAST(floor(CASE lang WHEN 'en' THEN 0.1 WHEN 'fr' THEN 0.3 WHEN 'de' THEN 0.4 ELSE 0.2 END * total) AS INTEGER)) AS target, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS local FROM c),
 few AS (SELECT lang, doc_id FROM t WHERE target <= size QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_U.format("'3' || chr(31) || '0' || chr(31) || lang || chr(31) || doc_id")}, doc_id) <= target),
 s AS (SELECT DISTINCT lang, size, target FROM t WHERE target > size), dr AS (SELECT lang, size, unnest(range(1, target + 1)) AS draw FROM s),
 l AS (SELECT lang, CAST(floor({_U.format("'3' || chr(31) || '0' || chr(31) || lang || chr(31) || 'draw' || chr(31) || draw")} * size) AS BIGINT) AS local FROM dr)
 SELECT lang, doc_id FROM few UNION ALL SELECT t.lang AS lang, t.doc_id AS doc_id FROM l JOIN t ON l.lang = t.lang AND l.local = t.local""")
def n8_ratio_sampling(spark, d):
    """Ratios are normalised first (n9)."""
    return M.sampled(docs(spark, d), "lang", "doc_id", RATIOS, 3, scratch(spark)).select("lang", "doc_id")


def _packing(order: str, rule: str = "best", groups: int = 1) -> str:
    """Bins one row at a time: ``rooms`` holds what is left of each, -1 for closed ones."""
    found = {
        "best": "list_sort(list_filter(list_transform(rooms, lambda x, i: {'x': x, 'i': i}), lambda s: s.x >= r.length))[1].i",
        "first": "list_position(list_transform(rooms, lambda x: x >= r.length), true)",
    }[rule]
    left = lambda room: f"CASE WHEN {room} > r.length OR ('{rule}' = 'first' AND {room} = r.length) THEN {room} - r.length ELSE -1 END"
    return f"""WITH RECURSIVE o AS (SELECT doc_id AS row_id, n_chars AS length, row_number() OVER (ORDER BY {order}) - 1 AS n FROM documents),
 r AS (SELECT row_id, length, n % {groups} AS pack_group, n // {groups} AS k FROM o),
 p AS (SELECT pack_group, k, row_id, 0 AS bin, [{left("8192")}] AS rooms FROM r WHERE k = 0 UNION ALL
  SELECT pack_group, k, row_id, CASE WHEN f > 0 THEN f - 1 ELSE len(rooms) END AS bin,
   CASE WHEN f > 0 THEN list_transform(rooms, lambda x, i: CASE WHEN i = f THEN {left("x").replace("r.length", "length")} ELSE x END) ELSE list_append(rooms, {left("8192").replace("r.length", "length")}) END
  FROM (SELECT r.pack_group, r.k, r.row_id, r.length, p.rooms, CASE WHEN r.length <= 8192 THEN {found} END AS f FROM p JOIN r ON r.pack_group = p.pack_group AND r.k = p.k + 1))"""


_PACKED = "SELECT pack_group, row_id, bin FROM p"
_BY_LENGTH = "n_chars DESC, doc_id"
# The same with what affinity looks at: rows a bin has of each language, its leading language, rows placed so far.
_AFFINITY = f"""WITH RECURSIVE o AS (SELECT doc_id AS row_id, n_chars AS length, list_position(['de', 'en', 'es', 'fr'], lang) AS d, row_number() OVER (ORDER BY {_BY_LENGTH}) - 1 AS k FROM documents),
 t AS (SELECT count(*) AS total FROM documents), e AS (SELECT list_transform([0.4, 0.1, 0.2, 0.3], lambda x: CAST(floor(x * total) AS BIGINT)) AS expected FROM t),
 p AS (SELECT k, row_id, 0 AS bin, [CASE WHEN length < 8192 THEN 8192 - length ELSE -1 END] AS rooms, [d] AS leads, [list_transform([1, 2, 3, 4], lambda x: CAST(x = d AS INTEGER))] AS held,
   list_transform(expected, lambda x, i: x - CAST(i = d AS INTEGER)) AS lacking FROM o, e WHERE k = 0 UNION ALL
  SELECT k, row_id, coalesce(f - 1, len(rooms)), CASE WHEN f > 0 THEN list_transform(rooms, lambda x, i: CASE WHEN i <> f THEN x WHEN x > length THEN x - length ELSE -1 END) ELSE list_append(rooms, CASE WHEN length < 8192 THEN 8192 - length ELSE -1 END) END,
   CASE WHEN f > 0 THEN list_transform(leads, lambda x, i: CASE WHEN i = f AND (held[f][d] + 1 > held[f][x] OR (held[f][d] + 1 = held[f][x] AND d < x)) THEN d ELSE x END) ELSE list_append(leads, d) END,
   CASE WHEN f > 0 THEN list_transform(held, lambda h, i: CASE WHEN i = f THEN list_transform(h, lambda x, j: x + CAST(j = d AS INTEGER)) ELSE h END) ELSE list_append(held, list_transform([1, 2, 3, 4], lambda x: CAST(x = d AS INTEGER))) END,
   list_transform(lacking, lambda x, i: x - CAST(i = d AS INTEGER))
  FROM (SELECT o.k, o.row_id, o.length, o.d, p.rooms, p.leads, p.held, p.lacking, CASE WHEN o.length <= 8192 THEN
    list_sort(list_filter(list_transform(rooms, lambda x, i: {{'x': x, 'lack': -lacking[leads[i]], 'i': i}}), lambda s: s.x >= o.length))[1].i END AS f FROM p JOIN o ON o.k = p.k + 1))
 SELECT 0 AS pack_group, row_id, bin FROM p"""


def lengths(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("row_id"), F.col("n_chars").alias("length"))


@query(f"{_packing(_BY_LENGTH)} {_PACKED}")
def n10_best_fit_packing(spark, d):
    """Best-fit-decreasing bins of 8192."""
    return M.pack(lengths(spark, d), 8192, scratch(spark))


@query(f"{_packing(_BY_LENGTH, 'first')} {_PACKED}")
def n11_first_fit_packing(spark, d):
    return M.pack(lengths(spark, d), 8192, scratch(spark), rule="first")


@query(f"{_packing('doc_id')} {_PACKED}")
def n12_online_packing(spark, d):
    return M.pack(lengths(spark, d), 8192, scratch(spark), decreasing=False)


@query(_AFFINITY)
def n13_affinity_packing(spark, d):
    """Bins of equal room go to the language that lacks most of its share of all rows."""
    total = docs(spark, d).count()
    expected = {k: int(v * total) for k, v in M.normalised_ratios(RATIOS).items()}
    return M.affinity_pack(lengths(spark, d).join(docs(spark, d).select(F.col("doc_id").alias("row_id"), F.col("lang").alias("dataset")), "row_id"), 8192, expected, scratch(spark))


@query("SELECT doc_id AS row_id, n_chars AS length, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) % 8 AS pack_group FROM documents")
def n14_rank_local_rows(spark, d):
    """Rows of each of 8 ranks before they pack by themselves."""
    return M.rank_local(lengths(spark, d), 8, scratch(spark))


@query(f"{_packing(_BY_LENGTH, groups=8)} {_PACKED}")
def n14_rank_local_packing(spark, d):
    return M.pack(lengths(spark, d), 8192, scratch(spark), groups=8)


@query(f"""{_packing(_BY_LENGTH)}, b AS (SELECT bin, sum(n_chars) AS tokens FROM p JOIN documents ON doc_id = row_id GROUP BY bin)
 SELECT count(*) AS bins, sum(tokens)::BIGINT AS tokens, round(avg(tokens / 8192), 6) AS efficiency FROM b""")
def a21_packing_efficiency(spark, d):
    rows = lengths(spark, d)
    return M.packing_efficiency(M.pack(rows, 8192, scratch(spark)).join(rows, "row_id"), 8192)


@query("""WITH n AS (SELECT count(*) AS n FROM documents), e AS (SELECT n, (7 - n % 7) % 7 AS short FROM n)
 SELECT doc_id AS bin, doc_id % 7 AS rank, 0 AS repeat FROM documents UNION ALL
 SELECT i % n AS bin, (i + n) % 7 AS rank, 1 AS repeat FROM e, unnest(range(short)) AS u(i)""")
def n15_rank_bins(spark, d):
    bins = docs(spark, d).select(F.col("doc_id").alias("bin"))
    return M.rank_bins(bins, "bin", 7).select("bin", F.col("rank").cast("long").alias("rank"), "repeat")


@query("""WITH r AS (SELECT lang AS rank, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS size FROM documents),
 m AS (SELECT max(size) AS most FROM r), s AS (SELECT DISTINCT rank, size, unnest(range(most)) AS slot FROM r, m)
 SELECT s.rank AS rank, s.slot AS slot, r.doc_id AS doc_id FROM s JOIN r ON r.rank = s.rank AND r.k = s.slot % s.size""")
def n16_equal_counts(spark, d):
    return M.equal_counts(docs(spark, d).select(F.col("lang").alias("rank"), "doc_id"), "rank", "doc_id", scratch(spark))


@query(f"SELECT doc_id, round({_U.format("'12' || chr(31) || doc_id")}, 12) AS place FROM documents")
def n17_epoch_order(spark, d):
    """The key that rows are sorted by in an epoch (n21: the same for a dataset)."""
    return docs(spark, d).select("doc_id", F.round(M.epoch_order(docs(spark, d), "doc_id", 10, 2), 12).alias("place"))


@query("""WITH o AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1),
 s AS (SELECT id // 4 AS bin, list(ids ORDER BY id) AS seqs FROM o GROUP BY 1),
 f AS (SELECT bin, flatten(seqs) AS ids, flatten(list_transform(seqs, lambda q: list_transform(q, lambda x, i: CASE WHEN i = 1 THEN -100 ELSE x + 1 END))) AS labels, flatten(list_transform(seqs, lambda q: range(len(q)))) AS pos, least(len(flatten(seqs)), 12) AS n FROM s)
 SELECT bin, list_concat(ids[1:12], list_transform(range(12 - n), lambda x: 7)) AS input_ids, list_concat(labels[1:12], list_transform(range(12 - n), lambda x: -100)) AS labels,
  list_concat(pos[1:12], list_transform(range(12 - n), lambda x: 0)) AS position_ids, list_transform(range(12), lambda i: CAST(i < n AS INTEGER)) AS attention_mask, n / 12 AS efficiency FROM f""")
def n18_collated_rows(spark, d):
    """Several sequences a row of 12, cut where they do not fit, with labels of their own."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("s"))
    rows = rows.select("id", F.transform("s", lambda x: x["l_partkey"]).alias("ids"))
    rows = rows.withColumn("labels", F.transform("ids", lambda x, i: F.when(i == 0, F.lit(-100).cast("long")).otherwise(x + 1)))
    bins = rows.groupBy(F.floor(F.col("id") / 4).alias("bin")).agg(F.array_sort(F.collect_list(F.struct("id", "ids", "labels"))).alias("q"))
    c = A.collated(F.transform("q", lambda x: x["ids"]), F.transform("q", lambda x: x["labels"]), 12, 7)
    return bins.select("bin", c.alias("c")).select("bin", "c.*")


@query("""WITH s AS (SELECT lang, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang),
 f AS (SELECT lang, floor(share * 37 + 1e-9) AS n, round(share * 37 - floor(share * 37 + 1e-9), 9) AS rest FROM s),
 r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, lang) AS k, 37 - sum(n) OVER () AS remaining FROM f)
 SELECT lang, CAST(n + CASE WHEN k <= remaining THEN 1 ELSE 0 END AS BIGINT) AS n FROM r""")
def n19_largest_remainders(spark, d):
    total = docs(spark, d).count()
    shares = docs(spark, d).groupBy("lang").agg((F.count(F.lit(1)) / total).alias("share"))
    return M.largest_remainders(shares, "share", "lang", 37).select("lang", F.col("n").cast("long").alias("n"))


@query(f"""WITH b AS (SELECT lang, doc_id, CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 2 ELSE 1 END AS take,
 row_number() OVER (PARTITION BY lang ORDER BY {_U.format("'9' || chr(31) || '0' || chr(31) || lang || chr(31) || doc_id")}, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS size FROM documents)
 SELECT lang, doc_id, k // take AS batch FROM b WHERE k // take < (SELECT min(size // take) FROM b)""")
def n20_mixed_batches(spark, d):
    return M.mixed_batches(docs(spark, d), "lang", "doc_id", {"en": 5, "fr": 2, "de": 1, "es": 1}, 9, scratch(spark)).select("lang", "doc_id", "batch")


@query(f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {_U.format("'5' || chr(31) || doc_id")}, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
 SELECT k + n * r AS slot, doc_id FROM o, unnest(range(3)) AS u(r) WHERE k + n * r < n * 5 // 2""")
def n22_cycled_rows(spark, d):
    """Two and a half rounds of all rows, shuffled."""
    rows = docs(spark, d)
    return M.cycled(rows, "doc_id", rows.count() * 5 // 2, 5, scratch(spark))


# Scores of a language: a remainder of its id, so every row has a defined best and ties occur.
_LANGS = ["en", "fr", "de", "es", "hi"]
_SCORE = "CAST((doc_id * 7 + n_chars * 3 + {k} * 11) % 20 AS DOUBLE) / 20 + CASE WHEN lang = '{l}' THEN 0.375 ELSE 0 END"
_SCORES = " UNION ALL ".join(f"SELECT doc_id AS row, lang AS true_lang, '{x}' AS l, {k} AS k, {_SCORE.format(k=k, l=x)} AS p FROM documents" for k, x in enumerate(_LANGS))
_BEST = f"s AS ({_SCORES}), best AS (SELECT row, true_lang, l AS pred, p AS prob FROM s QUALIFY row_number() OVER (PARTITION BY row ORDER BY p DESC, k) = 1)"
_NARROW = f"nb AS (SELECT row, true_lang, l AS pred FROM s WHERE l IN ('en', 'fr', 'hi') QUALIFY row_number() OVER (PARTITION BY row ORDER BY p DESC, k) = 1)"


def scored(spark, d):
    m = F.create_map(*(x for k, lang in enumerate(_LANGS) for x in (F.lit(lang), F.expr(_SCORE.format(k=k, l=lang)))))
    return docs(spark, d).select(F.col("doc_id").alias("row"), F.col("lang").alias("true_lang"), m.alias("scores"), F.lit(None).cast("string").alias("error"))


@query(f"WITH {_BEST} SELECT true_lang, count(*) FILTER (pred = true_lang) AS correct, count(*) AS total FROM best GROUP BY true_lang")
def a5_accuracy_by_language(spark, d):
    return I.by_language(I.valid(scored(spark, d)))


@query(f"""WITH {_BEST}, {_NARROW} SELECT 'free' AS policy, round(avg(CASE WHEN pred = true_lang THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n, 0 AS excluded_langs, 0 AS excluded_rows FROM best
 UNION ALL SELECT 'narrow', round(avg(CASE WHEN pred = true_lang THEN 1.0 ELSE 0 END), 6), count(*), count(DISTINCT true_lang) FILTER (true_lang NOT IN ('en', 'fr', 'hi')), count(*) FILTER (true_lang NOT IN ('en', 'fr', 'hi')) FROM nb""")
def a6_policy_comparison(spark, d):
    return I.compare(I.valid(scored(spark, d)), {"free": None, "narrow": ["en", "fr", "hi"]})


@query(f"""WITH {_BEST}, {_NARROW}, f AS (SELECT true_lang, avg(CASE WHEN pred = true_lang THEN 1.0 ELSE 0 END) AS free FROM best GROUP BY 1), n AS (SELECT true_lang, avg(CASE WHEN pred = true_lang THEN 1.0 ELSE 0 END) AS narrow FROM nb GROUP BY 1)
 SELECT f.true_lang AS true_lang, round(free, 6) AS free, round(narrow, 6) AS narrow, CASE WHEN narrow - free < -0.005 THEN 'worse' WHEN narrow - free > 0.005 THEN 'better' ELSE '' END AS flag FROM f JOIN n ON f.true_lang = n.true_lang""")
def a7_policy_deltas(spark, d):
    return I.deltas(I.valid(scored(spark, d)), ["en", "fr", "hi"])


@query(f"WITH {_BEST} SELECT true_lang AS truth, pred, count(*) AS n FROM best WHERE pred <> true_lang GROUP BY 1, 2 ORDER BY n DESC, truth, pred LIMIT 8")
def a8_top_confusions(spark, d):
    return I.confusions(I.valid(scored(spark, d)), 8)


@query(f"""WITH {_BEST}, p AS (SELECT unnest(['en', 'de']) AS a, unnest(['fr', 'es']) AS b) SELECT a, b, (SELECT count(*) FROM best WHERE true_lang = a AND pred = b) AS a_to_b, (SELECT count(*) FROM best WHERE true_lang = a) AS a_total,
 (SELECT count(*) FROM best WHERE true_lang = b AND pred = a) AS b_to_a, (SELECT count(*) FROM best WHERE true_lang = b) AS b_total FROM p""")
def a9_near_pairs(spark, d):
    return I.near_pairs(I.valid(scored(spark, d)), [("en", "fr"), ("de", "es")])


@query(f"""WITH {_BEST}, t AS (SELECT unnest([0.0, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 0.999]) AS threshold),
 c AS (SELECT threshold, count(*) FILTER (prob >= threshold) AS answered, count(*) FILTER (prob >= threshold AND pred = true_lang) AS r, count(*) AS total FROM t, best GROUP BY threshold)
 SELECT CAST(threshold AS DOUBLE) AS threshold, answered, round(answered / total, 6) AS coverage, CASE WHEN answered > 0 THEN round(r / answered, 6) ELSE 0 END AS accuracy_answered, round(r / total, 6) AS accuracy_overall FROM c""")
def a10_abstention_curve(spark, d):
    return I.abstention(I.valid(scored(spark, d)))


@query(f"""WITH s AS ({_SCORES}), v AS (SELECT row % 50 AS row, l AS lang, round(sum(p), 9) AS p FROM s GROUP BY 1, 2), n AS (SELECT doc_id % 50 AS row, count(*) AS n FROM documents GROUP BY 1)
 SELECT v.row AS row, row_number() OVER (PARTITION BY v.row ORDER BY p DESC, lang) AS rank, lang, round(p / n, 6) AS prob FROM v JOIN n ON v.row = n.row QUALIFY rank <= 3""")
def a18_probe_votes(spark, d):
    return I.votes(scored(spark, d).withColumn("row", F.col("row") % 50), 3)


@query(f"""WITH s AS ({_SCORES}), k AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY p DESC, l) AS r FROM s) SELECT row, l AS lang, round(p, 6) AS p FROM k WHERE r <= 2 OR l = 'hi'""")
def o3_top_scores(spark, d):
    out = scored(spark, d).select("row", F.explode(A.top_scores(F.col("scores"), 2, ["hi"])).alias("lang", "p"))
    return out.select("row", "lang", F.round("p", 6).alias("p"))


@query(f"WITH s AS ({_SCORES}) SELECT row, l AS lang, p AS prob FROM s WHERE l IN ('de', 'es') QUALIFY row_number() OVER (PARTITION BY row ORDER BY p DESC, k) = 1")
def o4_best_candidate(spark, d):
    """The best of a candidate set (f17: other map operations are in a18 and o3)."""
    return scored(spark, d).select("row", A.best_of(F.col("scores"), ["de", "es"]).alias("b")).select("row", F.col("b.key").alias("lang"), F.col("b.score").alias("prob"))


@query("SELECT doc_id, list_sort(list_distinct(list_transform(range(1, 6), lambda i: least(n_chars - 1, CAST(floor(n_chars / 6.0 * i) AS INTEGER))))) AS probes FROM documents WHERE n_chars > 0 AND n_chars >= 12")
def o7_probe_indices(spark, d):
    return docs(spark, d).where("n_chars >= 12").select("doc_id", A.probe_indices(F.col("n_chars"), 5).alias("probes"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS best, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS last FROM events)
 SELECT event_type, event_id, best = 1 AS is_best, last = 1 AS is_last FROM e WHERE best = 1 OR last = 1""")
def o9_best_and_last(spark, d):
    e = table(spark, d, "events")
    best = F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best")
    by = e.groupBy("event_type").agg(best, F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))
    kept = by.select("event_type", "best", "last", F.explode(F.array_distinct(F.array("best", "last"))).alias("event_id"))
    return kept.select("event_type", "event_id", (F.col("event_id") == F.col("best")).alias("is_best"), (F.col("event_id") == F.col("last")).alias("is_last"))
