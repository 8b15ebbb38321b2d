"""Queries over page blocks, whose boxes are arithmetic on lineitem's keys.

Coordinates are multiples of 1/64, so their geometry is exact in doubles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import boxes as B
from lodestone.operators import layout as L
from lodestone.plans.files import scratch
from lodestone.plans.registry import query, table

_X0, _Y0 = "CAST(l_partkey % 48 AS DOUBLE) / 64", "CAST(l_suppkey * 7 % 48 AS DOUBLE) / 64"
_W, _H = "CAST(l_partkey % 13 + 3 AS DOUBLE) / 64", "CAST(l_suppkey % 11 + 3 AS DOUBLE) / 64"
_SHIFT = "CAST(CAST(l_quantity AS INTEGER) % 3 AS DOUBLE) / 64"
_LABELS = ["Paragraph", "Header", "Equation", "Footer", "Table", "Diagram", "Page-number", "Title", "Image-caption", "Expression"]
_LABEL = "CASE CAST(l_partkey % 10 AS INTEGER) " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LABELS)) + " END"
_COLUMNS = f"l_orderkey AS page_id, l_linenumber AS idx, {_LABEL} AS label, CAST(l_partkey % 5 AS INTEGER) AS cls, l_quantity AS score"
_TRUE = f"SELECT {_COLUMNS}, {_X0} AS x0, {_Y0} AS y0, {_X0} + {_W} AS x1, {_Y0} + {_H} AS y1 FROM lines"
_PRED = f"SELECT {_COLUMNS}, {_X0} + {_SHIFT} AS x0, {_Y0} AS y0, {_X0} + {_W} + {_SHIFT} AS x1, {_Y0} + {_H} AS y1 FROM lines"
# Pages of several lines: line numbers may repeat in an order, so they are counted anew.
_LINES = """lines AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, CAST(row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS l_linenumber FROM lineitem)"""
_CTE = f"{_LINES}, truth AS ({_TRUE}), pred AS ({_PRED})"

_OV = "(greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
_AREA = "((({0}.x1 - {0}.x0)) * ({0}.y1 - {0}.y0))"
_IOU = f"({_OV} / ({_AREA.format('a')} + {_AREA.format('b')} - {_OV}))"


# Rows of boxes from top to bottom: each box is held against its row's first one.
_RASTER = f"""WITH RECURSIVE {_CTE}, c AS (SELECT page_id, idx, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY page_id ORDER BY (y0 + y1) / 2, (x0 + x1) / 2, idx) AS k FROM truth),
 w AS (SELECT page_id, idx, cx, cy, k, cy AS anchor, 0 AS line FROM c WHERE k = 1 UNION ALL
  SELECT c.page_id, c.idx, c.cx, c.cy, c.k, CASE WHEN abs(c.cy - anchor) > 0.02 THEN c.cy ELSE anchor END, line + CAST(abs(c.cy - anchor) > 0.02 AS INTEGER) FROM w JOIN c ON c.page_id = w.page_id AND c.k = w.k + 1),
 raster AS (SELECT page_id, idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line, cx, cy, idx) - 1 AS INTEGER) AS raster FROM w)"""

# Claims at a threshold: predictions of a page in turn, each with its candidates by falling overlap.
_THRESHOLDS = ", ".join(f"CAST('{t!r}' AS DOUBLE)" for t in L.THRESHOLDS)
_MATCHED = f"""WITH RECURSIVE {_CTE}, s AS (SELECT a.page_id, a.idx, list({{'iou': -{_IOU}, 'g': b.idx}} ORDER BY {_IOU} DESC, b.idx) AS cand FROM pred a JOIN truth b ON a.page_id = b.page_id AND a.cls = b.cls AND {_IOU} >= 0.5 GROUP BY 1, 2),
 q AS (SELECT p.page_id, p.idx, p.cls, p.score, coalesce(cand, []) AS cand, row_number() OVER (PARTITION BY p.page_id ORDER BY p.score DESC, p.idx) AS k FROM pred p LEFT JOIN s ON s.page_id = p.page_id AND s.idx = p.idx),
 th AS (SELECT unnest([{_THRESHOLDS}]) AS th, unnest(range(10)) AS t),
 m AS (SELECT page_id, 0::BIGINT AS idx, t, th, 0::BIGINT AS k, []::INTEGER[] AS taken, NULL::INTEGER AS g FROM (SELECT DISTINCT page_id FROM q), th UNION ALL
  SELECT page_id, idx, t, th, k, CASE WHEN g IS NULL THEN taken ELSE list_append(taken, g) END, g FROM (SELECT q.page_id, q.idx::BIGINT AS idx, m.t, m.th, q.k, m.taken,
   list_filter(q.cand, lambda c: -c.iou >= m.th AND NOT list_contains(m.taken, c.g))[1].g AS g FROM m JOIN q ON q.page_id = m.page_id AND q.k = m.k + 1)),
 hits AS (SELECT q.page_id, q.idx, q.cls, q.score, m.t, m.g IS NOT NULL AS hit FROM m JOIN q ON q.page_id = m.page_id AND q.k = m.k)"""
# The precision curve as points, its envelope from the right, and straight lines between points on 101 places of recall.
_PRECISION = f"""{_MATCHED}, n AS (SELECT cls, count(*) AS n FROM truth GROUP BY cls),
 r AS (SELECT h.cls, t, n, row_number() OVER w AS rank, sum(CAST(hit AS INTEGER)) OVER w AS tp FROM hits h JOIN n ON n.cls = h.cls WINDOW w AS (PARTITION BY h.cls, t ORDER BY score DESC, page_id, idx ROWS UNBOUNDED PRECEDING)),
 ends AS (SELECT cls, t, n, max(rank) AS shown, max(tp) AS found FROM r GROUP BY 1, 2, 3),
 pts AS (SELECT cls, t, rank, tp / n AS r, tp / rank AS p FROM r UNION ALL SELECT cls, t, 0, 0.0, 1.0 FROM ends UNION ALL SELECT cls, t, shown + 1, found / n + 0.001, 0.0 FROM ends),
 env AS (SELECT cls, t, rank, r, max(p) OVER (PARTITION BY cls, t ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p, lead(r) OVER (PARTITION BY cls, t ORDER BY rank) AS r2 FROM pts),
 run AS (SELECT *, lead(p) OVER (PARTITION BY cls, t ORDER BY rank) AS p2 FROM env),
 corner AS (SELECT cls, t, r, r2, p, p2 FROM run WHERE r2 IS NULL OR r2 > r),
 gr AS (SELECT cls, t, unnest(range(101)) AS g, unnest(range(101)) / 100.0::DOUBLE + 1e-12 AS x FROM ends),
 ap AS (SELECT gr.cls, gr.t, avg(CASE WHEN r2 IS NULL THEN 0.0 ELSE p + (p2 - p) * (x - r) / (r2 - r) END) AS ap FROM gr ASOF JOIN corner c ON c.cls = gr.cls AND c.t = gr.t AND gr.x >= c.r GROUP BY 1, 2),
 by_class AS (SELECT n.cls, n.n, coalesce(max(ap) FILTER (ap.t = 0), 0.0) AS ap50, coalesce(avg(ap), 0.0) AS ap, max(found / shown) FILTER (ap.t = 0) AS precision, max(found / ends.n) FILTER (ap.t = 0) AS recall
  FROM n LEFT JOIN ap ON ap.cls = n.cls LEFT JOIN ends ON ends.cls = ap.cls AND ends.t = ap.t GROUP BY 1, 2)"""


_PIXELS = ", ".join(f"round_even({f}, 1) AS {e}" for e, f in {"x0": "greatest(0.0, x0 / 1000 * 1200)", "y0": "greatest(0.0, y0 / 1000 * 1600)", "x1": "least(1200.0, x1 / 1000 * 1200)", "y1": "least(1600.0, y1 / 1000 * 1600)"}.items())


def _clean_sql(source: str) -> str:
    """Kept blocks of ``source``: largest first, of a group the ones that no kept one holds; then one header and one footer."""
    reads = "{0}.label NOT IN ('Header', 'Footer', 'Diagram', 'Image', 'Chart', 'Advertisement')"
    kind = "CASE WHEN label IN ('Header', 'Footer') THEN label WHEN label IN ('Page-number', 'Folio') THEN 'margin' ELSE 'body' END"
    return f"""WITH RECURSIVE {_LINES}, b AS (SELECT *, {kind} AS kind, greatest(0.0, x1 - x0) * greatest(0.0, y1 - y0) AS size FROM ({source})),
 h AS (SELECT a.page_id, a.idx AS i, b.idx AS j, a.label <> b.label AS other, a.kind = b.kind AND ({reads.format('b')} OR NOT ({reads.format('a')})) AS may,
  CASE WHEN a.size > 0 THEN greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / a.size ELSE 0.0 END AS share FROM b a JOIN b ON a.page_id = b.page_id),
 s AS (SELECT page_id, i, list(j) AS over FROM h WHERE may AND share >= 0.8 GROUP BY 1, 2),
 o AS (SELECT b.page_id, b.idx, kind, coalesce(over, []) AS over, row_number() OVER (PARTITION BY b.page_id, kind ORDER BY size DESC, b.idx) AS k FROM b LEFT JOIN s ON s.page_id = b.page_id AND s.i = b.idx WHERE kind IN ('body', 'margin')),
 w AS (SELECT DISTINCT page_id, kind, 0::BIGINT AS k, []::INTEGER[] AS kept FROM o UNION ALL
  SELECT o.page_id, o.kind, o.k, CASE WHEN list_has_any(w.kept, o.over) THEN w.kept ELSE list_append(w.kept, o.idx) END FROM w JOIN o ON o.page_id = w.page_id AND o.kind = w.kind AND o.k = w.k + 1),
 l AS (SELECT page_id, idx, label FROM b WHERE kind IN ('Header', 'Footer') QUALIFY row_number() OVER (PARTITION BY page_id, label ORDER BY size DESC, idx) = 1),
 kept AS (SELECT o.page_id, o.idx FROM o JOIN w ON w.page_id = o.page_id AND w.kind = o.kind AND w.k = o.k WHERE list_contains(w.kept, o.idx)
  UNION ALL SELECT l.page_id, l.idx FROM l WHERE EXISTS (SELECT 1 FROM h WHERE h.page_id = l.page_id AND h.j = l.idx AND h.other AND share >= 0.5)),
 c AS (SELECT b.* FROM b JOIN kept ON kept.page_id = b.page_id AND kept.idx = b.idx)"""


def _boxes(spark, d, sql):
    lines = _LINES.replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(f"WITH {lines} {sql}", lineitem=table(spark, d, "lineitem"))


def truth(spark, d):
    return _boxes(spark, d, _TRUE)


def pred(spark, d):
    return _boxes(spark, d, _PRED)


@query(f"WITH {_CTE} SELECT a.page_id AS page_id, a.idx AS p, b.idx AS g, round({_IOU}, 9) AS iou FROM pred a JOIN truth b ON a.page_id = b.page_id WHERE {_IOU} >= 0.1")
def j6_iou_pairs(spark, d):
    out = L.iou_pairs(pred(spark, d), truth(spark, d), 0.1)
    return out.select("page_id", F.col("a_idx").alias("p"), F.col("b_idx").alias("g"), F.round("iou", 9).alias("iou"))


@query(f"WITH {_CTE} SELECT page_id, idx, round((x1 - x0) * (y1 - y0), 9) AS area, greatest(0.0, x0 - 0.25) AS cx0, least(0.5, x1) AS cx1 FROM truth")
def f2_area_and_clamp(spark, d):
    moved = (F.col("x0") - 0.25, F.col("y0"), F.col("x1"), F.col("y1"))
    c = B.clamped(moved, F.lit(0.5), F.lit(1.0))
    return truth(spark, d).select("page_id", "idx", F.round(B.area(B.of()), 9).alias("area"), c[0].alias("cx0"), c[2].alias("cx1"))


@query(f"WITH {_CTE} SELECT page_id, idx, x0, y0, x1, y1 FROM truth")
def f3_centre_to_edges(spark, d):
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    edges = B.from_centre(cx, cy, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return truth(spark, d).select("page_id", "idx", *(c.alias(e) for c, e in zip(edges, B.EDGES, strict=True)))


@query(f"""WITH {_CTE}, r AS (SELECT page_id, idx, floor(y0 * 1000) / 1000 AS y0, floor(x0 * 1000) / 1000 AS x0, CASE WHEN idx % 5 = 4 THEN NULL ELSE floor(y1 * 1000) / 1000 END AS y1, floor(x1 * 1000) / 1000 AS x1 FROM truth),
 c AS (SELECT *, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM r WHERE y1 IS NOT NULL AND x1 - x0 > 0.001 AND y1 - y0 > 0.001)
 SELECT r.page_id AS page_id, r.idx AS idx, CASE WHEN mx IS NOT NULL THEN round(least(greatest(mx, 0.0001), 0.9999), 6) END AS cx, CASE WHEN mx IS NOT NULL THEN round(least(greatest(my, 0.0001), 0.9999), 6) END AS cy,
 round(least(c.x1 - c.x0, 2 * least(mx, 1 - mx)), 6) AS w, round(least(c.y1 - c.y0, 2 * least(my, 1 - my)), 6) AS h FROM r LEFT JOIN c ON r.page_id = c.page_id AND r.idx = c.idx""")
def pf12_normalised_boxes(spark, d):
    milli = lambda c: F.floor(F.col(c) * 1000).cast("string")
    bad = F.when(F.col("idx") % 5 == 4, F.lit("x")).otherwise(milli("y1"))
    box = B.box_of(F.array(milli("y0"), milli("x0"), bad, milli("x1")))
    return truth(spark, d).select("page_id", "idx", *(F.round(box[k], 6).alias(k) for k in ("cx", "cy", "w", "h")))


@query(f"""WITH {_CTE} SELECT page_id, idx, CASE label WHEN 'Header' THEN 'PageHeader' WHEN 'Footer' THEN 'PageFooter' WHEN 'Equation' THEN 'Equation' WHEN 'Expression' THEN 'Equation'
 WHEN 'Table' THEN 'Table' WHEN 'Diagram' THEN 'Figure' WHEN 'Page-number' THEN 'PageNumber' WHEN 'Title' THEN 'Title' WHEN 'Image-caption' THEN 'Caption' ELSE 'Text' END AS type,
 label NOT IN ('Header', 'Footer', 'Diagram') AS transcribed FROM truth""")
def pf11_label_types(spark, d):
    return truth(spark, d).select("page_id", "idx", B.type_of(F.col("label")).alias("type"), B.transcribed(F.col("label")).alias("transcribed"))


@query(f"""WITH {_CTE}, c AS (SELECT page_id, idx, greatest(1.0, round_even(x1 * 640, 0) - round_even(x0 * 640, 0)) AS w, greatest(1.0, round_even(y1 * 640, 0) - round_even(y0 * 640, 0)) AS h FROM truth),
 s AS (SELECT *, CASE WHEN w * h > 9000 THEN sqrt(9000 / (w * h)) WHEN w * h < 3000 THEN sqrt(3000 / (w * h)) ELSE 1.0 END AS k FROM c)
 SELECT page_id, idx, CAST(greatest(1, round_even(w * k, 0)) AS INTEGER) AS w, CAST(greatest(1, round_even(h * k, 0)) AS INTEGER) AS h FROM s""")
def pf14_crop_sizes(spark, d):
    scaled = tuple(F.col(e) * 640 for e in B.EDGES)
    w, h = B.crop(scaled, F.lit(640.0), F.lit(640.0), 3000, 9000)
    return truth(spark, d).select("page_id", "idx", w.alias("w"), h.alias("h"))


@query(f"""WITH {_CTE} SELECT page_id, label, idx FROM truth WHERE label IN ('Header', 'Footer')
 QUALIFY row_number() OVER (PARTITION BY page_id, label ORDER BY (x1 - x0) * (y1 - y0) DESC, idx) = 1""")
def g2_largest_margins(spark, d):
    return L.largest_margins(truth(spark, d))


@query(f"""WITH {_CTE} SELECT DISTINCT b.page_id AS page_id, b.idx AS idx, b.label AS label FROM truth b JOIN truth a ON a.page_id = b.page_id
 WHERE b.label IN ('Header', 'Footer') AND a.label <> b.label AND {_OV} / {_AREA.format('a')} >= 0.5""")
def g3_wrapping_margins(spark, d):
    """Headers and footers that hold half of another block (j10)."""
    margins = truth(spark, d).where("label IN ('Header', 'Footer')")
    return L.wrapping_margins(margins, truth(spark, d)).select("page_id", "idx", "label")


@query(f"{_clean_sql(_TRUE)} SELECT page_id, idx, label FROM c")
def g4_clean_layout(spark, d):
    return L.clean(truth(spark, d)).select("page_id", "idx", "label")


@query(f"""WITH {_CTE}, t AS (SELECT *, CASE WHEN label IN ('Equation', 'Expression') THEN 'Equation' WHEN label IN ('Paragraph', 'Title', 'Image-caption') THEN 'Text' ELSE 'Other' END AS type FROM truth)
 SELECT page_id, idx, label FROM truth x WHERE NOT EXISTS (SELECT 1 FROM t a JOIN t b ON a.page_id = b.page_id AND a.idx <> b.idx
 WHERE a.page_id = x.page_id AND a.idx = x.idx AND a.type = 'Equation' AND b.type IN ('Equation', 'Text')
 AND {_OV} / {_AREA.format('a')} >= 0.6 AND {_AREA.format('a')} < 0.95 * {_AREA.format('b')})""")
def g5_nested_equations(spark, d):
    """Equations inside text or other equations go (j11)."""
    return L.without_nested_equations(truth(spark, d), "both", 0.6).select("page_id", "idx", "label")


_RAW = f"SELECT page_id, idx, label, score, {_PIXELS} FROM (SELECT page_id, idx, label, score, floor(x0 * 1000) AS x0, floor(y0 * 1000) AS y0, floor(x1 * 1000) AS x1, floor(y1 * 1000) AS y1 FROM ({_TRUE}))"


@query(f"""{_clean_sql(_RAW)} SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY score, idx) - 1 AS "order", x0, y0, x1, y1 FROM c""")
def g6_postprocessed_detections(spark, d):
    raw = truth(spark, d).withColumns({e: F.floor(F.col(e) * 1000) for e in B.EDGES} | {"width": F.lit(1200), "height": F.lit(1600), "order": F.col("score")})
    return L.postprocessed(raw).select("page_id", "idx", "order", *B.EDGES)


@query(f"""WITH {_CTE} SELECT page_id, idx, label NOT IN ('Header', 'Footer', 'Diagram') AS asked,
 CASE WHEN label IN ('Header', 'Footer', 'Diagram') THEN '' END AS text, CASE WHEN label IN ('Header', 'Footer', 'Diagram') THEN NULL WHEN label = 'Table' THEN 'table' ELSE 'text' END AS prompt
 FROM truth WHERE label NOT IN ('Equation', 'Expression')""")
def g7_transcription_requests(spark, d):
    blocks = truth(spark, d).where("label NOT IN ('Equation', 'Expression')")
    return L.requests(blocks).select("page_id", "idx", "asked", "text", "prompt")


@query(f"WITH {_CTE} SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY score, idx) - 1 AS \"order\" FROM truth")
def w3_renumbered(spark, d):
    out = L.renumbered(truth(spark, d).withColumn("order", F.col("score")))
    return out.select("page_id", "idx", F.col("order").cast("long").alias("order"))


@query(f"WITH {_CTE} SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY y0, idx) - 1 AS rank FROM truth")
def w4_distinct_ranks(spark, d):
    return L.ranks(truth(spark, d), "y0", "rank").select("page_id", "idx", F.col("rank").cast("long").alias("rank"))


@query(f"{_RASTER} SELECT page_id, idx, raster FROM raster")
def w5_raster_order(spark, d):
    return L.raster_ranks(truth(spark, d).withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2}))


_METRIC = f"""WITH {_CTE}, r AS (SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY y0, idx) AS t, row_number() OVER (PARTITION BY page_id ORDER BY score, idx) AS p FROM truth),
 q AS (SELECT a.page_id, sign(a.p - b.p) AS dp, sign(a.t - b.t) AS dt FROM r a JOIN r b ON a.page_id = b.page_id AND a.idx < b.idx),
 s AS (SELECT page_id, sum(dp * dt) / sqrt(sum(dp * dp) * sum(dt * dt)) AS tau, sum(CASE WHEN (dp < 0) = (dt < 0) THEN 1 ELSE 0 END) / count(*) AS pairwise FROM q GROUP BY page_id)
 SELECT p.page_id AS page_id, round(coalesce(tau, 0.0), 9) AS tau, round(coalesce(pairwise, 1.0), 9) AS pairwise FROM (SELECT DISTINCT page_id FROM truth) p LEFT JOIN s ON p.page_id = s.page_id"""


@query(_METRIC)
def w6_tau_and_pairwise(spark, d):
    """Kendall's tau-b and pairwise accuracy of ranks (w7)."""
    out = L.pair_metrics(L.ranks(L.ranks(truth(spark, d), "y0", "t"), "score", "p"), "p", "t")
    return out.select("page_id", F.round("tau", 9).alias("tau"), F.round("pairwise", 9).alias("pairwise"))


# Ranks as letters, so that the distance of two orders is that of two words.
_WORDS = f"""o AS (SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY y0, idx) AS t, row_number() OVER (PARTITION BY page_id ORDER BY score, idx) AS p FROM truth),
 ned AS (SELECT page_id, levenshtein(string_agg(chr(CAST(64 + p AS INTEGER)), '' ORDER BY idx), string_agg(chr(CAST(64 + t AS INTEGER)), '' ORDER BY idx)) / count(*) AS ned, count(*) AS n FROM o GROUP BY page_id)"""


@query(f"WITH {_CTE}, {_WORDS} SELECT page_id, round(ned, 9) AS ned FROM ned")
def w8_sequence_distance(spark, d):
    r = L.ranks(L.ranks(truth(spark, d), "y0", "t"), "score", "p")
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("idx", c))), lambda x: x[c])
    out = r.groupBy("page_id").agg(by("p").alias("p"), by("t").alias("t"))
    return out.select("page_id", F.round(L.sequence_distance(F.col("p"), F.col("t")), 9).alias("ned"))


@query(f"{_MATCHED} SELECT page_id, idx, cls, score, CAST(count(*) FILTER (hit) AS INTEGER) AS n_hits FROM hits GROUP BY 1, 2, 3, 4")
def j7_greedy_matches(spark, d):
    out = L.matched(pred(spark, d), truth(spark, d))
    return out.select("page_id", "idx", "cls", "score", F.aggregate("hits", F.lit(0), lambda n, h: n + h.cast("int")).alias("n_hits"))


@query(f"""WITH {_CTE}, m AS (SELECT a.page_id, a.idx AS p, b.idx AS g, {_IOU} AS iou FROM pred a JOIN truth b ON a.page_id = b.page_id WHERE {_IOU} >= 0.5),
 f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id, p ORDER BY iou DESC, g) = 1)
 SELECT page_id, p, g FROM f QUALIFY row_number() OVER (PARTITION BY page_id, g ORDER BY iou DESC, p) = 1""")
def j8_order_matches(spark, d):
    return L.order_matches(pred(spark, d), truth(spark, d)).select("page_id", F.col("a_idx").alias("p"), F.col("b_idx").alias("g"))


@query(f"{_PRECISION} SELECT cls, n, round(ap50, 6) AS ap50, round(ap, 6) AS ap, round(precision, 6) AS precision, round(recall, 6) AS recall FROM by_class")
def a16_average_precision(spark, d):
    by = L.average_precision(L.matched(pred(spark, d), truth(spark, d)), truth(spark, d), scratch(spark))
    return by.select("cls", "n", *(F.round(c, 6).alias(c) for c in ("ap50", "ap", "precision", "recall")))


@query(f"{_PRECISION} SELECT round(avg(ap50), 6) AS map50, round(avg(ap), 6) AS map, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM by_class")
def a16_detection_summary(spark, d):
    by = L.average_precision(L.matched(pred(spark, d), truth(spark, d)), truth(spark, d), scratch(spark))
    out = L.detection_summary(by)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


_TAU = """SELECT page_id, coalesce(sum(dp * dt) / nullif(sqrt(sum(dp * dp) * sum(dt * dt)), 0), 0.0) AS tau, CASE WHEN count(dt) > 0 THEN sum(CASE WHEN (dp < 0) = (dt < 0) THEN 1 ELSE 0 END) / count(*) ELSE 1.0 END AS pairwise
  FROM (SELECT a.page_id, sign(a.{0} - b.{0}) AS dp, sign(a.t - b.t) AS dt FROM z a JOIN z b ON a.page_id = b.page_id AND a.idx < b.idx) GROUP BY page_id"""


@query(f"""{_RASTER}, {_WORDS}, z AS (SELECT o.*, raster FROM o JOIN raster ON raster.page_id = o.page_id AND raster.idx = o.idx), m AS ({_TAU.format("p")}), mr AS ({_TAU.format("raster")}),
 g AS (SELECT m.tau, m.pairwise, mr.tau AS tau_raster, ned, mr.tau < 0.999 AS hard FROM m JOIN mr ON mr.page_id = m.page_id JOIN ned ON ned.page_id = m.page_id WHERE n > 1)
 SELECT count(*) AS order_pages, count(*) FILTER (hard) AS hard_pages, round(avg(tau), 6) AS tau_model, round(avg(tau_raster), 6) AS tau_raster, round(avg(ned), 6) AS ned_model, round(avg(pairwise), 6) AS pairwise,
 round(coalesce(avg(tau) FILTER (hard), 0.0), 6) AS tau_model_hard, round(coalesce(avg(tau_raster) FILTER (hard), 0.0), 6) AS tau_raster_hard, round(coalesce(avg(pairwise) FILTER (hard), 0.0), 6) AS pairwise_hard FROM g""")
def a17_order_summary(spark, d):
    t = truth(spark, d).withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    t = L.ranks(L.ranks(t, "y0", "t"), "score", "p").join(L.raster_ranks(t), ["page_id", "idx"])
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("idx", c))), lambda x: x[c])
    ned = t.groupBy("page_id").agg(by("p").alias("p"), by("t").alias("t")).where(F.size("p") > 1)
    ned = ned.select("page_id", L.sequence_distance(F.col("p"), F.col("t")).alias("ned"))
    raster = L.pair_metrics(t, "raster", "t").select("page_id", F.col("tau").alias("tau_raster"))
    out = L.order_summary(L.pair_metrics(t, "p", "t").join(ned, "page_id").join(raster, "page_id"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"""WITH {_CTE}, v AS (SELECT a.page_id, b.idx, round(sum(1 / (1 + exp(-(a.score - b.score)))), 9) AS votes FROM truth a JOIN truth b ON a.page_id = b.page_id AND a.idx <> b.idx GROUP BY 1, 2)
 SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY votes, idx) - 1 AS position FROM v""")
def f16_reading_order(spark, d):
    row = truth(spark, d).select("page_id", "idx", "score")
    pairs = row.select("page_id", F.col("idx").alias("i"), F.col("score").alias("si")).join(row.select("page_id", F.col("idx").alias("j"), F.col("score").alias("sj")), "page_id")
    out = L.reading_order(pairs.select("page_id", "i", "j", (F.col("si") - F.col("sj")).alias("score")))
    return out.select("page_id", "idx", F.col("position").cast("long").alias("position"))


@query(f"""WITH {_CTE}, p AS (SELECT page_id, idx, score, label, 'word' || lower(label) || ' ' || idx AS t FROM truth WHERE label <> 'Diagram')
 SELECT page_id, string_agg(CASE WHEN label IN ('Equation', 'Expression') THEN '$$' || t || '$$' ELSE t END, chr(10) || chr(10) ORDER BY score, idx) AS markdown FROM p GROUP BY page_id""")
def t11_reconstructed_pages(spark, d):
    blocks = truth(spark, d).withColumns({"order": F.col("score"), "type": B.type_of(F.col("label")), "text": F.concat(F.lit("word-\n  "), F.lower("label"), F.lit(" "), F.col("idx").cast("string"))})
    return L.reconstructed(blocks)


# Coordinates of a header and a footer that every page has, like those of blocks: thousandths, y first.
_STRUCT = "{'cx': least(greatest((x0 + x1) / 2, 0.0001), 0.9999), 'cy': least(greatest((y0 + y1) / 2, 0.0001), 0.9999)}"


@query(f"""WITH {_CTE}, m AS (SELECT page_id, idx, list_position({B.CLASSES!r}, label) - 1 AS cls, CASE WHEN idx % 2 = 0 THEN idx * 10 END AS given,
  floor(y0 * 1000) / 1000 AS y0, floor(x0 * 1000) / 1000 AS x0, floor(y1 * 1000) / 1000 AS y1, floor(x1 * 1000) / 1000 AS x1 FROM truth),
 ok AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS k FROM m WHERE cls IS NOT NULL AND x1 - x0 > 0.001 AND y1 - y0 > 0.001),
 c AS (SELECT page_id, k, cls, coalesce(given, k + 1) AS ord, {_STRUCT} AS c, x1 - x0 AS w, y1 - y0 AS h FROM ok),
 b AS (SELECT page_id, k, cls, ord, c.cx AS cx, c.cy AS cy, least(w, 2 * least(c.cx, 1 - c.cx)) AS w, least(h, 2 * least(c.cy, 1 - c.cy)) AS h FROM c),
 e AS (SELECT *, cx - w / 2 AS x0, cy - h / 2 AS y0, cx + w / 2 AS x1, cy + h / 2 AS y1 FROM b),
 hd AS (SELECT 0.4 AS cx, 0.02 AS cy, 0.6 AS w, 0.04 AS h, 0.1 AS x0, 0.0 AS y0, 0.7 AS x1, 0.04 AS y1),
 pg AS (SELECT DISTINCT page_id FROM truth), low AS (SELECT page_id, min(ord) AS lo, max(ord) AS hi, count(*) AS n FROM e GROUP BY 1),
 dup AS (SELECT DISTINCT a.page_id FROM e a, hd b WHERE a.cls = list_position({B.CLASSES!r}, 'Header') - 1 AND {_OV} / ({_AREA.format('a')} + {_AREA.format('b')} - {_OV}) > 0.5),
 every AS (SELECT page_id, k AS idx, cls, ord, cx, cy, w, h FROM e UNION ALL
  SELECT pg.page_id, coalesce(n, 0), list_position({B.CLASSES!r}, 'Header') - 1, coalesce(lo, 0) - 1, cx, cy, w, h FROM pg CROSS JOIN hd LEFT JOIN low ON low.page_id = pg.page_id WHERE pg.page_id NOT IN (SELECT page_id FROM dup))
 SELECT page_id, CAST(idx AS INTEGER) AS idx, CAST(cls AS INTEGER) AS cls, CAST(ord AS INTEGER) AS "order", round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM every""")
def g1_page_labels(spark, d):
    milli = lambda *c: F.array(*(F.floor(F.col(x) * 1000).cast("string") for x in c))
    block = F.struct(milli("y0", "x0", "y1", "x1").alias("bbox"), "label", F.when(F.col("idx") % 2 == 0, F.col("idx") * 10).alias("reading_order"))
    pages = truth(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))).alias("content"))
    edge = lambda *v: F.array(*(F.lit(str(x)) for x in v))
    pages = pages.select("page_id", F.transform("content", lambda x: x["b"]).alias("content"), edge(0, 100, 40, 700).alias("header"), edge(960, 0, 1000, 1000).alias("footer"))
    out = L.page_labels(pages, drop_strips=True)
    return out.select("page_id", "idx", "cls", "order", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")))
