"""Language-identification reports over rows (row, true_lang, scores map, error)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.arrays import best_of

THRESHOLDS = [0.0, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 0.999]


def valid(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NULL AND size(scores) > 0")


def predicted(rows: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """Adds pred, prob and hit under a policy; only rows with a known truth stay."""
    out = rows.where("true_lang IS NOT NULL AND true_lang <> ''").withColumn("best", best_of(F.col("scores"), candidates))
    out = out.withColumns({"pred": F.col("best.key"), "prob": F.col("best.score")}).drop("best")
    reachable = F.lit(True) if candidates is None else F.col("true_lang").isin(*candidates)
    return out.withColumn("hit", reachable & F.col("pred").eqNullSafe(F.col("true_lang")))


def by_language(rows: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """(true_lang, correct, total): truths beyond the policy count as misses."""
    return predicted(rows, candidates).groupBy("true_lang").agg(F.count_if("hit").alias("correct"), F.count(F.lit(1)).alias("total"))


def compare(rows: DataFrame, policies: dict[str, list[str] | None]) -> DataFrame:
    """(policy, accuracy, n, excluded_langs, excluded_rows) of each policy."""
    out = None
    for name, candidates in policies.items():
        by = by_language(rows, candidates)
        gone = F.lit(False) if candidates is None else ~F.col("true_lang").isin(*candidates)
        one = by.agg(
            F.round(F.sum("correct") / F.sum("total"), 6).alias("accuracy"), F.sum("total").alias("n"),
            F.count_if(gone).alias("excluded_langs"), F.coalesce(F.sum(F.when(gone, F.col("total"))), F.lit(0)).alias("excluded_rows"),
        ).select(F.lit(name).alias("policy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def deltas(rows: DataFrame, candidates: list[str]) -> DataFrame:
    """Accuracy by language without and with a policy, and which is better by over 0.005."""
    rate = lambda df, name: df.select("true_lang", (F.col("correct") / F.col("total")).alias(name))
    both = rate(by_language(rows), "free").join(rate(by_language(rows, candidates), "narrow"), "true_lang", "full")
    delta = F.col("narrow") - F.col("free")
    flag = F.when(delta < -0.005, "worse").when(delta > 0.005, "better").otherwise("")
    return both.select("true_lang", F.round("free", 6).alias("free"), F.round("narrow", 6).alias("narrow"), flag.alias("flag"))


def confusions(rows: DataFrame, top: int | None = None) -> DataFrame:
    """(truth, pred, n) of wrong rows, the most frequent first, of equals by name."""
    wrong = predicted(rows).where("NOT hit")
    out = wrong.groupBy(F.col("true_lang").alias("truth"), "pred").agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), "truth", "pred").limit(top)


def near_pairs(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, a_to_b, a_total, b_to_a, b_total) of named pairs of languages."""
    names = rows.sparkSession.range(1).select(
        F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))).alias("p")
    ).select("p.*")
    found, totals = confusions(rows), by_language(rows).select("true_lang", "total")
    side = lambda x, y: found.select(F.col("truth").alias(x), F.col("pred").alias(y), F.col("n").alias(f"{x}_to_{y}"))
    total = lambda x: totals.select(F.col("true_lang").alias(x), F.col("total").alias(f"{x}_total"))
    out = names.join(side("a", "b"), ["a", "b"], "left").join(side("b", "a"), ["a", "b"], "left").join(total("a"), "a", "left").join(total("b"), "b", "left")
    return out.na.fill(0).select("a", "b", "a_to_b", "a_total", "b_to_a", "b_total")


def abstention(rows: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, answered, coverage, accuracy_answered, accuracy_overall)."""
    p = predicted(rows)
    cuts = THRESHOLDS if thresholds is None else thresholds
    # One aggregation for all thresholds, then one row for each.
    sums = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("prob") >= t).alias("answered"), F.count_if((F.col("prob") >= t) & F.col("hit")).alias("right")) for t in cuts]
    one = p.agg(F.count(F.lit(1)).alias("total"), F.array(*sums).alias("cuts")).select("total", F.explode("cuts").alias("c")).select("total", "c.*")
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return one.select(
        "threshold", "answered", share("answered", "total").alias("coverage"), share("right", "answered").alias("accuracy_answered"), share("right", "total").alias("accuracy_overall")
    )


def votes(probes: DataFrame, k: int = 5) -> DataFrame:
    """(row, rank, lang, prob): mean probability over probes (row, probe, scores), the k highest (a18)."""
    from pyspark.sql import Window

    n = probes.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    sums = probes.select("row", F.explode("scores").alias("lang", "p")).groupBy("row", "lang").agg(F.round(F.sum("p"), 9).alias("p"))
    w = Window.partitionBy("row").orderBy(F.desc("p"), "lang")
    out = sums.join(n, "row").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("row", F.col("rank").cast("long").alias("rank"), "lang", F.round(F.col("p") / F.col("n"), 6).alias("prob"))
