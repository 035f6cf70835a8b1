"""Queries over value bands, their evaluation and the classifier's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import bands, classify, evaluate, labels, quality
from ledgerfold.plans.catalog import query
from ledgerfold.plans.frames import AWARDS_SQL, TENDERS_SQL, awards, lines, ordered, table, tenders
from ledgerfold.storage import saved

_T, _A = f"WITH {TENDERS_SQL}", f"WITH {AWARDS_SQL}"
_OK = "ok AS (SELECT *, ln(lakh / security_lakh) AS r FROM awards WHERE lakh / security_lakh BETWEEN 5 AND 300)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return awards(spark, sf_dir)


@query(f"""{_A}, {_OK}, o AS (SELECT median(r) AS overall FROM ok), m AS (SELECT method, median(r) AS by_method FROM ok WHERE method <> '' GROUP BY 1 HAVING count(*) >= 50),
e AS (SELECT pe_id, median(r) AS own, count(*) AS k, arg_min(method, signed_on || '|' || tender_id || '|' || method) AS method FROM ok WHERE pe_id <> '' GROUP BY 1),
s AS (SELECT pe_id, (own * k + coalesce(by_method, overall) * 10) / (k + 10) AS by_entity FROM e LEFT JOIN m USING (method), o),
asked AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN 'new' ELSE CAST(c_nationkey AS VARCHAR) END AS pe_id, CASE WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN 'new' ELSE l_returnflag END AS method FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT a.pe_id, a.method, round(coalesce(by_entity, by_method, overall), 4) AS multiple FROM asked a LEFT JOIN s ON a.pe_id = s.pe_id LEFT JOIN m ON a.method = m.method, o""")
def security_ratio_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiples of known buyers, of new buyers by their method, and of those whose method is new too."""
    rows = saved(_rows(spark, sf_dir).select("pe_id", "method", "lakh", "security_lakh", "signed_on", "tender_id", "line"), "rows")
    first = F.col("line") == 1
    asked = rows.select(F.when(first, "new").otherwise(F.col("pe_id")).alias("pe_id"), F.when(first & (F.col("method") == "N"), "new").otherwise(F.col("method")).alias("method")).distinct()
    return bands.security_multiple(asked, bands.security_fit(rows)).select("pe_id", "method", F.round("multiple", 4).alias("multiple"))


@query(f"""{_A}, {_OK}, d AS (SELECT date_trunc('week', CAST(signed_on AS DATE)) AS week, round(r, 4) AS v FROM ok), k AS (SELECT week, count(*) AS n, median(v) AS own FROM d GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
SELECT strftime(k.week, '%Y-%m-%d') AS week, k.n, round(median(d.v), 4) AS centre, round(k.own - median(d.v), 4) AS miss FROM k JOIN d ON d.week < k.week GROUP BY k.week, k.n, k.own""")
def security_weekly_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = _rows(spark, sf_dir).where(bands.plausible(F.col("lakh"), F.col("security_lakh")))
    return bands.weekly_medians(ok.select(F.col("signed_on").cast("date").alias("signed_on"), F.log(F.col("lakh") / F.col("security_lakh")).alias("r")), 12).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


_PAIRS = "pairs AS (SELECT tender_id, line, part, bidder_id, method, signed_on, lakh / estimate AS ratio FROM awards WHERE read_on < signed_on AND estimate > 0 AND lakh > 0)"


def _plan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's estimate meets the order's lines; without a customer it has none."""
    estimates = ordered(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("tender_id"), F.col("o_totalprice").alias("estimate_bdt"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("read_on"))
    signed = lines(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("tender_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").cast("string").alias("bidder_id"),
        F.col("l_returnflag").alias("method"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("signed_on"), F.col("l_extendedprice").alias("value_bdt"),
    )
    return bands.plan_pairs(estimates, signed)


@query(f"{_A}, {_PAIRS} SELECT tender_id, line, part, bidder_id, method, signed_on, round(ratio, 6) AS ratio FROM pairs")
def plan_pairs_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_pairs(spark, sf_dir).select("tender_id", "line", "part", "bidder_id", "method", "signed_on", F.round("ratio", 6).alias("ratio"))


_QUANT = """round(quantile_cont(r, 0.5), 4) AS centre, round(list_sort(list(r))[1 + CAST(floor(l) AS INT)] * (1 - (l - floor(l))) + list_sort(list(r))[2 + CAST(floor(l) AS INT)] * (l - floor(l)), 4) AS lo,
round(list_sort(list(r))[1 + CAST(floor(h) AS INT)] * (1 - (h - floor(h))) + coalesce(list_sort(list(r))[2 + CAST(floor(h) AS INT)], 0) * (h - floor(h)), 4) AS hi"""


@query(f"""{_A}, {_PAIRS}, g AS (SELECT method, ln(ratio) AS r FROM pairs UNION ALL SELECT NULL, ln(ratio) FROM pairs), s AS (SELECT *, greatest(0.0, 0.1 * (count(*) OVER w + 1.0) / count(*) OVER w) * (count(*) OVER w - 1) AS l, least(1.0, 0.9 * (count(*) OVER w + 1.0) / count(*) OVER w) * (count(*) OVER w - 1) AS h FROM g WINDOW w AS (PARTITION BY method))
SELECT method, n, centre, lo, hi FROM (SELECT method, count(*) AS n, {_QUANT} FROM s GROUP BY method, l, h) WHERE n >= 50 OR method IS NULL""")
def plan_route_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 4).alias(c)
    return bands.plan_fit(_plan_pairs(spark, sf_dir)).select("method", "n", r("centre"), r("lo"), r("hi"))


_BANDED = "SELECT *, lakh AS value, security_lakh * 35 AS q50, security_lakh * 25 AS q10, security_lakh * 48 AS q90 FROM awards"


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("security_lakh")
    return _rows(spark, sf_dir).withColumns({"value": F.col("lakh"), "q50": s * 35, "q10": s * 25, "q90": s * 48})


_FIGURES = "count(*) AS n, round(avg((value BETWEEN q10 AND q90)::INT), 4) AS coverage, round(median(abs(q50 - value) / value), 4) AS mape, round(median(q90 / q10), 3) AS width"


@query(f"{_A} SELECT method, {_FIGURES} FROM ({_BANDED}) GROUP BY 1")
def coverage_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.coverage_by(_banded(spark, sf_dir), ["method"])


@query(f"{_A} SELECT round(sum(lakh * (value BETWEEN q10 AND q90)::INT) / sum(lakh), 4) AS coverage_weighted, count(*) AS n FROM ({_BANDED}) WHERE lakh > 0")
def coverage_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.weighted_coverage(_banded(spark, sf_dir), "lakh")


@query(f"{_A}, b AS ({_BANDED}), e AS (SELECT quantile_cont(q50, [0.2, 0.4, 0.6, 0.8]) AS edges FROM b) SELECT CAST(len(list_filter(edges, lambda x: x <= q50)) AS INT) AS stratum, {_FIGURES} FROM b, e GROUP BY 1 HAVING count(*) >= 30")
def strata_by_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.strata(_banded(spark, sf_dir))


@query(f"""{_A}, b AS ({_BANDED}), d AS (SELECT *, date_diff('day', CAST(read_on AS DATE), CAST(signed_on AS DATE)) AS days FROM b)
SELECT CASE WHEN days < 7 THEN 'under 7' WHEN days < 21 THEN '7 to 21' WHEN days < 45 THEN '21 to 45' ELSE 'over 45' END AS age, {_FIGURES} FROM d GROUP BY 1 HAVING count(*) >= 50""")
def staleness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _banded(spark, sf_dir).withColumn("days", F.datediff(F.col("signed_on").cast("date"), F.col("read_on").cast("date")))
    return evaluate.staleness(rows, "days")


@query(f"""{_A}, s AS (SELECT method, greatest(q10 - value, value - q90) AS score FROM ({_BANDED})), p AS (SELECT method, score, count(*) OVER w AS n, least(1.0, ceil((count(*) OVER w + 1) * 0.8) / count(*) OVER w) * (count(*) OVER w - 1) AS pos, row_number() OVER (PARTITION BY method ORDER BY score) - 1 AS i FROM s WINDOW w AS (PARTITION BY method))
SELECT method, max(n) AS n, round(sum(greatest(0.0, 1 - abs(i - pos)) * score), 2) AS pad FROM p GROUP BY 1""")
def conformal_pad_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _banded(spark, sf_dir).select("method", F.greatest(F.col("q10") - F.col("value"), F.col("value") - F.col("q90")).alias("score"))
    return bands.conformal_pad(b, ["method"]).withColumn("pad", F.round("pad", 2))


@query(f"""{_A} SELECT tender_id, line, part, bidder_id, count(*) OVER w AS history, round((coalesce(sum(lakh) OVER w, 0) + 5 * 30000.0) / (count(*) OVER w + 5) + 1e-6, 2) AS prior FROM awards
WINDOW w AS (PARTITION BY pe_id, method ORDER BY signed_on, tender_id, line, part, bidder_id, lakh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bands.expanding_prior(_rows(spark, sf_dir), ["pe_id", "method"], "lakh", ["signed_on", "tender_id", "line", "part", "bidder_id", "lakh"], 30_000.0)
    return out.select("tender_id", "line", "part", "bidder_id", "history", F.round(F.col("prior") + 1e-6, 2).alias("prior"))


@query(f"""{_T} SELECT tender_id, estimate * CASE b WHEN 'plan' THEN 0.9::DOUBLE WHEN 'security' THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS q10, estimate AS q50, estimate * CASE b WHEN 'plan' THEN 1.1::DOUBLE WHEN 'security' THEN 1.3::DOUBLE ELSE 3.0::DOUBLE END AS q90, b AS basis,
(CASE b WHEN 'history' THEN 3.0 / 0.2 > 12 OR (CAST(pe_id AS INT) % 5 < 3 AND category = '') ELSE false END) AS deferred
FROM (SELECT *, CASE WHEN method = '1-URGENT' THEN 'plan' WHEN method IN ('2-HIGH', '3-MEDIUM') THEN 'security' ELSE 'history' END AS b FROM tenders)""")
def overlay_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenders(spark, sf_dir)
    e = F.col("estimate")
    route = lambda df, lo, hi: df.select("tender_id", (e * lo).alias("q10"), e.alias("q50"), (e * hi).alias("q90"))
    out = bands.routed(t, route(t.where("method in ('1-URGENT', '2-HIGH', '3-MEDIUM')"), 0.8, 1.3), route(t.where("method = '1-URGENT'"), 0.9, 1.1), route(t, 0.2, 3.0))
    named = out.join(t.select("tender_id", "pe_id", "category"), "tender_id")
    later = bands.deferred(F.col("q10"), F.col("q90"), F.pmod(F.col("pe_id").cast("int"), F.lit(5)), F.col("category"), F.col("basis"))
    return named.select("tender_id", "q10", "q50", "q90", "basis", later.alias("deferred"))


_GUESS = "g AS (SELECT doc_id, quality AS label, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS guess, round((doc_id * 37 % 1000) / 1000.0, 3) AS conf FROM labels), c AS (SELECT conf, count(*) AS k, sum((label = guess)::INT) AS r FROM g GROUP BY 1), v AS (SELECT conf, sum(k) OVER w AS kept, sum(r) OVER w AS hits, sum(k) OVER () AS total FROM c WINDOW w AS (ORDER BY conf DESC))"


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.pmod("doc_id", F.lit(9)) == 0
    out = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.when(wrong, 1 - F.col("quality")).otherwise(F.col("quality")).alias("guess"), F.round(F.pmod(F.col("doc_id") * 37, F.lit(1000)) / 1000.0, 3).alias("conf"))
    return out.withColumn("correct", F.col("label") == F.col("guess"))


@query(f"""WITH {_GUESS}, t(target) AS (VALUES (0.85::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)), f AS (SELECT target, max(kept) AS kept, min(conf) AS threshold, max(total) AS total FROM v, t WHERE hits / kept >= target GROUP BY 1)
SELECT t.target, f.threshold, round(1 - f.kept / f.total, 4) AS deferral FROM t LEFT JOIN f USING (target)""")
def accuracy_deferral_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.deferral_for(evaluate.curve_by_confidence(_guesses(spark, sf_dir)), (0.85, 0.9, 0.99))


@query(f"""WITH {_GUESS}, r(x) AS (VALUES (1), (2), (3), (5), (10)) SELECT x AS wrong_answer_costs, round(1 - kept / total, 4) AS deferral, round(hits / kept, 4) AS accuracy FROM v, r QUALIFY row_number() OVER (PARTITION BY x ORDER BY x * (kept - hits) + total - kept, kept) = 1""")
def cost_optimal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cost_points(evaluate.curve_by_confidence(_guesses(spark, sf_dir)))


@query(f"WITH {_GUESS}, k AS (SELECT unnest([0, 1]) AS c) SELECT round(avg(2.0 * h / (t + s)), 4) AS macro_f1, count(*) AS classes FROM (SELECT c, (SELECT count(*) FROM g WHERE label = c AND guess = c) AS h, (SELECT count(*) FROM g WHERE label = c) AS t, (SELECT count(*) FROM g WHERE guess = c) AS s FROM k)")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_f1(_guesses(spark, sf_dir), "label", "guess")


@query(f"""{_T}, k AS (SELECT pe_id, count(*) FILTER (category = 'automobile') AS a, count(*) FILTER (category = 'building') AS b, count(*) AS n FROM tenders WHERE category IN ('automobile', 'building') GROUP BY 1)
SELECT pe_id, round(0.6 * (a + 1) / (0.6 * (a + 1) + 0.4 * (b + 1)), 6) AS automobile, round(0.4 * (b + 1) / (0.6 * (a + 1) + 0.4 * (b + 1)), 6) AS building FROM k""")
def entity_prior_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tenders(spark, sf_dir).where("category in ('automobile', 'building')")
    tally = classify.tallies(rows, ["automobile", "building"], label="category")
    mixed = tally.withColumn("p", classify.blended(F.array(F.lit(0.6), F.lit(0.4)), F.col("tally")))
    return mixed.select("pe_id", F.round(F.col("p")[0], 6).alias("automobile"), F.round(F.col("p")[1], 6).alias("building"))


_FIG = "runs AS (SELECT c_mktsegment AS figure, c_custkey % 14 AS run, round(avg(c_acctbal) / 10000, 6) AS value FROM customer GROUP BY 1, 2)"


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("figure"), F.pmod("c_custkey", F.lit(14)).alias("run")).agg(F.round(F.avg("c_acctbal") / 10_000, 6).alias("value"))


@query(f"""WITH {_FIG}, s AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY figure ORDER BY run)) AS step FROM runs)
SELECT figure, count(*) AS runs, round(arg_min(value, run), 4) AS first, round(arg_max(value, run), 4) AS last, round(min(value), 4) AS min, round(max(value), 4) AS max, round(max(value) - min(value), 4) AS spread,
round(list_sort(list(step) FILTER (step IS NOT NULL))[CAST(floor((count(*) - 1) / 2) AS INT) + 1], 4) AS typical_step, round(max(step), 4) AS largest_step, round(arg_max(value, run) - arg_min(value, run), 4) AS net_change FROM s GROUP BY 1 HAVING count(*) >= 3""")
def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.run_noise(_figures(spark, sf_dir))


@query(f"""WITH {_FIG}, b AS (SELECT figure, value AS was FROM runs WHERE run = 0), n AS (SELECT figure, value AS now FROM runs WHERE run = 1),
k AS (SELECT figure, CASE WHEN length(figure) % 2 = 0 THEN 'up' ELSE 'down' END AS better, 0.0005 AS t FROM (SELECT DISTINCT figure FROM runs)), j AS (SELECT figure, better, was, now, CASE better WHEN 'up' THEN was - now ELSE now - was END AS lost, greatest(3 * t, 0.001) AS tolerated FROM b JOIN n USING (figure) JOIN k USING (figure))
SELECT figure, better, round(was, 4) AS was, round(now, 4) AS now, round(lost, 4) AS lost, round(tolerated, 4) AS tolerated FROM j WHERE lost > tolerated""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _figures(spark, sf_dir)
    better = F.when(F.pmod(F.length("figure"), F.lit(2)) == 0, "up").otherwise("down")
    noise = f.select("figure").distinct().select("figure", better.alias("better"), F.lit("share").alias("kind"), F.lit(0.0005).alias("typical_step"), F.lit(0.001).alias("spread"))
    return quality.breaches(f.where("run = 0"), f.where("run = 1"), noise)


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bootstrap_coverage(_banded(spark, sf_dir).select("tender_id", "line", "value", "q10", "q50", "q90"))


@query()
def classifier_train_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.trainable(tenders(spark, sf_dir).select("tender_id", F.col("category").alias("label"), F.concat_ws(" ", "title", "ministry").alias("text"), "pe_id"))
    train, rest = rows.where(F.pmod(F.xxhash64("tender_id"), F.lit(5)) > 0), rows.where(F.pmod(F.xxhash64("tender_id"), F.lit(5)) == 0)
    guessed = classify.predicted(classify.fitted(train, buckets=1 << 12), rest)
    guess, conf = classify.answered(F.col("guess"), F.col("conf"), classify.TARGET)
    return guessed.select("tender_id", "label", guess.alias("category"), conf.alias("confidence"))


@query()
def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part guessed by models that have not seen it, in three repeats of two folds; then one vote each."""
    word = lambda i: F.lower(F.element_at(F.split("p_type", " "), i))
    rows = table(spark, sf_dir, "part").select("p_partkey", word(-1).alias("label"), F.concat_ws(" ", "p_name", word(1), F.left(word(-1), F.lit(3))).alias("text"))
    votes = classify.out_of_fold(classify.trainable(rows), "p_partkey", folds=2, repeats=3, buckets=1 << 12)
    return votes.groupBy("p_partkey", "label").agg(F.count(F.lit(1)).alias("repeats"), F.mode("guess", deterministic=True).alias("guess"), F.round(F.avg("conf"), 3).alias("conf"))


@query(f"""{_T} SELECT tender_id, CASE WHEN method = '1-URGENT' THEN category WHEN estimate % 1 >= 0.5 THEN 'guess' ELSE '' END AS category, CASE WHEN method = '1-URGENT' THEN 1.0 ELSE round(estimate % 1, 4) END AS category_confidence,
CASE WHEN method = '1-URGENT' THEN 'portal' WHEN estimate % 1 >= 0.5 THEN 'model' ELSE '' END AS category_source FROM tenders""")
def category_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenders(spark, sf_dir)
    guesses = t.select("tender_id", F.lit("guess").alias("category"), (F.col("estimate") % 1).alias("conf"))
    return labels.by_source(t.select("tender_id"), t.where("method = '1-URGENT'").select("tender_id", "category"), guesses, 0.5)
