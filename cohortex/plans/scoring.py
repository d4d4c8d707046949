"""Gains, curves, AUC, ensembles, samples, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.functions.exprs import ENTITY_FACTOR, GOLDEN, MIX_1, MIX_2
from cohortex.operators import compare, ensemble, metrics, sampling
from cohortex.operators.ranking import running_by_order
from cohortex.plans.base import M_SQL, S_SQL, monthly, scores
from cohortex.plans.catalog import query, table
from cohortex.staging import stage

HIT, MISS, THRESHOLD = 39, 1, 0.025
G = ["modelo", "foto_mes"]
_CURVE = f"""WITH {S_SQL}, k AS (SELECT modelo, foto_mes, row_number() OVER w AS k, CAST(sum(CASE WHEN y THEN {HIT} ELSE -{MISS} END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gain FROM s WINDOW w AS (PARTITION BY modelo, foto_mes ORDER BY prob DESC, numero_de_cliente))"""


def _smooth_sql(curve: str, by: str, window: int) -> str:
    """Centred means as differences of running sums, over the window or, where shorter, the curve, one less if even."""
    return f"""{curve}, u AS (SELECT {by}, k, sum(gain) OVER (PARTITION BY {by} ORDER BY k) AS upto, least({window}, max(k) OVER (PARTITION BY {by})) AS w0 FROM k), w AS (SELECT * EXCLUDE (w0), w0 - (w0 + 1) % 2 AS w FROM u),
p AS (SELECT {', '.join('a.' + c.strip() for c in by.split(','))}, a.k - a.w // 2 AS k, CAST(a.upto - coalesce(b.upto, 0) AS DOUBLE) / a.w AS smoothed FROM w a LEFT JOIN w b ON {' AND '.join(f'b.{c.strip()} = a.{c.strip()}' for c in by.split(','))} AND b.k = a.k - a.w WHERE a.k >= a.w)"""


@query(sql=f"WITH {S_SQL} SELECT modelo, foto_mes, CAST(sum(CASE WHEN prob >= {THRESHOLD} THEN CASE WHEN y THEN {HIT} ELSE -{MISS} END ELSE 0 END) AS BIGINT) AS gain, CAST(sum((prob >= {THRESHOLD})::INT) AS BIGINT) AS sent FROM s GROUP BY 1, 2")
def m3_gain(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gain_at_threshold(scores(spark, sf), G, "prob", "y", HIT, MISS, THRESHOLD)


@query(sql=_CURVE + " SELECT * FROM k")
def m4_gain_curve(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gain_curve(scores(spark, sf), G, "prob", "y", "numero_de_cliente", HIT, MISS)


def _plateau(spark: SparkSession, sf: str, window: int) -> DataFrame:
    return metrics.plateau(metrics.gain_curve(scores(spark, sf), G, "prob", "y", "numero_de_cliente", HIT, MISS), G, window).withColumn("smoothed", F.round("smoothed", 6))


@query(sql=_smooth_sql(_CURVE, "modelo, foto_mes", 401) + " SELECT modelo, foto_mes, CAST(k AS BIGINT) AS k, round(smoothed, 6) AS smoothed FROM p")
def m5_plateau(spark: SparkSession, sf: str) -> DataFrame:
    """Centred means of the gain curve; curves shorter than the window have a window of their length."""
    return _plateau(spark, sf, 401)


@query(sql=_smooth_sql(_CURVE, "modelo, foto_mes", 40) + " SELECT modelo, foto_mes, CAST(k AS BIGINT) AS k, round(smoothed, 6) AS smoothed FROM p")
def m5_plateau_even(spark: SparkSession, sf: str) -> DataFrame:
    """An even window is one less."""
    return _plateau(spark, sf, 40)


@query(sql=_smooth_sql(_CURVE, "modelo, foto_mes", 401) + ", r AS (SELECT modelo, foto_mes, k, round(smoothed, 6) AS smoothed FROM p) SELECT modelo, foto_mes, smoothed, CAST(k AS BIGINT) AS k FROM r QUALIFY row_number() OVER (PARTITION BY modelo, foto_mes ORDER BY smoothed DESC, k) = 1")
def m5_best_cut(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_cut(_plateau(spark, sf, 401), G)


_FOLD_CURVE = "WITH k AS (SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY envios) AS k, ganancia AS gain FROM curva_ganancia)"


@query(
    sql=_smooth_sql(_FOLD_CURVE, "fold", 11) + """, g AS (SELECT fold, max(smoothed) AS gain FROM p GROUP BY 1), n AS (SELECT fold, max(envios) AS rows FROM curva_ganancia GROUP BY 1)
SELECT round(avg(gain / rows) * avg(rows), 4) AS objective FROM g JOIN n USING (fold)"""
)
def m8_objective(spark: SparkSession, sf: str) -> DataFrame:
    """Mean plateau gain of the stored curves, each fold brought to the mean size."""
    c = table(spark, sf, "curva_ganancia")
    curve = running_by_order(c, ["fold"], [F.col("envios").asc()]).select("fold", F.col("pos").alias("k"), F.col("ganancia").alias("gain"))
    best = metrics.best_cut(metrics.plateau(curve, ["fold"], 11), ["fold"]).select("fold", F.col("smoothed").alias("gain"))
    folds = best.join(c.groupBy("fold").agg(F.max("envios").alias("rows")), "fold")
    return metrics.trial_objective(folds, [], "gain", "rows").select(F.round("objective", 4).alias("objective"))


@query(
    sql=f"""WITH {S_SQL}, n AS (SELECT foto_mes, count(DISTINCT numero_de_cliente) AS n FROM s GROUP BY 1), b AS (SELECT envios FROM curva_ganancia QUALIFY row_number() OVER (PARTITION BY fold ORDER BY ganancia DESC, envios) = 1),
x AS (SELECT (SELECT median(envios) FROM b) * max_by(n, foto_mes) / min_by(n, foto_mes) / 500.0 AS x FROM n)
SELECT 'auto' AS kind, CAST(greatest(500, round_even(x, 0) * 500) AS BIGINT) AS cut FROM x UNION ALL SELECT 'list', unnest([100, 200, 900])::BIGINT UNION ALL SELECT 'one', 700"""
)
def m9_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts given as a number, as a list, and found: the folds' best cuts brought from the first scored month's size to the last's."""
    sizes = {r["foto_mes"]: r["n"] for r in scores(spark, sf).groupBy("foto_mes").agg(F.countDistinct("numero_de_cliente").alias("n")).collect()}  # one row a month
    best = [r["envios"] for r in m8_best_per_fold(spark, sf).collect()]  # one row a fold
    kinds = {"auto": metrics.resolve_cuts("auto", best, sizes[max(sizes)], sizes[min(sizes)]), "list": metrics.resolve_cuts([900, 100, 200, 100]), "one": metrics.resolve_cuts(700)}
    return spark.createDataFrame([(k, c) for k, cuts in kinds.items() for c in cuts], "kind string, cut long")


@query(
    sql=f"""WITH {S_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY modelo, foto_mes ORDER BY prob) + (count(*) OVER (PARTITION BY modelo, foto_mes, prob) - 1) / 2.0::DOUBLE AS a FROM s),
g AS (SELECT modelo, foto_mes, sum(a) FILTER (WHERE y) AS ra, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM r GROUP BY 1, 2)
SELECT modelo, foto_mes, round(CASE WHEN p > 0 AND n > 0 THEN (ra - p * (p + 1) / 2.0::DOUBLE) / (p * n) END, 8) AS auc, p AS positives, n AS negatives FROM g"""
)
def m6_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(scores(spark, sf), G, "prob", "y").withColumn("auc", F.round("auc", 8))


@query(sql=_CURVE + " SELECT * FROM k WHERE k % 100 = 0 AND k <= 30000")
def m7_sampled_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Every 100th point up to 30,000: the form in which curves are kept."""
    return metrics.gain_curve(scores(spark, sf), G, "prob", "y", "numero_de_cliente", HIT, MISS).where("k % 100 = 0 and k <= 30000")


@query(sql=f"WITH {S_SQL} SELECT modelo, foto_mes, count(*) AS n, min(prob) AS min, max(prob) AS max, round(avg(prob), 8) AS mean FROM s GROUP BY 1, 2")
def m7_score_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Scores in one line each; the approximate percentiles are tested apart."""
    return metrics.score_summary(scores(spark, sf), G, "prob").select(*G, "n", "min", "max", F.round("mean", 8).alias("mean"))


@query(sql="SELECT fold, valid, envios, ganancia FROM curva_ganancia QUALIFY row_number() OVER (PARTITION BY fold ORDER BY ganancia DESC, envios) = 1")
def m8_best_per_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The best point of every stored curve, the smaller cut on ties."""
    return sampling.top_per_group(table(spark, sf, "curva_ganancia"), ["fold"], [F.col("ganancia").desc(), F.col("envios").asc()], 1).drop("place")


@query(
    sql=f"""WITH {S_SQL}, o AS (SELECT *, row_number() OVER w AS pos, sum(y::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM s WINDOW w AS (PARTITION BY modelo, foto_mes ORDER BY prob DESC, numero_de_cliente))
SELECT modelo, foto_mes, round(CASE WHEN sum(y::INT) > 0 THEN sum(CASE WHEN y THEN hits::DOUBLE / pos END) / sum(y::INT) END, 8) AS average_precision, round(sum(CASE WHEN pos <= 100 THEN y::INT ELSE 0 END) / least(100.0::DOUBLE, count(*)), 8) AS precision_100,
round(CASE WHEN sum(y::INT) > 0 THEN (sum(CASE WHEN pos <= 100 THEN y::INT ELSE 0 END) / least(100.0::DOUBLE, count(*))) / (sum(y::INT)::DOUBLE / count(*)) END, 6) AS lift_100, round(CASE WHEN sum(y::INT) > 0 THEN sum(CASE WHEN pos <= 100 THEN y::INT ELSE 0 END)::DOUBLE / sum(y::INT) END, 8) AS capture_100 FROM o GROUP BY 1, 2"""
)
def m28_ranking_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = metrics.ranking_quality(scores(spark, sf), G, "prob", "y", "numero_de_cliente", [100])
    return q.select(*G, F.round("average_precision", 8).alias("average_precision"), F.round("precision_100", 8).alias("precision_100"), F.round("lift_100", 6).alias("lift_100"), F.round("capture_100", 8).alias("capture_100"))


@query(
    sql="""SELECT modelo, foto_mes, CAST(coalesce(sum(n) FILTER (WHERE numero_de_cliente IS NULL), 0) AS BIGINT) AS null_ids, CAST(coalesce(sum(n - 1) FILTER (WHERE numero_de_cliente IS NOT NULL), 0) AS BIGINT) AS repeated_ids, CAST(sum(miss) AS BIGINT) AS missing_scores, CAST(sum(outs) AS BIGINT) AS outside_scores
FROM (SELECT modelo, foto_mes, numero_de_cliente, count(*) AS n, sum((prob IS NULL OR isnan(prob))::INT) AS miss, sum(coalesce(NOT isnan(prob) AND (prob < 0 OR prob > 1), false)::INT) AS outs FROM puntajes GROUP BY 1, 2, 3) GROUP BY 1, 2"""
)
def d10_score_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the raw score table that break its contract."""
    return metrics.contract_violations(table(spark, sf, "puntajes"), G, "numero_de_cliente", "prob")


@query(
    sql=f"""WITH {S_SQL}, d AS (SELECT foto_mes, count(DISTINCT modelo) AS models FROM s GROUP BY 1), ok AS (SELECT foto_mes, numero_de_cliente FROM s JOIN d USING (foto_mes) GROUP BY ALL HAVING count(DISTINCT modelo) = max(models)),
l AS (SELECT s.* FROM s JOIN ok USING (foto_mes, numero_de_cliente)), x AS (SELECT foto_mes, modelo, prob, (sum(count(*)) OVER (PARTITION BY foto_mes, modelo ORDER BY prob) - (count(*) - 1) / 2.0::DOUBLE) / sum(count(*)) OVER (PARTITION BY foto_mes, modelo) AS r FROM l GROUP BY 1, 2, 3)
SELECT foto_mes, numero_de_cliente, round(least(greatest(avg(r), 0), 1), 8) AS prob FROM l JOIN x USING (foto_mes, modelo, prob) GROUP BY 1, 2"""
)
def m10_rank_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Every month's models over the clients that all of them scored."""
    s = stage(ensemble.common_entities(scores(spark, sf), "modelo", "numero_de_cliente", ("foto_mes",)), "common")
    return ensemble.combine(s, "modelo", "numero_de_cliente", "prob", "rank", groups=("foto_mes",)).withColumn("prob", F.round("prob", 8))


@query(sql=f"WITH {S_SQL} SELECT foto_mes, numero_de_cliente, round(avg(prob), 8) AS prob FROM s GROUP BY 1, 2")
def m11_mean_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).groupBy("foto_mes", "numero_de_cliente").agg(F.round(F.avg("prob"), 8).alias("prob"))


@query(
    sql=f"""WITH {S_SQL}, t AS (SELECT foto_mes, modelo, numero_de_cliente FROM s QUALIFY row_number() OVER (PARTITION BY foto_mes, modelo ORDER BY prob DESC, numero_de_cliente) <= 100), n AS (SELECT foto_mes, modelo, count(*) AS n FROM t GROUP BY 1, 2)
SELECT x.foto_mes, x.modelo AS a, z.modelo AS b, count(*) AS both, round(count(*)::DOUBLE / (max(na.n) + max(nb.n) - count(*)), 8) AS jaccard FROM t x JOIN t z ON x.foto_mes = z.foto_mes AND x.numero_de_cliente = z.numero_de_cliente AND x.modelo < z.modelo
JOIN n na ON na.foto_mes = x.foto_mes AND na.modelo = x.modelo JOIN n nb ON nb.foto_mes = z.foto_mes AND nb.modelo = z.modelo GROUP BY 1, 2, 3"""
)
def u5_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """How far the 100 best of every two models agree, month by month."""
    top = ensemble.top_sets(scores(spark, sf), "modelo", "numero_de_cliente", "prob", 100, ("foto_mes",))
    return ensemble.jaccard(top, "modelo", "numero_de_cliente", ("foto_mes",)).withColumn("jaccard", F.round("jaccard", 8))


@query(sql=f"WITH {S_SQL}, p AS (SELECT DISTINCT modelo, numero_de_cliente FROM s) SELECT modelo, (SELECT count(DISTINCT numero_de_cliente) FROM p) - count(*) AS missing FROM p GROUP BY 1")
def j10_id_sets(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.id_set_differences(scores(spark, sf), "modelo", "numero_de_cliente")


# samples: hashes differ between engines by design, so counts are compared where they are exact
@query
def t6_minority_sample(spark: SparkSession, sf: str) -> DataFrame:
    """All leavers and 500 of the others, in hash order: a sampling operator."""
    return sampling.sample_with_minority(monthly(spark, sf, "prod").select("c", "t", "clase"), ["c", "t"], F.col("clase") == "BAJA+2", 500, 11)


_W64 = "18446744073709551616::UHUGEINT"


def _mix_sql(e: str, steps: list[tuple[int, int]]) -> str:
    """The wrapping products of splitmix64 in 128-bit integers, one nested query a step."""
    q = f"SELECT c, t, clase, {e} AS z FROM m"
    for shift, factor in steps:
        q = f"SELECT c, t, clase, (xor(z, z // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % {_W64} AS z FROM ({q})"
    return q


_SEED = 104729
_DRAWN = _mix_sql(f"(xor((c::UHUGEINT * {ENTITY_FACTOR} + t::UHUGEINT) % {_W64}, {_SEED}::UHUGEINT) + {GOLDEN}::UHUGEINT) % {_W64}", [(30, MIX_1), (27, MIX_2)])


@query(sql=f"WITH {M_SQL} SELECT c, t, clase FROM ({_DRAWN}) WHERE coalesce(clase LIKE 'BAJA%', false) OR (xor(z, z // {1 << 31}::UHUGEINT) // 2048)::DOUBLE / 9007199254740992.0 <= 0.1")
def t7_undersample(spark: SparkSession, sf: str) -> DataFrame:
    """Leavers, and a tenth of the others by the splitmix64 number of client, month and seed."""
    return sampling.undersample(monthly(spark, sf, "prod").select("c", "t", "clase"), "c", "t", F.col("clase").startswith("BAJA"), 0.1, _SEED)


@query(
    sql=f"WITH {M_SQL}, n AS (SELECT clase, count(*) AS n FROM m WHERE clase IS NOT NULL GROUP BY 1), r AS (SELECT clase, n, unnest(range(1, 6)) AS repetition, CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT) AS first FROM n) "
    "SELECT CAST(repetition AS INTEGER) AS repetition, clase, 1 AS part, first AS n FROM r UNION ALL SELECT CAST(repetition AS INTEGER), clase, 2, n - first FROM r"
)
def t10_repeated_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of five stratified 70/30 splits: exact in every class."""
    m = monthly(spark, sf, "prod").where("clase is not null").select("c", "t", "clase")
    return sampling.repeated_splits(m, ["clase"], ["c", "t"], 0.7, 5, 29).groupBy("repetition", "clase", "part").agg(F.count(F.lit(1)).alias("n"))


@query(sql=f"WITH {M_SQL} SELECT count(*) FILTER (WHERE coalesce(clase LIKE 'BAJA%', false)) AS kept, count(*) FILTER (WHERE NOT coalesce(clase LIKE 'BAJA%', false)) AS others, CAST(round(count(*) FILTER (WHERE coalesce(clase LIKE 'BAJA%', false)) + 0.1::DOUBLE * count(*) FILTER (WHERE NOT coalesce(clase LIKE 'BAJA%', false))) AS BIGINT) AS expected FROM m")
def t8_expected_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.expected_rows(monthly(spark, sf, "prod"), F.col("clase").startswith("BAJA"), 0.1)


@query(sql=f"WITH {M_SQL}, n AS (SELECT clase, count(*) AS n FROM m WHERE clase IS NOT NULL GROUP BY 1) SELECT clase, CAST(b AS INTEGER) AS block, (n // 10) * (CASE WHEN b = 1 THEN 7 ELSE 3 END) + CASE WHEN b = 1 THEN least(n % 10, 7) ELSE greatest(n % 10 - 7, 0) END AS n FROM n, (VALUES (1), (2)) x(b)")
def t9_stratified_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of a 7:3 partition within each class: exact, whatever the hashes."""
    m = monthly(spark, sf, "prod").where("clase is not null").select("c", "t", "clase")
    return sampling.stratified_blocks(m, ["clase"], ["c", "t"], [7, 3], 5).groupBy("clase", "block").agg(F.count(F.lit(1)).alias("n"))


@query(sql=f"WITH {M_SQL}, g AS (SELECT c, max(coalesce(clase LIKE 'BAJA%', false)::INT) AS l FROM m GROUP BY 1), k AS (SELECT sum(l) AS gone, count(*) - sum(l) AS stay FROM g) SELECT 'churn' AS cohort, CAST(gone AS BIGINT) AS n FROM k UNION ALL SELECT 'leal', CAST(least(gone, stay) AS BIGINT) FROM k")
def t11_loyal_match(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the leavers' cohort and its loyal match."""
    m = sampling.loyal_match(monthly(spark, sf, "prod"), "c", "clase", F.col("clase").startswith("BAJA"), 3)
    return m.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


# comparisons: folds of the stored curves stand for seeds, cuts for folds
_TRIALS = "x AS (SELECT CAST(envios // 2000 AS BIGINT) AS trial, fold, ganancia FROM curva_ganancia WHERE envios > 0)"


@query(
    sql=f"""WITH {_TRIALS}, g AS (SELECT trial, count(*) AS n, avg(ganancia) AS mean, median(ganancia) AS median, stddev_pop(ganancia) AS std, min(ganancia) AS min, max(ganancia) AS max FROM x GROUP BY 1)
SELECT trial, n, round(mean, 3) AS mean, median, round(std, 2) AS std, min, max, median AS score, round(max - median, 2) AS optimism, trial = (SELECT trial FROM g ORDER BY median DESC, trial LIMIT 1) AS chosen FROM g"""
)
def m13_trial_stability(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "curva_ganancia").where("envios > 0").select(F.expr("envios div 2000").alias("trial"), "ganancia")
    s = compare.trial_stability(x, "trial", "ganancia")
    return s.withColumns({"mean": F.round("mean", 3), "std": F.round("std", 2), "optimism": F.round("optimism", 2)})


@query(
    sql=f"""WITH {_TRIALS}, v AS (SELECT fold AS seed, trial AS fold2, trial % 3 AS variant, ganancia FROM x), a AS (SELECT variant, seed, fold2 // 3 AS f, avg(ganancia) AS g FROM v GROUP BY 1, 2, 3),
d AS (SELECT a.variant, a.seed, a.f, a.g, a.g - r.g AS d FROM a JOIN a r ON r.variant = 0 AND r.seed = a.seed AND r.f = a.f), s AS (SELECT variant, seed, avg(d) AS d, avg(g) AS g FROM d GROUP BY 1, 2),
o AS (SELECT variant, min(d) AS lo, max(d) AS hi FROM (SELECT variant, f, avg(d) AS d FROM d GROUP BY 1, 2) GROUP BY 1), q AS (SELECT variant, avg(g) AS mean, avg(d) AS delta, coalesce(stddev_samp(d), 0) / sqrt(count(d)) AS error, sum((d > 0)::INT) AS b FROM s GROUP BY 1)
SELECT CAST(q.variant AS VARCHAR) AS variant, round(mean, 2) AS mean, round(delta, 2) AS delta, round(error, 2) AS error, CAST(b AS BIGINT) AS better_seeds, CASE WHEN q.variant = 0 THEN 'referencia' WHEN abs(delta) <= 2 * error THEN 'indistinguible' WHEN lo > 0 THEN 'mejor' WHEN hi < 0 THEN 'peor' ELSE 'mixto' END AS verdict FROM q JOIN o USING (variant)"""
)
def m14_paired_comparison(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "curva_ganancia").where("envios > 0").withColumn("trial", F.expr("envios div 2000"))
    v = x.groupBy((F.col("trial") % 3).cast("string").alias("variant"), F.col("fold").alias("seed"), F.expr("trial div 3").alias("f")).agg(F.avg("ganancia").alias("g"))
    p = compare.paired_comparison(v, "variant", "0", "seed", "f", "g")
    return p.withColumns({k: F.round(k, 2) for k in ("mean", "delta", "error")})


@query(
    sql=r"""WITH g AS (SELECT feature, bloque, avg(CASE WHEN origen IS NULL THEN 3 ELSE length(expresion) END) AS mean_gain FROM catalogo GROUP BY 1, 2), c AS (SELECT unnest([9.0, 12.5, 11.0]) AS x)
SELECT feature, bloque, mean_gain, mean_gain <= (SELECT max(x) FROM c)::DOUBLE AS noise FROM g"""
)
def m15_canary_test(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog features against three random columns, with the length of the expression for a gain."""
    c = table(spark, sf, "catalogo").select("feature", "bloque", F.when(F.col("origen").isNull(), 3).otherwise(F.length("expresion")).cast("double").alias("gain"))
    fake = spark.createDataFrame([("canarito_1", "azar", 9.0), ("canarito_2", "azar", 12.5), ("canarito_3", "azar", 11.0)], c.schema)
    return compare.canary_test(c.unionByName(fake), "feature", "bloque", "gain")


def _population(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every scored client and month with its label, and the 300 best of every model and month."""
    s = stage(scores(spark, sf).withColumn("row", F.struct("foto_mes", "numero_de_cliente")), "scored")
    return s.groupBy("row").agg(F.max("y").alias("y")), ensemble.top_sets(s, "modelo", "row", "prob", 300, ("foto_mes",)).select("modelo", "row")


@query(
    sql=f"""WITH {S_SQL}, e AS (SELECT foto_mes, numero_de_cliente, max(y::INT) AS y FROM s GROUP BY 1, 2), n AS (SELECT y, count(*) AS n FROM e GROUP BY 1)
SELECT CAST(sim AS INTEGER) AS sim, y = 1 AS y, n, CAST(round_even(0.3::DOUBLE * n, 0) AS BIGINT) AS public FROM n, (SELECT unnest(range(0, 50)) AS sim)"""
)
def m12_public_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the public part among positives and others: exact in every simulation."""
    p = compare.public_parts(_population(spark, sf)[0], "row", "y", 50, 0.3, 17)
    return p.groupBy("sim", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("public").cast("long")).alias("public"))


@query
def m12_public_private(spark: SparkSession, sf: str) -> DataFrame:
    """How the models do on simulated public and private parts of all months, and how a choice by the public part fares."""
    people, sent = _population(spark, sf)
    return compare.simulate_public_private(people, sent, "modelo", "row", "y", HIT, MISS, 50, 0.3, 17)


@query
def m40_shooters(spark: SparkSession, sf: str) -> DataFrame:
    """Does picking the best of 100 find the truly best one?"""
    return compare.shooters(100, 20, 0.8, 0.7, 200, 3, spark)
