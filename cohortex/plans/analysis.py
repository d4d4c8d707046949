"""Data quality, drift, cohorts, statistics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.operators import cohort, drift, metrics, ml, quality, ranks, stats
from cohortex.plans.base import M_SQL, V_SQL, monthly, same_sql, scores, valid
from cohortex.plans.catalog import query, table
from cohortex.staging import stage

FIELDS = ["saldo", "rent", "payroll", "trx", "prod"]
LEFT = "coalesce(clase LIKE 'BAJA%', false)"


def _long_sql(fields: list[str], keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{f}' AS field, CAST({f} AS DOUBLE) AS x FROM m" for f in fields)


@query(sql=f"WITH {M_SQL}, l AS ({_long_sql(FIELDS)}) SELECT field, count(*) AS rows, count(x) AS count, count(*) - count(x) AS nulls, round((count(*) - count(x))::DOUBLE / count(*), 8) AS null_share, min(x) AS min, max(x) AS max, round(avg(x), 4) AS mean, round(stddev_samp(x), 2) AS std FROM l GROUP BY field")
def s15_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of all fields; its approximate columns are tested apart."""
    p = quality.profile(monthly(spark, sf, *FIELDS), FIELDS)
    return p.select("field", "rows", "count", "nulls", F.round("null_share", 8).alias("null_share"), "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 2).alias("std"))


@query
def s15_profile_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    """The approximate part of the profile."""
    return quality.profile(monthly(spark, sf, *FIELDS), FIELDS).select("field", "approx_unique", "q25", "q50", "q75")


@query(sql=f"WITH {M_SQL}, l AS ({_long_sql(FIELDS, 't, ')}) SELECT t, field, round(avg((x IS NULL)::INT) * 100, 6) AS null_pct, round(avg(coalesce(x = 0, false)::INT) * 100, 6) AS zero_pct FROM l GROUP BY 1, 2")
def a17_null_shares(spark: SparkSession, sf: str) -> DataFrame:
    return quality.null_shares(monthly(spark, sf, *FIELDS), "t", FIELDS).withColumns({"null_pct": F.round("null_pct", 6), "zero_pct": F.round("zero_pct", 6)})


@query(sql=f"WITH {M_SQL}, l AS ({_long_sql(FIELDS, 't, ')}), g AS (SELECT t, field, avg((x IS NULL)::INT) * 100 AS n, avg(coalesce(x = 0, false)::INT) * 100 AS z FROM l WHERE t IN (202104, 202105) GROUP BY 1, 2) SELECT a.field, round(abs(b.n - a.n), 6) AS null_shift, round(abs(b.z - a.z), 6) AS zero_shift FROM g a JOIN g b ON a.field = b.field AND a.t = 202104 AND b.t = 202105")
def a18_share_shift(spark: SparkSession, sf: str) -> DataFrame:
    s = quality.share_shift(monthly(spark, sf, *FIELDS), "t", FIELDS, 202104, 202105)
    return s.select("field", F.round("null_shift", 6).alias("null_shift"), F.round("zero_shift", 6).alias("zero_shift"))


@query(
    sql="""WITH k AS (SELECT numero_de_cliente, foto_mes, count(*) AS n FROM competencia_01 GROUP BY 1, 2)
SELECT 'null_keys' AS gate, CAST(coalesce(sum(n) FILTER (WHERE numero_de_cliente IS NULL OR foto_mes IS NULL), 0) AS BIGINT) AS violations FROM k UNION ALL SELECT 'repeated_keys', CAST(sum(n - 1) AS BIGINT) FROM k
UNION ALL SELECT 'outside_domain', count(*) FROM competencia_01 WHERE clase_ternaria IS NOT NULL AND clase_ternaria NOT IN ('CONTINUA', 'BAJA+1', 'BAJA+2')
UNION ALL SELECT 'infinite_amounts', coalesce(CAST(sum(coalesce(isinf(mcuentas_saldo), false)::INT + coalesce(isinf(mrentabilidad), false)::INT) AS BIGINT), 0) FROM competencia_01"""
)
def m42_gates(spark: SparkSession, sf: str) -> DataFrame:
    """What the landing table breaks."""
    return quality.gates(table(spark, sf, "competencia_01"), ["numero_de_cliente", "foto_mes"], "clase_ternaria", ["CONTINUA", "BAJA+1", "BAJA+2"], ["mcuentas_saldo", "mrentabilidad"])


_PSI = """e AS (SELECT list_sort(list_distinct(list_value({edges}))) AS e FROM x), b AS (SELECT t, CASE WHEN f IS NULL THEN -1 WHEN f = list_extract(e, len(e)) THEN len(e) - 2 ELSE len(list_filter(e, lambda q: q <= f)) - 1 END AS bin FROM x, (SELECT e FROM e)),
c AS (SELECT bin, count(*) FILTER (WHERE t = 202104) AS n1, count(*) FILTER (WHERE t = 202107) AS n2 FROM b GROUP BY 1), s AS (SELECT bin, n1, n2, CASE WHEN bin < 0 THEN n1::DOUBLE / sum(n1) OVER () ELSE n1::DOUBLE / sum(CASE WHEN bin >= 0 THEN n1 END) OVER () END AS p1, CASE WHEN bin < 0 THEN n2::DOUBLE / sum(n2) OVER () ELSE n2::DOUBLE / sum(CASE WHEN bin >= 0 THEN n2 END) OVER () END AS p2 FROM c)"""
_EDGES = ", ".join(f"quantile_cont(f, {i / 10})" for i in range(11))


@query(sql=f"WITH {M_SQL}, x AS (SELECT t, rent AS f FROM m WHERE t IN (202104, 202107)), {_PSI.format(edges=_EDGES)} SELECT CAST(bin AS INTEGER) AS bin, n1 AS expected, n2 AS actual, round(p1, 8) AS expected_prop, round(p2, 8) AS actual_prop FROM s")
def m16_psi_bins(spark: SparkSession, sf: str) -> DataFrame:
    p = drift.psi_table(monthly(spark, sf, "rent"), "t", 202104, 202107, "rent", accuracy=None)
    return p.select(F.col("bin").cast("int").alias("bin"), "expected", "actual", F.round("expected_prop", 8).alias("expected_prop"), F.round("actual_prop", 8).alias("actual_prop"))


@query(sql=f"WITH {M_SQL}, x AS (SELECT t, rent AS f FROM m WHERE t IN (202104, 202107)), {_PSI.format(edges=_EDGES)} SELECT 'rent' AS field, round(sum((p2 - p1) * ln(greatest(p2, 1e-10) / greatest(p1, 1e-10))), 6) AS psi FROM s")
def m16_psi(spark: SparkSession, sf: str) -> DataFrame:
    return drift.psi(monthly(spark, sf, "rent"), "t", 202104, 202107, ["rent"], accuracy=None).withColumn("psi", F.round("psi", 6))


@query(sql=f"WITH {M_SQL}, x AS (SELECT t, rent AS f, {LEFT} AS y FROM m WHERE t IN (202104, 202107)), e AS (SELECT list_sort(list_distinct(list_value({_EDGES}))) AS e FROM x), b AS (SELECT t, y, CASE WHEN f IS NULL THEN -1 WHEN f = list_extract(e, len(e)) THEN len(e) - 2 ELSE len(list_filter(e, lambda q: q <= f)) - 1 END AS bin FROM x, (SELECT e FROM e)) SELECT CAST(bin AS INTEGER) AS bin, round(avg(y::INT) FILTER (WHERE t = 202104), 8) AS base_rate, round(avg(y::INT) FILTER (WHERE t = 202107), 8) AS now_rate FROM b GROUP BY 1")
def m17_target_by_bin(spark: SparkSession, sf: str) -> DataFrame:
    m = monthly(spark, sf, "rent").withColumn("y", F.coalesce(F.col("clase").startswith("BAJA"), F.lit(False)))
    r = drift.target_by_bin(m, "t", 202104, 202107, "rent", "y", accuracy=None)
    return r.select(F.col("bin").cast("int").alias("bin"), F.round("base_rate", 8).alias("base_rate"), F.round("now_rate", 8).alias("now_rate"))


def _labelled(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    return monthly(spark, sf, *fields).withColumn("baja", F.coalesce(F.col("clase").startswith("BAJA"), F.lit(False)))


@query(sql=f"WITH {M_SQL}, l AS ({_long_sql(FIELDS, LEFT + ' AS y, ')}), g AS (SELECT field, avg(x) FILTER (WHERE y) AS ma, avg(x) FILTER (WHERE NOT y) AS mb, var_samp(x) FILTER (WHERE y) AS va, var_samp(x) FILTER (WHERE NOT y) AS vb FROM l GROUP BY 1), d AS (SELECT field, (ma - mb) / nullif(sqrt((va + vb) / 2), 0) AS d FROM g) SELECT field, round(d, 6) AS d, CASE WHEN abs(d) >= 0.8 THEN 'grande' WHEN abs(d) >= 0.5 THEN 'mediano' WHEN d IS NOT NULL THEN 'chico' END AS magnitude FROM d")
def m18_cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.cohens_d(_labelled(spark, sf, *FIELDS), "baja", True, False, FIELDS).withColumn("d", F.round("d", 6))


@query(sql=f"WITH {M_SQL}, l AS ({_long_sql(FIELDS, LEFT + ' AS baja, ')}), md AS (SELECT field, median(x) AS md FROM l GROUP BY 1) SELECT baja, field, round(avg((x > md)::INT) / 0.5::DOUBLE, 8) AS lift FROM l JOIN md USING (field) WHERE x IS NOT NULL GROUP BY 1, 2")
def m19_lifts(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.lifts(stage(_labelled(spark, sf, *FIELDS), "labelled"), "baja", FIELDS, accuracy=None).withColumn("lift", F.round("lift", 8))


RULES = {"sin_movimientos": "trx = 0", "pocos_productos": "prod <= 2", "saldo_rojo": "saldo < 0", "sin_sueldo": "payroll is null or payroll = 0"}


@query(sql=f"WITH {M_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(sum(coalesce({c}, false)::INT) AS BIGINT) AS n, CAST(sum((coalesce({c}, false) AND {LEFT})::INT) AS BIGINT) AS hits, round(sum((coalesce({c}, false) AND {LEFT})::INT)::DOUBLE / nullif(sum(({LEFT})::INT), 0), 8) AS recall, round(sum((coalesce({c}, false) AND {LEFT})::INT)::DOUBLE / nullif(sum(coalesce({c}, false)::INT), 0), 8) AS precision FROM m" for n, c in RULES.items()))
def m20_alert_rules(spark: SparkSession, sf: str) -> DataFrame:
    r = cohort.alert_rules(_labelled(spark, sf, *FIELDS), RULES, "baja")
    return r.select("rule", "n", "hits", F.round("recall", 8).alias("recall"), F.round("precision", 8).alias("precision"))


@query(sql=f"WITH {M_SQL}, r AS (SELECT {LEFT} AS y, CAST(least(1 + floor(10 * percent_rank() OVER (PARTITION BY t, (trx IS NULL) ORDER BY trx) + 1e-9), 10) AS INTEGER) AS dec, trx FROM m), g AS (SELECT * FROM r WHERE trx IS NOT NULL) SELECT dec, count(*) AS n, round(avg(y::INT), 8) AS rate, round(avg(y::INT) / (SELECT avg(y::INT) FROM g), 6) AS lift FROM g GROUP BY 1")
def m20_decile_rates(spark: SparkSession, sf: str) -> DataFrame:
    m = _labelled(spark, sf, "trx")
    d = ranks.percent_ranks(m, "t", ["trx"], ["c"]).select("c", "t", F.col("dec_trx").alias("dec"))
    r = cohort.decile_rates(m.join(d, ["c", "t"]), "dec", "baja")
    return r.select("dec", "n", F.round("rate", 8).alias("rate"), F.round("lift", 6).alias("lift"))


@query(sql=f"WITH {M_SQL} SELECT prod, count(*) AS n, round(avg(({LEFT})::INT), 8) AS rate, round(avg(({LEFT})::INT) / (SELECT avg(({LEFT})::INT) FROM m), 6) AS lift FROM m GROUP BY prod")
def m21_product_lift(spark: SparkSession, sf: str) -> DataFrame:
    r = cohort.binary_lift(_labelled(spark, sf, "prod"), "prod", F.col("baja"))
    return r.select("prod", "n", F.round("rate", 8).alias("rate"), F.round("lift", 6).alias("lift"))


@query(sql=f"WITH {M_SQL}, r AS (SELECT *, dense_rank() OVER (PARTITION BY c ORDER BY t DESC) AS k FROM m) SELECT prod, count(DISTINCT c) AS clientes, round(avg(rent), 4) AS media, median(rent) AS mediana FROM r WHERE k > 2 GROUP BY prod")
def m22_cohort_profit(spark: SparkSession, sf: str) -> DataFrame:
    """Profitability per number of products without each client's last two months."""
    d = cohort.skip_last_periods(monthly(spark, sf, "rent", "prod"), "c", "t", 2)
    return d.groupBy("prod").agg(F.countDistinct("c").alias("clientes"), F.round(F.avg("rent"), 4).alias("media"), F.median("rent").alias("mediana"))


_REL = "r AS (SELECT *, i - (max(i) OVER (PARTITION BY c) + 1) AS rel FROM (SELECT *, t // 100 * 12 + t % 100 AS i FROM m))"


@query(sql=f"WITH {M_SQL}, {_REL} SELECT CAST(rel AS INTEGER) AS rel, count(*) AS n, round(avg(trx), 6) AS centre, round(greatest(avg(trx) - coalesce(1.96 * stddev_samp(trx) / sqrt(count(*)), 0), min(trx)), 5) AS low, round(least(avg(trx) + coalesce(1.96 * stddev_samp(trx) / sqrt(count(*)), 0), max(trx)), 5) AS high FROM r WHERE trx IS NOT NULL GROUP BY rel")
def m23_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Mean activity by months before the end, with its confidence band."""
    d = cohort.trends(cohort.relative_period(monthly(spark, sf, "trx"), "c", "t"), ["rel"], "trx")
    return d.select(F.col("rel").cast("int").alias("rel"), "n", F.round("centre", 6).alias("centre"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query(sql=f"WITH {M_SQL}, {_REL}, p AS (SELECT c, max(CASE WHEN rel = -3 THEN trx END) AS far, max(CASE WHEN rel = -1 THEN trx END) AS near FROM r GROUP BY c) SELECT 'trx' AS field, count(*) AS n, round(avg(near - far) / stddev_samp(far), 6) AS change FROM p WHERE far IS NOT NULL AND near IS NOT NULL HAVING count(*) >= 30")
def m24_early_warning(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.early_warning(monthly(spark, sf, "trx"), "c", "t", ["trx"]).withColumn("change", F.round("change", 6))


@query(sql=f"WITH {M_SQL} SELECT t, prod, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY t), 8) AS share FROM m GROUP BY 1, 2")
def m25_group_mix(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.group_mix(monthly(spark, sf, "prod"), "t", "prod").withColumn("share", F.round("share", 8))


@query(
    sql=f"""WITH {M_SQL}, l AS ({_long_sql(FIELDS, LEFT + ' AS y, ')}), r AS (SELECT field, y, rank() OVER (PARTITION BY field ORDER BY x) + (count(*) OVER (PARTITION BY field, x) - 1) / 2.0::DOUBLE AS a FROM l WHERE x IS NOT NULL),
g AS (SELECT field, sum(a) FILTER (WHERE y) AS ra, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM r GROUP BY 1) SELECT field, round((ra - p * (p + 1) / 2.0::DOUBLE) / (p * n), 8) AS auc, p AS positives, n AS negatives FROM g"""
)
def m26_auc_scan(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of every field alone, all in one ordering."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in FIELDS])
    long = _labelled(spark, sf, *FIELDS).select("baja", F.explode(parts).alias("v")).select("baja", "v.*")
    return metrics.auc(long, ["field"], "x", "baja").withColumn("auc", F.round("auc", 8))


@query(sql=f"WITH {M_SQL}, d AS (SELECT {LEFT} AS y, trx FROM m WHERE trx IS NOT NULL), r AS (SELECT y, trx, rank() OVER (ORDER BY trx) + (count(*) OVER (PARTITION BY trx) - 1) / 2.0::DOUBLE AS a, count(*) OVER (PARTITION BY trx) AS s FROM d), g AS (SELECT sum(a) FILTER (WHERE y) AS ra, count(*) FILTER (WHERE y)::DOUBLE AS n1, count(*) FILTER (WHERE NOT y)::DOUBLE AS n2, sum(s::DOUBLE * s - 1) AS ties FROM r), u AS (SELECT *, ra - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM g) SELECT u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2 FROM u")
def m27_mann_whitney(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mann_whitney(_labelled(spark, sf, "trx"), "trx", "baja").withColumn("z", F.round("z", 6))


@query(sql=f"WITH {M_SQL}, c AS (SELECT prod, {LEFT} AS y, count(*)::DOUBLE AS o FROM m WHERE prod IS NOT NULL GROUP BY 1, 2), x AS (SELECT o, sum(o) OVER (PARTITION BY prod) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM c) SELECT round(sum(o * o / e) - max(n), 4) AS chi2, CAST((SELECT count(DISTINCT prod) - 1 FROM c) AS BIGINT) AS df, CAST(max(n) AS BIGINT) AS n FROM x")
def m27_chi_square(spark: SparkSession, sf: str) -> DataFrame:
    return stats.chi_square(_labelled(spark, sf, "prod"), "prod", "baja").withColumn("chi2", F.round("chi2", 4))


@query(sql=f"WITH {M_SQL}, d AS (SELECT saldo, trx FROM m WHERE saldo IS NOT NULL AND trx IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY saldo) + (count(*) OVER (PARTITION BY saldo) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY trx) + (count(*) OVER (PARTITION BY trx) - 1) / 2.0::DOUBLE AS b FROM d) SELECT round(corr(a, b), 8) AS rho, count(*) AS n FROM r")
def m27_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spearman(monthly(spark, sf, "saldo", "trx"), "saldo", "trx").withColumn("rho", F.round("rho", 8))


@query(sql=f"WITH {M_SQL}, d AS (SELECT {LEFT} AS y, saldo FROM m WHERE saldo IS NOT NULL), g AS (SELECT saldo, sum(y::INT) AS a, sum((NOT y)::INT) AS b FROM d GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY saldo) / sum(a) OVER () - sum(b) OVER (ORDER BY saldo) / sum(b) OVER () AS d, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM g) SELECT round(max(abs(d)), 8) AS ks, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2 FROM c")
def m27_ks(spark: SparkSession, sf: str) -> DataFrame:
    return drift.ks(_labelled(spark, sf, "saldo"), "saldo", "baja").withColumn("ks", F.round("ks", 8))


@query(sql=f"WITH {M_SQL}, d AS (SELECT trx - debito AS d FROM m WHERE trx - debito <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS a FROM d) SELECT sum(a) FILTER (WHERE d > 0) AS w_plus, sum(a) FILTER (WHERE d < 0) AS w_minus, round((sum(a) FILTER (WHERE d > 0) - count(*)::DOUBLE * (count(*) + 1) / 4) / sqrt(count(*)::DOUBLE * (count(*) + 1) * (2 * count(*) + 1) / 24), 6) AS z, count(*) AS n FROM r")
def m27_wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    return stats.wilcoxon(monthly(spark, sf, "trx", "debito"), "trx", "debito").withColumn("z", F.round("z", 6))


@query(sql=f"WITH {M_SQL} SELECT prod, min(rent) AS min, quantile_cont(rent, 0.25) AS q1, median(rent) AS median, quantile_cont(rent, 0.75) AS q3, max(rent) AS max FROM m WHERE rent IS NOT NULL GROUP BY prod")
def m43_box(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.box(monthly(spark, sf, "rent", "prod"), "prod", "rent", accuracy=None)


@query(sql=f"WITH {M_SQL}, q AS (SELECT quantile_cont(rent, 0.01) AS a, quantile_cont(rent, 0.99) AS b FROM m) SELECT CAST(least(floor((rent - a) / (b - a) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM m, q WHERE rent BETWEEN a AND b GROUP BY 1")
def m43_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.histogram(stage(monthly(spark, sf, "rent"), "months"), "rent", accuracy=None)


@query(sql=f"WITH {M_SQL}, x AS (SELECT coalesce(saldo <= 0, NULL) AS a, saldo <= 10000 AS b FROM m) SELECT 0.0::DOUBLE AS value, round(avg(a::INT) * 100, 8) AS pct FROM x UNION ALL SELECT 10000.0::DOUBLE, round(avg(b::INT) * 100, 8) FROM x")
def f18_population_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.population_percentile(monthly(spark, sf, "saldo"), "saldo", [0.0, 10000.0]).withColumn("pct", F.round("pct", 8))


@query(
    sql=f"""WITH {M_SQL}, x AS (SELECT prod, {LEFT} AS y, coalesce(trx < 10, false) AS e, rent FROM m) SELECT prod, count(*) AS n, round(sum((y AND e)::INT)::DOUBLE / nullif(sum(y::INT), 0), 8) AS recall, round(sum((y AND e)::INT)::DOUBLE / nullif(sum(e::INT), 0), 8) AS precision,
round(sum(CASE WHEN y AND NOT e THEN coalesce(rent, 0) ELSE 0 END), 2) AS missed_value FROM x GROUP BY 1"""
)
def m41_segment_errors(spark: SparkSession, sf: str) -> DataFrame:
    m = _labelled(spark, sf, "prod", "trx", "rent").withColumn("e", F.col("trx") < 10)
    r = cohort.segment_errors(m, "prod", "baja", "e", "rent")
    return r.select("prod", "n", F.round("recall", 8).alias("recall"), F.round("precision", 8).alias("precision"), F.round("missed_value", 2).alias("missed_value"))


# models: MLlib's fits have no SQL
def _train(spark: SparkSession, sf: str) -> DataFrame:
    return stage(ml.impute(stage(_labelled(spark, sf, *FIELDS).where("clase is not null"), "labelled"), FIELDS), "train")  # every fit reads it several times


@query
def m29_imputed(spark: SparkSession, sf: str) -> DataFrame:
    return _train(spark, sf).select("c", "t", *FIELDS)


@query
def m30_forest_auc(spark: SparkSession, sf: str) -> DataFrame:
    """A weighted forest trained before May 2021 and measured from May on."""
    d = ml.class_weights(_train(spark, sf), "clase", {"BAJA+1": 5.0, "BAJA+2": 10.0})
    m = ml.fit_classifier(d.where("t < 202105"), FIELDS, F.col("baja"), "forest", "weight", trees=10, depth=5)
    return metrics.auc(ml.score(m, d.where("t >= 202105"), ["c", "t", "baja"]), [], "prob", "baja")


@query
def m30_importance(spark: SparkSession, sf: str) -> DataFrame:
    m = ml.fit_classifier(_train(spark, sf).where("t < 202105"), FIELDS, F.col("baja"), "tree")
    return ml.importance(m, FIELDS, spark)


@query
def m32_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of four clusters of clients."""
    per = _train(spark, sf).groupBy("c").agg(*[F.avg(f).alias(f) for f in FIELDS])
    k = ml.kmeans_profiles(per, ["c"], FIELDS, 4)
    return k.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in FIELDS])


@query
def m33_cluster_quality(spark: SparkSession, sf: str) -> DataFrame:
    per = _train(spark, sf).groupBy("c").agg(*[F.avg(f).alias(f) for f in FIELDS])
    return ml.cluster_quality(ml.kmeans_profiles(per, ["c"], FIELDS, 4, components=3), "cluster", FIELDS)


@query
def m39_adversarial(spark: SparkSession, sf: str) -> DataFrame:
    """How well April and July 2021 can be told apart."""
    return ml.adversarial_auc(monthly(spark, sf, *FIELDS), "t", 202104, 202107, FIELDS, ["c", "t"])


same_sql("embedding_labels", "SELECT label, count(*) AS n FROM embeddings GROUP BY label", needs="embeddings")


@query
def m32_leaf_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of clients by what the forest's leaves ask about, with the mean profile of each."""
    d = _train(spark, sf)
    m = ml.fit_classifier(d.where("t < 202105"), FIELDS, F.col("baja"), "forest", trees=8, depth=4)
    per = ml.leaf_profiles(m, d, ["c", "t"], FIELDS).groupBy("c").agg(*[F.avg(f).alias(f) for f in FIELDS])
    k = ml.kmeans_profiles(per, ["c"], FIELDS, 3)
    return k.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in FIELDS])


@query
def m38_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = _train(spark, sf)
    return ml.grid_search(d.where("t < 202105"), d.where("t = 202106"), FIELDS, F.col("baja"), [{"trees": 5, "depth": 3}, {"trees": 5, "depth": 6}])


@query
def f11_canaries(spark: SparkSession, sf: str) -> DataFrame:
    """Random columns that are the same on every run."""
    from cohortex.operators.planning import canaries

    return canaries(monthly(spark, sf, "prod").select("c", "t", "prod"), ["c", "t"], 3, 104729)


@query(sql=f"WITH {M_SQL} SELECT prod, count(*) AS n, median(rent) AS centre, quantile_cont(rent, 0.25) AS low, quantile_cont(rent, 0.75) AS high FROM m WHERE rent IS NOT NULL GROUP BY prod")
def m23_iqr_bands(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.trends(monthly(spark, sf, "rent", "prod"), ["prod"], "rent", "iqr", accuracy=None)


@query
def t13_plot_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand client-months in hash order: a sampling operator."""
    from cohortex.operators.sampling import sample_n

    return sample_n(monthly(spark, sf, "saldo", "rent").select("c", "t", "saldo", "rent"), ["c", "t"], 1000, 7)
