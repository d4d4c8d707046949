"""Planning of experiments, small tables, and the remaining profiles and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortex.functions.exprs import normal, safe_ratio
from cohortex.functions.periods import derive_folds, month_index, month_key
from cohortex.operators import cohort, drift, ml, planning, quality, stats
from cohortex.operators.features import select_blocks
from cohortex.operators.metrics import auc_scan
from cohortex.plans.analysis import FIELDS, LEFT, _labelled, _long_sql
from cohortex.plans.base import M_SQL, V_SQL, monthly, valid
from cohortex.plans.catalog import query, table
from cohortex.sources import io
from cohortex.sources.trials import TrialStore
from cohortex.staging import shared_root, stage


@query(sql=f"WITH {M_SQL} SELECT c, t, prod FROM m WHERE t IN (202104, 202105)")
def wanted_months(spark: SparkSession, sf: str) -> DataFrame:
    """Two months; one without rows would be an error."""
    m = stage(monthly(spark, sf, "prod").select("c", "t", "prod"), "months")
    quality.require_periods(m, "t", [202104, 202105])
    return m.where(F.col("t").isin(202104, 202105))


@query(sql="SELECT feature FROM catalogo WHERE bloque = (SELECT min(bloque) FROM catalogo)")
def selected_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The features of the first block of the stored catalog."""
    rows = [(r["bloque"], r["feature"]) for r in table(spark, sf, "catalogo").select("bloque", "feature").collect()]  # the catalog: one row a feature
    chosen = select_blocks(["c", *[f for _, f in rows]], rows, only=[min(b for b, _ in rows)])
    return spark.createDataFrame([(f,) for f in chosen], "feature string")


@query(sql=f"WITH {M_SQL} SELECT DISTINCT t, CAST(strftime(strptime(t::VARCHAR, '%Y%m') + INTERVAL 5 MONTH, '%Y%m') AS INTEGER) AS later, CAST(strftime(strptime(t::VARCHAR, '%Y%m') - INTERVAL 14 MONTH, '%Y%m') AS INTEGER) AS earlier FROM m")
def f14_moved_months(spark: SparkSession, sf: str) -> DataFrame:
    """Every month five months on and fourteen months back."""
    i = month_index("t")
    return monthly(spark, sf, "prod").select("t").distinct().select("t", month_key(i + 5).alias("later"), month_key(i - 14).alias("earlier"))


@query(sql="SELECT CAST(strftime(DATE '2021-06-01' - to_months(k), '%Y%m') AS INTEGER) AS valid, CAST(strftime(DATE '2021-06-01' - to_months(k + 2 + j), '%Y%m') AS INTEGER) AS train FROM (SELECT unnest(range(0, 3)) AS k) CROSS JOIN (SELECT unnest(range(0, 4)) AS j)")
def m35_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Three folds of four months with a gap of two before August 2021; absent months would be an error."""
    folds = derive_folds(202108, 2, 4, 3)
    months = [r["t"] for r in monthly(spark, sf, "prod").select("t").distinct().collect()]  # one row a month
    planning.validate_folds(folds, 202108, 2, months)
    return spark.createDataFrame([(f["valid"], t) for f in folds for t in f["train"]], "valid int, train int")


@query(sql="SELECT min_data, rate, CAST(CASE WHEN rate < 1 THEN greatest(1, round_even(min_data / rate, 0)) ELSE min_data END AS INTEGER) AS scaled FROM (VALUES (20, 0.1::DOUBLE), (1, 0.5), (33, 0.4), (50, 1.0), (7, 2.0)) x(min_data, rate)")
def m36_min_data(spark: SparkSession, sf: str) -> DataFrame:
    cases = [(20, 0.1), (1, 0.5), (33, 0.4), (50, 1.0), (7, 2.0)]
    return spark.createDataFrame([(m, r, planning.min_data_for_all_rows(m, r)) for m, r in cases], "min_data int, rate double, scaled int")


@query
def m37_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Two given seeds and six drawn ones: primes of the range, the same for the same master."""
    return spark.createDataFrame([(i, s) for i, s in enumerate(planning.seeds([104729, 100003], 8, 7))], "place int, seed int")


@query(sql="SELECT 'csv' AS kind, bloque, feature FROM catalogo UNION ALL SELECT 'parquet', bloque, feature FROM catalogo")
def s13_small_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog written as CSV and as Parquet and read back."""
    c = table(spark, sf, "catalogo").select("bloque", "feature")
    p = f"{shared_root(spark)}/catalog-{uuid.uuid4().hex[:8]}"
    io.write_csv(c, f"{p}.csv")
    io.write_parquet(c, p)
    back = io.read_csv(spark, f"{p}.csv", "bloque string, feature string").withColumn("kind", F.lit("csv"))
    return back.unionByName(spark.read.parquet(p).withColumn("kind", F.lit("parquet"))).select("kind", "bloque", "feature")


@query(sql=f"WITH {M_SQL}, r AS (SELECT count(DISTINCT t) AS n FROM m) SELECT k AS how, n AS rows FROM r CROSS JOIN (VALUES ('collect'), ('pandas'), ('arrow'), ('first')) x(k)")
def s16_fetched(spark: SparkSession, sf: str) -> DataFrame:
    """A small result (one row a month) fetched in every form."""
    m = stage(monthly(spark, sf, "prod").groupBy("t").count(), "per-month")
    rows = {"collect": len(m.collect()), "pandas": len(m.toPandas()), "arrow": m.toArrow().num_rows, "first": m.agg(F.count(F.lit(1))).first()[0]}
    return spark.createDataFrame(list(rows.items()), "how string, rows long")


@query(sql="SELECT 'a' AS study, k AS trial, CASE WHEN k = 1 THEN 'complete' ELSE 'pruned' END AS state FROM (VALUES (0), (1)) x(k) UNION ALL SELECT 'b', 0, 'complete'")
def s17_trial_store(spark: SparkSession, sf: str) -> DataFrame:
    """Trials added one by one; of a trial added twice the later state counts."""
    s = TrialStore(spark, f"{shared_root(spark)}/trials-{uuid.uuid4().hex[:8]}")
    for study, no, path, state in (("a", 0, [0.5], "pruned"), ("a", 1, [0.5], "pruned"), ("a", 1, [0.5, 0.7], "complete"), ("b", 0, [0.9], "complete")):
        s.add(study, no, "{}", path, state)
    assert s.load("a")[1]["path"] == [0.5, 0.7]
    return s.table().select("study", "trial", "state")


@query
def m38_random_search(spark: SparkSession, sf: str) -> DataFrame:
    """Six seeded trials over two folds, kept in a store and pruned by the median of the finished ones."""
    d = stage(ml.impute(stage(_labelled(spark, sf, *FIELDS).where("clase is not null"), "labelled"), FIELDS), "train")
    folds = [(d.where("t < 202103"), d.where("t = 202105")), (d.where("t < 202104"), d.where("t = 202106"))]
    store = TrialStore(spark, f"{shared_root(spark)}/trials-{uuid.uuid4().hex[:8]}")
    return ml.random_search(folds, FIELDS, F.col("baja"), {"depth": (2, 5), "leaf_rows": [1, 10, 50]}, 6, 104729, "tree", store, warm=2)


@query(sql=f"WITH {M_SQL} SELECT c, t, round(coalesce(saldo, 0) / nullif(limite, 0) + 3e-11, 8) AS ratio FROM m")
def f3_ratio_null_as_zero(spark: SparkSession, sf: str) -> DataFrame:
    return monthly(spark, sf, "saldo", "limite").select("c", "t", F.round(safe_ratio("saldo", "limite", null_as_zero=True) + 3e-11, 8).alias("ratio"))


@query(sql=f"WITH {M_SQL}, g AS (SELECT t, avg(saldo) AS a, stddev_samp(saldo) AS s FROM m GROUP BY t) SELECT c, t, round(ln(1 + abs(saldo)), 8) AS log_saldo, round((saldo - a) / nullif(s, 0), 6) AS z_saldo FROM m JOIN g USING (t)")
def f15_standardised(spark: SparkSession, sf: str) -> DataFrame:
    """Logarithms, and distances from the month's mean in deviations: the month's row is joined back, no month is ordered or gathered."""
    m = monthly(spark, sf, "saldo")
    g = m.groupBy(F.col("t").alias("gt")).agg(F.avg("saldo").alias("a"), F.stddev_samp("saldo").alias("s"))
    z = F.try_divide(F.col("saldo") - F.col("a"), F.col("s"))
    return m.join(g, F.col("t") == F.col("gt")).select("c", "t", F.round(F.log1p(F.abs("saldo")), 8).alias("log_saldo"), F.round(z, 6).alias("z_saldo"))


@query
def f19_normal_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Normal draws of every client and month, the same on every run."""
    return monthly(spark, sf, "prod").select("c", "t", normal("c", "t", seed=5).alias("x"))


@query(sql=f"WITH {V_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS rows, count({f}) AS count, count(*) - count({f}) AS nulls, CAST(coalesce(sum((trim({f}) = '')::INT), 0) AS BIGINT) AS blanks, CAST(min(length({f})) AS INTEGER) AS shortest, CAST(max(length({f})) AS INTEGER) AS longest FROM v" for f in ("clase_ternaria", "particion")))
def s15_profile_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of the text columns."""
    p = quality.profile_strings(valid(spark, sf, "clase_ternaria", "particion"), ["clase_ternaria", "particion"])
    return p.select("field", "rows", "count", "nulls", "blanks", "shortest", "longest")


@query(sql=f"WITH {M_SQL} SELECT t, count(*) AS rows, round(avg((clase = 'BAJA+2')::INT), 8) AS rate, count(*) < 600 AS few_rows, coalesce(NOT avg((clase = 'BAJA+2')::INT) BETWEEN 0.01 AND 0.05, false) AS odd_target FROM m GROUP BY t")
def m42_target_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Months with few rows or an odd rate of leavers."""
    return quality.target_gates(monthly(spark, sf, "prod"), "t", "clase", "BAJA+2", 600, 0.01, 0.05).withColumn("rate", F.round("rate", 8))


@query(
    sql=f"""WITH {M_SQL}, l AS ({_long_sql(['saldo', 'trx'], LEFT + ' AS baja, ')}), md AS (SELECT field, median(x) AS md FROM l GROUP BY 1), b AS (SELECT {LEFT} AS baja, (rent < 0)::INT AS x FROM m WHERE rent IS NOT NULL)
SELECT baja, field, round(avg((CASE WHEN field = 'saldo' THEN x > md ELSE x < md END)::INT) / 0.5::DOUBLE, 8) AS lift FROM l JOIN md USING (field) WHERE x IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT baja, 'rojo', round(avg(x) / (SELECT avg(x) FROM b), 8) FROM b GROUP BY 1"""
)
def m19_lifts_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """A yes-or-no field against its rate, a field whose high values matter and one whose low values do."""
    m = stage(_labelled(spark, sf, "saldo", "trx", "rent").withColumn("rojo", (F.col("rent") < 0).cast("int")), "labelled")
    return cohort.profile_lifts(m, "baja", ["rojo"], ["saldo"], ["trx"], None).withColumn("lift", F.round("lift", 8))


_RULES = {"sin_movimientos": "trx = 0", "pocos_productos": "prod <= 2", "saldo_rojo": "saldo < 0"}


@query(
    sql=f"WITH {M_SQL}, x AS (SELECT *, {LEFT} AS y FROM m), tot AS (SELECT count(*) AS rows, sum(y::INT) AS pos FROM x), r AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS rule, sum(coalesce({c}, false)::INT) AS n, sum((coalesce({c}, false) AND y)::INT) AS hits FROM x" for n, c in _RULES.items())
    + ") SELECT rule, CAST(n AS BIGINT) AS n, CAST(hits AS BIGINT) AS hits, round(hits::DOUBLE / n / nullif((pos - hits)::DOUBLE / nullif(rows - n, 0), 0), 6) AS odds FROM r, tot WHERE n >= 30"
)
def m21_rule_odds(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.rule_lifts(_labelled(spark, sf, "trx", "prod", "saldo"), _RULES, "baja").select("rule", "n", "hits", F.round("odds", 6).alias("odds"))


@query(sql=f"WITH {M_SQL}, s AS (SELECT c, t, CAST((CASE WHEN trx = 0 THEN 3 ELSE 0 END) + (CASE WHEN prod <= 2 THEN 1 ELSE 0 END) + (CASE WHEN saldo < 0 THEN 2 ELSE 0 END) AS INTEGER) AS score FROM m) SELECT c, t, score, CASE WHEN score >= 4 THEN 'alto' WHEN score >= 2 THEN 'medio' ELSE 'bajo' END AS level FROM s")
def m21_risk_score(spark: SparkSession, sf: str) -> DataFrame:
    rules = {n: (c, p) for (n, c), p in zip(_RULES.items(), (3, 1, 2))}
    return cohort.risk_score(monthly(spark, sf, "trx", "prod", "saldo"), ["c", "t"], rules, [(0, "bajo"), (2, "medio"), (4, "alto")])


@query(
    sql=f"WITH {M_SQL}, x AS (SELECT *, {LEFT} AS y FROM m) "
    + " UNION ALL ".join(f"SELECT '{f}' AS product, CAST(sum(h::INT) AS BIGINT) AS holders, CAST(sum((NOT h)::INT) AS BIGINT) AS others, round(avg(y::INT) FILTER (WHERE h) / nullif(avg(y::INT) FILTER (WHERE NOT h), 0), 6) AS ratio FROM (SELECT y, coalesce({f} > 0, false) AS h FROM x)" for f in ("nomina", "debito"))
)
def m21_anchor_products(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.anchor_products(_labelled(spark, sf, "nomina", "debito"), ["nomina", "debito"], "baja").select("product", "holders", "others", F.round("ratio", 6).alias("ratio"))


@query(sql=f"WITH {M_SQL} SELECT prod, 'nomina' AS offer, count(*) AS rows, round(sum(rent), 2) AS value FROM m WHERE coalesce(nomina, 0) = 0 GROUP BY 1 UNION ALL SELECT prod, 'visa', count(*), round(sum(rent), 2) FROM m WHERE visa IS NULL GROUP BY 1")
def m21_offer_sizes(spark: SparkSession, sf: str) -> DataFrame:
    o = cohort.offer_sizes(monthly(spark, sf, "prod", "nomina", "visa", "rent"), "prod", {"nomina": "coalesce(nomina, 0) = 0", "visa": "visa is null"}, "rent")
    return o.withColumn("value", F.round("value", 2))


@query(
    sql=f"""WITH {M_SQL}, l AS (SELECT c, max({LEFT}::INT) AS b FROM m GROUP BY 1), x AS (SELECT m.*, b = 0 AS leal FROM m JOIN l USING (c)), k AS (SELECT *, dense_rank() OVER (PARTITION BY c ORDER BY t DESC) AS k FROM x WHERE NOT leal),
g AS (SELECT prod, count(DISTINCT c) AS entities, avg(rent) AS monthly FROM k WHERE k > 2 GROUP BY 1), r AS (SELECT *, monthly * 12 / (SELECT avg(rent) * 12 FROM x WHERE leal) AS ratio FROM g)
SELECT prod, entities, round(monthly, 4) AS monthly, round(ratio, 6) AS ratio, CASE WHEN ratio <= 0.5 THEN 'Bajo valor' WHEN ratio <= 1 THEN 'Medio-bajo' WHEN ratio <= 1.5 THEN 'Medio-alto' WHEN ratio IS NOT NULL THEN 'Alto valor' END AS category FROM r"""
)
def m22_value_categories(spark: SparkSession, sf: str) -> DataFrame:
    """What leavers brought by number of products, without their last two months, against loyal clients."""
    m = _labelled(spark, sf, "rent", "prod").withColumn("leal", F.max(F.col("baja").cast("int")).over(Window.partitionBy("c")) == 0)  # one row a month and client
    p = cohort.cohort_profit(stage(m, "cohorts"), "prod", "c", "t", "rent", F.col("leal"))
    return p.select("prod", "entities", F.round("monthly", 4).alias("monthly"), F.round("ratio", 6).alias("ratio"), "category")


@query(
    sql=f"""WITH {M_SQL}, l AS ({_long_sql(FIELDS, LEFT + ' AS y, ')}), r AS (SELECT field, y, rank() OVER (PARTITION BY field ORDER BY x) + (count(*) OVER (PARTITION BY field, x) - 1) / 2.0::DOUBLE AS a FROM l WHERE x IS NOT NULL),
g AS (SELECT field, sum(a) FILTER (WHERE y) AS ra, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM r GROUP BY 1), u AS (SELECT field, (ra - p * (p + 1) / 2.0::DOUBLE) / (p * n) AS auc FROM g WHERE p >= 30 AND n >= 30)
SELECT field, round(auc, 8) AS auc, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS direction, round(greatest(auc, 1 - auc), 8) AS strength FROM u"""
)
def m26_directions(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of every field alone with its direction, fields with too few rows of a class left out."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in FIELDS])
    long = _labelled(spark, sf, *FIELDS).select("baja", F.explode(parts).alias("v")).select("baja", "v.*")
    return auc_scan(long, ["field"], "x", "baja").select("field", F.round("auc", 8).alias("auc"), "direction", F.round("strength", 8).alias("strength"))


@query(sql=f"WITH {M_SQL}, p AS (SELECT unnest([0.0, 10.0, 40.0, 100.0])::DOUBLE AS point) SELECT point, round(avg(exp(-pow((trx - point) / 15, 2) / 2) / (15 * sqrt(2 * pi()))), 9) AS density FROM m CROSS JOIN p WHERE trx IS NOT NULL GROUP BY 1")
def m27_density(spark: SparkSession, sf: str) -> DataFrame:
    return stats.density(monthly(spark, sf, "trx"), "trx", [0.0, 10.0, 40.0, 100.0], 15.0).withColumn("density", F.round("density", 9))


_PAIRS = [("saldo", "trx"), ("saldo", "prod"), ("trx", "prod")]


@query(
    sql=f"WITH {M_SQL}, r AS (SELECT " + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN rank() OVER (ORDER BY {f} NULLS LAST) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0::DOUBLE END AS {f}" for f in ("saldo", "trx", "prod")) + " FROM m) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS rho, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM r" for a, b in _PAIRS)
)
def m27_spearman_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spearman_matrix(monthly(spark, sf, "saldo", "trx", "prod"), ["saldo", "trx", "prod"], ["c", "t"]).withColumn("rho", F.round("rho", 7))


@query
def m27_p_values(spark: SparkSession, sf: str) -> DataFrame:
    """Mann and Whitney's and Wilcoxon's tests with their p-values."""
    m = stage(_labelled(spark, sf, "trx", "debito"), "labelled")
    both = stats.mann_whitney(m, "trx", "baja").select(F.lit("mann_whitney").alias("test"), "z").unionByName(stats.wilcoxon(m, "trx", "debito").select(F.lit("wilcoxon").alias("test"), "z"))
    return stats.with_normal_p(both)


@query(sql=f"WITH {M_SQL}, o AS (SELECT clase FROM m WHERE clase IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, clase LIMIT 1) SELECT c, t, coalesce(clase, (SELECT clase FROM o)) AS clase FROM m")
def m29_modes(spark: SparkSession, sf: str) -> DataFrame:
    return ml.impute_modes(stage(monthly(spark, sf, "prod").select("c", "t", "clase"), "months"), ["clase"])


@query
def m33_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Three numbers of clusters judged by three indices and their common score."""
    d = stage(ml.impute(stage(monthly(spark, sf, *FIELDS), "months"), FIELDS).groupBy("c").agg(*[F.avg(f).alias(f) for f in FIELDS]), "clients")
    return ml.sweep_clusters(d, ["c"], FIELDS, [2, 3, 4])


@query(sql=f"WITH {M_SQL}, x AS (SELECT t, f, g FROM (SELECT t, saldo AS f, 'saldo' AS g FROM m UNION ALL SELECT t, rent, 'rent' FROM m) WHERE t IN (202104, 202107)) SELECT g AS field, count(*) AS rows FROM x GROUP BY 1")
def m16_psi_all(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of two fields at once, from merged summaries: their bins hold every row of both months."""
    p = drift.psi_tables(monthly(spark, sf, "saldo", "rent"), "t", 202104, 202107, ["saldo", "rent"])
    return p.groupBy("field").agg(F.sum(F.col("expected") + F.col("actual")).alias("rows"))
