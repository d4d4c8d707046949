"""Projections, filters, joins, aggregates, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.functions.exprs import clip, is_infinite, left_closed, null_count, right_closed
from cohortex.plans.base import AMOUNTS, M_SQL, V_SQL, monthly, same_sql, scores, valid
from cohortex.plans.catalog import query, table

# projections and filters
same_sql("proj_exclude", "SELECT * EXCEPT (clase, saldo, rent, payroll, visa, limite, comis, msaldo, vsaldo, trx, nomina, debito, antig, edad, vst, mst) FROM m", "SELECT * EXCLUDE (clase, saldo, rent, payroll, visa, limite, comis, msaldo, vsaldo, trx, nomina, debito, antig, edad, vst, mst) FROM m")
same_sql("proj_lateral_alias", "SELECT c, t, coalesce(saldo, 0) AS s0, CAST(s0 > 0 AS INT) AS positivo FROM m")
same_sql("proj_case_flags", "SELECT c, t, CASE WHEN saldo < 0 THEN 'rojo' WHEN saldo = 0 THEN 'cero' WHEN saldo IS NULL THEN 'nada' ELSE 'positivo' END AS signo, CASE prod WHEN 1 THEN 'uno' WHEN 2 THEN 'dos' ELSE 'mas' END AS productos FROM m")
same_sql("filter_predicates", "SELECT c, t FROM m WHERE t BETWEEN 202101 AND 202106 AND prod IN (2, 5, 8) AND NOT (saldo IS NULL) AND (trx >= 10 OR rent < 0)")
same_sql("filter_null_safe", "SELECT c, t FROM m WHERE vst IS DISTINCT FROM mst")
same_sql("filter_scalar_subquery", "SELECT c, prod FROM m WHERE t = (SELECT max(t) FROM m)")
same_sql("filter_in_subquery", "SELECT c, t FROM m WHERE c IN (SELECT c FROM m WHERE clase = 'BAJA+2')")


@query(sql=f"WITH {M_SQL} SELECT c, t, prod FROM m WHERE t = 202103 AND prod >= 5")
def filter_parameters(spark: SparkSession, sf: str) -> DataFrame:
    monthly(spark, sf, "prod").createOrReplaceTempView("m_prod")
    return spark.sql("SELECT c, t, prod FROM m_prod WHERE t = :mes AND prod >= :minimo", args={"mes": 202103, "minimo": 5})


@query(sql=f"WITH {M_SQL} SELECT c, t, CASE WHEN t = 202107 THEN saldo / 3 ELSE saldo END AS saldo, coalesce(payroll, 0.0) AS payroll FROM m")
def proj_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Columns replaced in place, one only in some rows."""
    m = monthly(spark, sf, "saldo", "payroll")
    return m.withColumns({"saldo": F.when(F.col("t") == 202107, F.col("saldo") / 3).otherwise(F.col("saldo")), "payroll": F.coalesce("payroll", F.lit(0.0))}).select("c", "t", "saldo", "payroll")


@query(sql=f"WITH {M_SQL} SELECT c, t, CAST((msaldo IS NULL)::INT + (vsaldo IS NULL)::INT + (payroll IS NULL)::INT + (limite IS NULL)::INT AS INTEGER) AS nulos FROM m")
def proj_null_count(spark: SparkSession, sf: str) -> DataFrame:
    return monthly(spark, sf, "msaldo", "vsaldo", "payroll", "limite").select("c", "t", null_count("msaldo", "vsaldo", "payroll", "limite").alias("nulos"))


@query(
    sql=f"""WITH {M_SQL} SELECT c, t, CASE WHEN rent IS NOT NULL THEN greatest(least(rent, 5000.0), -5000.0) END AS acotada, CASE WHEN saldo >= 0 AND saldo <= 10000 THEN 'bajo' WHEN saldo > 10000 AND saldo <= 50000 THEN 'medio' WHEN saldo > 50000 AND saldo <= 1e12 THEN 'alto' END AS tramo,
CAST(CASE WHEN prod >= 0 AND prod < 3 THEN 0 WHEN prod >= 3 AND prod < 8 THEN 1 WHEN prod >= 8 AND prod <= 20 THEN 2 END AS INTEGER) AS banda, round(ln(greatest(coalesce(trx, 0), 0) + 1), 6) AS logtrx, coalesce(isinf(rent), false) AS infinita FROM m"""
)
def scalar_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Clipping, right-closed and left-closed bins, logarithms, infinity test."""
    return monthly(spark, sf, "rent", "saldo", "prod", "trx").select(
        "c", "t", clip("rent", -5000.0, 5000.0).alias("acotada"), right_closed("saldo", [0, 10000, 50000, 1e12], ["bajo", "medio", "alto"]).alias("tramo"), left_closed("prod", [0, 3, 8, 20]).alias("banda"),
        F.round(F.log1p(F.greatest(F.coalesce("trx", F.lit(0)), F.lit(0))), 6).alias("logtrx"), F.coalesce(is_infinite("rent"), F.lit(False)).alias("infinita"),
    )


same_sql("scalar_arithmetic", "SELECT c, t, abs(rent) AS mag, CAST(sign(rent) AS INT) AS signo, floor(rent / 1000) AS miles, round(saldo / nullif(prod, 0) + 3e-11, 8) AS por_producto, t div 100 AS anio, t % 100 AS mes, greatest(coalesce(vst, 0), coalesce(mst, 0)) AS peor, least(antig, edad * 12) AS menor FROM m", "SELECT c, t, abs(rent) AS mag, CAST(sign(rent) AS INT) AS signo, CAST(floor(rent / 1000) AS BIGINT) AS miles, round(saldo / nullif(prod, 0) + 3e-11, 8) AS por_producto, CAST(t // 100 AS BIGINT) AS anio, t % 100 AS mes, greatest(coalesce(vst, 0), coalesce(mst, 0)) AS peor, least(antig, edad * 12) AS menor FROM m")
same_sql("scalar_strings", "SELECT DISTINCT source, lower(trim(source)) AS limpia, lower(trim(source)) LIKE 'enciclo%' AS enciclo, regexp_replace(lower(trim(source)), '_', '-') AS guion, CASE WHEN lower(trim(source)) IN ('bot_lugares') THEN 'bot' ELSE 'otra' END AS clase FROM documents", needs="documents")

# joins
same_sql("join_left_two_keys", "SELECT a.c, a.t, b.prod AS antes FROM m a LEFT JOIN m b ON a.c = b.c AND b.t = a.t - 1")
same_sql("join_using", "SELECT c, t, a.prod, b.saldo FROM (SELECT c, t, prod FROM m) a LEFT JOIN (SELECT c, t, saldo FROM m WHERE saldo > 0) b USING (c, t)")
same_sql("join_inner", "SELECT p.par_id, a.t, a.prod AS prod_a, b.prod AS prod_b FROM pares_control p JOIN m a ON a.c = p.cliente_a JOIN m b ON b.c = p.cliente_b AND b.t = a.t", needs="m pares_control")
same_sql("join_range_residual", "SELECT o.c, o.t AS baja, h.t AS mes, h.trx FROM (SELECT c, t FROM m WHERE clase = 'BAJA+2') o JOIN m h ON o.c = h.c WHERE (o.t div 100 * 12 + o.t % 100) - (h.t div 100 * 12 + h.t % 100) BETWEEN 0 AND 3", "SELECT o.c, o.t AS baja, h.t AS mes, h.trx FROM (SELECT c, t FROM m WHERE clase = 'BAJA+2') o JOIN m h ON o.c = h.c WHERE (o.t // 100 * 12 + o.t % 100) - (h.t // 100 * 12 + h.t % 100) BETWEEN 0 AND 3")
same_sql("join_anti", "SELECT DISTINCT p.numero_de_cliente FROM puntajes p LEFT ANTI JOIN m ON m.c = p.numero_de_cliente", "SELECT DISTINCT p.numero_de_cliente FROM puntajes p ANTI JOIN m ON m.c = p.numero_de_cliente", needs="m puntajes")
same_sql("join_update", "SELECT c, t, coalesce(u.prob, 0.0) AS prob FROM (SELECT c, t FROM m WHERE t >= 202107) x LEFT JOIN (SELECT foto_mes, numero_de_cliente, max(prob) AS prob FROM s GROUP BY foto_mes, numero_de_cliente) u ON u.foto_mes = x.t AND u.numero_de_cliente = x.c", needs="m s")
same_sql("join_many_batches", "SELECT a.c, a.t, a.saldo, b.rent, d.trx FROM (SELECT c, t, saldo FROM m) a JOIN (SELECT c, t, rent FROM m) b ON a.c = b.c AND a.t = b.t JOIN (SELECT c, t, trx FROM m) d ON a.c = d.c AND a.t = d.t")
same_sql("join_constant", "SELECT m.c, m.t, k.k FROM m, (SELECT 7 AS k) k WHERE m.t = 202101")

# aggregates
same_sql("agg_basic", "SELECT t, count(*) AS filas, sum(trx) AS trx, min(saldo) AS peor, max(saldo) AS mejor, round(avg(prod), 6) AS productos FROM m GROUP BY t", "SELECT t, count(*) AS filas, CAST(sum(trx) AS BIGINT) AS trx, min(saldo) AS peor, max(saldo) AS mejor, round(avg(prod), 6) AS productos FROM m GROUP BY t")
same_sql("agg_group_by_all", "SELECT t, clase, count(*) AS n FROM m GROUP BY ALL")
same_sql("agg_distinct", "SELECT t, count(DISTINCT c) AS clientes, count(DISTINCT prod) AS productos FROM m GROUP BY t")
same_sql("agg_distinct_tuple", "SELECT count(DISTINCT struct(c, t)) AS pares, count(DISTINCT struct(vst, mst)) AS estados FROM m", "SELECT count(DISTINCT (c, t)) AS pares, count(DISTINCT (vst, mst)) AS estados FROM m")
same_sql("agg_filtered", "SELECT t, count(*) FILTER (WHERE saldo < 0) AS rojos, min(antig) FILTER (WHERE prod > 5) AS antig FROM m GROUP BY t")
same_sql("agg_conditional_rate", "SELECT t, round(100.0D * sum(CASE WHEN clase = 'BAJA+2' THEN 1 ELSE 0 END) / count(*), 4) AS tasa FROM m GROUP BY t", "SELECT t, round(100.0::DOUBLE * sum(CASE WHEN clase = 'BAJA+2' THEN 1 ELSE 0 END) / count(*), 4) AS tasa FROM m GROUP BY t")
same_sql("agg_share_of_total", "SELECT t, clase, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY t), 6) AS parte FROM m GROUP BY t, clase")
same_sql("agg_having_loyal", "SELECT c FROM m GROUP BY c HAVING count(*) = (SELECT count(DISTINCT t) FROM m) AND sum(CASE WHEN clase LIKE 'BAJA%' THEN 1 ELSE 0 END) = 0")
same_sql("agg_quantiles", "SELECT t, median(saldo) AS mediana, percentile_cont(0.25) WITHIN GROUP (ORDER BY saldo) AS q25, percentile_cont(0.9) WITHIN GROUP (ORDER BY saldo) AS q90, percentile_disc(0.25) WITHIN GROUP (ORDER BY saldo) AS d25 FROM (SELECT t, saldo FROM m WHERE saldo IS NOT NULL) GROUP BY t", "SELECT t, median(saldo) AS mediana, quantile_cont(saldo, 0.25) AS q25, quantile_cont(saldo, 0.9) AS q90, quantile_disc(saldo, 0.25) AS d25 FROM m WHERE saldo IS NOT NULL GROUP BY t")
same_sql("agg_spread", "SELECT t, round(stddev_samp(rent), 4) AS sd, round(stddev_pop(rent), 4) AS sdp, round(var_samp(prod), 6) AS v, round(var_pop(prod), 6) AS vp FROM m GROUP BY t")
same_sql("agg_slope", "SELECT c, round(sign(regr_slope(saldo, CAST(antig AS DOUBLE))) * ln(abs(regr_slope(saldo, CAST(antig AS DOUBLE))) + 1), 6) AS pendiente FROM m GROUP BY c HAVING count(DISTINCT antig) > 1 AND count(DISTINCT CASE WHEN saldo IS NOT NULL THEN antig END) > 1")
same_sql("agg_class_balance", "SELECT t, count(*) AS filas, count(DISTINCT c) AS clientes, sum(CAST(clase = 'CONTINUA' AS INT)) AS continua, sum(CAST(clase = 'BAJA+1' AS INT)) AS baja1, sum(CAST(clase = 'BAJA+2' AS INT)) AS baja2, sum(CAST(clase IS NULL AS INT)) AS sin_clase FROM m GROUP BY t", "SELECT t, count(*) AS filas, count(DISTINCT c) AS clientes, CAST(sum(CAST(clase = 'CONTINUA' AS INT)) AS BIGINT) AS continua, CAST(sum(CAST(clase = 'BAJA+1' AS INT)) AS BIGINT) AS baja1, CAST(sum(CAST(clase = 'BAJA+2' AS INT)) AS BIGINT) AS baja2, CAST(sum(CAST(clase IS NULL AS INT)) AS BIGINT) AS sin_clase FROM m GROUP BY t")
same_sql("agg_two_levels", "SELECT meses, count(*) AS clientes FROM (SELECT c, count(*) AS meses FROM m GROUP BY c) GROUP BY meses")
same_sql("agg_null_histogram", "SELECT nulos, count(*) AS n FROM (SELECT CAST(payroll IS NULL AS INT) + CAST(limite IS NULL AS INT) + CAST(msaldo IS NULL AS INT) AS nulos FROM m) GROUP BY nulos")


@query(sql=f"WITH {M_SQL} SELECT CAST(abs(approx_count_distinct(c) - count(DISTINCT c)) <= 0.2 * count(DISTINCT c) AS BOOLEAN) AS cerca FROM m")
def agg_approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The approximate count of clients lies within its error of the exact one."""
    m = monthly(spark, sf, "prod")
    return m.agg(F.approx_count_distinct("c", 0.02).alias("a"), F.countDistinct("c").alias("e")).select((F.abs(F.col("a") - F.col("e")) <= 0.2 * F.col("e")).alias("cerca"))


@query(sql=f"WITH {M_SQL} SELECT t, count(*) FILTER (WHERE clase = 'CONTINUA') AS CONTINUA, count(*) FILTER (WHERE clase = 'BAJA+1') AS BAJA1, count(*) FILTER (WHERE clase = 'BAJA+2') AS BAJA2 FROM m GROUP BY t")
def agg_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = monthly(spark, sf, "prod").groupBy("t").pivot("clase", ["CONTINUA", "BAJA+1", "BAJA+2"]).count().fillna(0)
    return p.select("t", "CONTINUA", F.col("`BAJA+1`").alias("BAJA1"), F.col("`BAJA+2`").alias("BAJA2"))


@query(sql=f"WITH {M_SQL}, x AS (SELECT round(avg(saldo), 4) AS saldo, round(avg(rent), 4) AS rent, round(avg(comis), 4) AS comis FROM m) SELECT campo, media FROM x UNPIVOT (media FOR campo IN (saldo, rent, comis))")
def agg_transpose(spark: SparkSession, sf: str) -> DataFrame:
    x = monthly(spark, sf, "saldo", "rent", "comis").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("saldo", "rent", "comis")])
    return x.unpivot([], ["saldo", "rent", "comis"], "campo", "media")


# set operations
same_sql("set_union_all", "SELECT c FROM m WHERE t = 202101 UNION ALL SELECT c FROM m WHERE t = 202102")
same_sql("set_chain", "SELECT c FROM m WHERE t = 202101 INTERSECT SELECT c FROM m WHERE t = 202103 EXCEPT SELECT c FROM m WHERE t = 202102")
same_sql("set_distinct", "SELECT DISTINCT t, prod FROM m")
same_sql("set_summary_equality", "SELECT count(*) AS diferencias FROM ((SELECT t, count(*) AS n FROM m GROUP BY t EXCEPT SELECT foto_mes, count(DISTINCT numero_de_cliente) FROM v WHERE numero_de_cliente IS NOT NULL GROUP BY foto_mes) UNION ALL (SELECT foto_mes, count(DISTINCT numero_de_cliente) FROM v WHERE numero_de_cliente IS NOT NULL GROUP BY foto_mes EXCEPT SELECT t, count(*) AS n FROM m GROUP BY t))", needs="m v")

# sorts
same_sql("sort_top_abs", "SELECT c, t, rent FROM m WHERE rent IS NOT NULL ORDER BY abs(rent) DESC, c, t LIMIT 25", doc="The 25 largest amounts by size: a top-k report.")


@query(sql=f"WITH {M_SQL} SELECT c, t, saldo, CAST(r AS INTEGER) AS place FROM (SELECT c, t, saldo, row_number() OVER (PARTITION BY t ORDER BY saldo DESC, c) AS r FROM m WHERE saldo IS NOT NULL) WHERE r <= 5")
def sort_top_per_month(spark: SparkSession, sf: str) -> DataFrame:
    """The five highest balances of every month."""
    from cohortex.operators.sampling import top_per_group

    return top_per_group(monthly(spark, sf, "saldo").where("saldo is not null").select("c", "t", "saldo"), ["t"], [F.col("saldo").desc(), F.col("c").asc()], 5)


@query(sql=f"WITH {V_SQL} SELECT " + ", ".join(f"round(100.0::DOUBLE * sum(({c} IS NULL)::INT) / count(*), 2) AS {n}" for n, c in AMOUNTS.items()) + " FROM v")
def agg_null_percent_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Null percentages of many columns in one aggregate."""
    v = valid(spark, sf, *AMOUNTS.values())
    return v.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 2).alias(n) for n, c in AMOUNTS.items()])


@query(sql="SELECT modelo, foto_mes, numero_de_cliente, prob FROM (SELECT modelo, foto_mes, numero_de_cliente, max(prob) AS prob FROM puntajes WHERE numero_de_cliente IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) AND prob BETWEEN 0 AND 1 GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY modelo, foto_mes ORDER BY prob DESC, numero_de_cliente) <= 50")
def sort_top_sent(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best of every model and month, ties to the smaller client: the lists that are sent."""
    from cohortex.operators.ranking import running_by_order

    s = scores(spark, sf).drop("y")
    return running_by_order(s, ["modelo", "foto_mes"], [F.col("prob").desc(), F.col("numero_de_cliente").asc()]).where("pos <= 50").select("modelo", "foto_mes", "numero_de_cliente", "prob")
