"""Panels, targets, feature families and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.functions.exprs import delta_pct, safe_ratio, safe_sum
from cohortex.operators import features
from cohortex.operators.families import RANK_FIELDS, SERIES_FIELDS, behaviour_spec, row_spec
from cohortex.operators.features import Behaviour, FeaturePlan, RowSpec, add_behaviour, add_row_features, build_features, rfm_score
from cohortex.operators.panel import churn_target, churn_target_by_gaps, dense_panel, gaps
from cohortex.operators.ranks import average_rank, deflated, ntiles, percent_ranks, signed_ranks
from cohortex.operators.series import Catalog, SeriesSpec, add_series
from cohortex.plans.base import M_SQL, V_SQL, monthly, scores, valid
from cohortex.plans.catalog import query, table
from cohortex.plans.sql_parts import counted, placed, plan_sql
from cohortex.staging import stage

#: Added before rounding in query and SQL: the engines round exact halves differently.
OFF_TIES = 3e-11

EVENTS_SQL = "ev AS (SELECT user_id AS c, CAST(strftime(CAST(ts AS DATE), '%Y%m') AS INTEGER) * 100 + CAST(strftime(CAST(ts AS DATE), '%d') AS INTEGER) AS t FROM events GROUP BY 1, 2)"
PANEL_SQL = M_SQL + ", per AS (SELECT DISTINCT t FROM m), cli AS (SELECT DISTINCT c FROM m), grid AS (SELECT c, t FROM cli CROSS JOIN per), pan AS (SELECT grid.c, grid.t, m.* EXCLUDE (c, t), CAST(m.c IS NOT NULL AS INTEGER) AS present FROM grid LEFT JOIN m ON m.c = grid.c AND m.t = grid.t)"


def _target_sql(rows: str) -> str:
    """The target by definition: every row against the rows of its client one and two periods on."""
    return f"""pos AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM {rows})), found AS (SELECT r.c, r.t, p.k FROM {rows} r JOIN pos p USING (t)), fin AS (SELECT max(k) AS last FROM pos),
y AS (SELECT a.c, a.t, CASE WHEN two.c IS NOT NULL THEN 'CONTINUA' WHEN a.k < last AND one.c IS NULL THEN 'BAJA+1' WHEN a.k + 1 < last THEN 'BAJA+2' END AS target
  FROM found a CROSS JOIN fin LEFT JOIN found one ON one.c = a.c AND one.k = a.k + 1 LEFT JOIN found two ON two.c = a.c AND two.k = a.k + 2)"""


@query(sql=f"WITH {PANEL_SQL} SELECT c, t, present, saldo, prod FROM pan")
def d3_dense_panel(spark: SparkSession, sf: str) -> DataFrame:
    return dense_panel(monthly(spark, sf, "saldo", "prod"), "c", "t").select("c", "t", "present", "saldo", "prod")


@query(sql=f"WITH {M_SQL}, {_target_sql('m')} SELECT c, t, target FROM y")
def m1_target(spark: SparkSession, sf: str) -> DataFrame:
    return churn_target(monthly(spark, sf, "prod"), "c", "t")


_EVENT_TARGET = f"WITH {EVENTS_SQL}, {_target_sql('ev')}"


@query(sql=_EVENT_TARGET + " SELECT t, count(*) FILTER (WHERE target = 'CONTINUA') AS continua, count(*) FILTER (WHERE target = 'BAJA+1') AS baja1, count(*) FILTER (WHERE target = 'BAJA+2') AS baja2, count(*) FILTER (WHERE target IS NULL) AS sin_target FROM y GROUP BY t")
def m1_target_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: users of the event panel that stay or leave, per day."""
    day = F.date_format(F.col("ts").cast("date"), "yyyyMMdd").cast("int")
    ev = table(spark, sf, "events").select(F.col("user_id").alias("c"), day.alias("t")).where("c is not null and t is not null").distinct()
    y = churn_target(ev, "c", "t")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return y.groupBy("t").agg(n(F.col("target") == "CONTINUA").alias("continua"), n(F.col("target") == "BAJA+1").alias("baja1"), n(F.col("target") == "BAJA+2").alias("baja2"), n(F.col("target").isNull()).alias("sin_target"))


@query(
    sql=f"""WITH {M_SQL}, i AS (SELECT c, t, t // 100 * 12 + t % 100 AS i FROM m), e AS (SELECT max(i) AS last FROM i),
w AS (SELECT c, t, i, lead(i, 1) OVER (PARTITION BY c ORDER BY i) AS n1, lead(i, 2) OVER (PARTITION BY c ORDER BY i) AS n2 FROM i)
SELECT c, t, CASE WHEN i >= last THEN NULL WHEN NOT coalesce(n1 = i + 1, false) THEN 'BAJA+1' WHEN i + 1 >= last THEN NULL WHEN coalesce(n2 = i + 2, false) THEN 'CONTINUA' ELSE 'BAJA+2' END AS target FROM w, e"""
)
def m2_target_by_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return churn_target_by_gaps(monthly(spark, sf, "prod"), "c", "t")


@query(sql=f"WITH {M_SQL}, o AS (SELECT t, dense_rank() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM m)) SELECT c, count(*) AS rows, max(k) - min(k) + 1 AS span FROM m JOIN o USING (t) GROUP BY c HAVING count(*) <> max(k) - min(k) + 1")
def w17_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return gaps(monthly(spark, sf, "prod"), "c", "t")


@query(
    sql=f"""WITH {M_SQL} SELECT c, t, coalesce(msaldo, 0) + coalesce(vsaldo, 0) AS tc_saldo, least(vst, mst) AS mejor, greatest(vst, mst) AS peor, CAST((coalesce(payroll, 0) > 0)::INT + (coalesce(visa, 0) > 0)::INT + (coalesce(saldo, 0) > 0)::INT AS INTEGER) AS tenencias,
round((coalesce(msaldo, 0) + coalesce(vsaldo, 0)) / nullif(limite, 0) + 3e-11, 8) AS uso, round(rent / nullif(prod, 0) + 3e-11, 8) AS rent_producto, CAST(coalesce(nomina, 0) = 0 AS INTEGER) AS sin_nomina, CAST(coalesce(saldo < 0, false) AS INTEGER) AS rojo, CAST(msaldo IS NULL AS INTEGER) AS sin_master FROM m"""
)
def f1_row_features(spark: SparkSession, sf: str) -> DataFrame:
    """Row families: sums, extremes, counts, ratios and flags."""
    spec = RowSpec(
        sums={"tc_saldo": ("msaldo", "vsaldo"), "ausente": ("msaldo", "no_existe")}, least={"mejor": ("vst", "mst")}, greatest={"peor": ("vst", "mst")}, positives={"tenencias": ("payroll", "visa", "saldo")},
        ratios={"uso": ("tc_saldo", "limite"), "rent_producto": ("rent", "prod")}, flags={"sin_nomina": "coalesce(nomina, 0) = 0", "rojo": "saldo < 0", "sin_master": "msaldo is null"},
    )
    d = add_row_features(monthly(spark, sf), spec, Catalog())
    return d.select("c", "t", "tc_saldo", "mejor", "peor", F.col("tenencias").cast("int").alias("tenencias"), F.round(F.col("uso") + OFF_TIES, 8).alias("uso"), F.round(F.col("rent_producto") + OFF_TIES, 8).alias("rent_producto"), "sin_nomina", "rojo", "sin_master")


@query(sql=f"WITH {M_SQL} SELECT c, t, coalesce(saldo, 0) + coalesce(rent, 0) AS suma, round(saldo / nullif(limite, 0) + 3e-11, 8) AS ratio, round((trx - debito) / nullif(abs(debito), 0)::DOUBLE + 3e-11, 8) AS cambio FROM m")
def f2_safe_macros(spark: SparkSession, sf: str) -> DataFrame:
    m = monthly(spark, sf, "saldo", "rent", "limite", "trx", "debito")
    return m.select("c", "t", safe_sum("saldo", "rent").alias("suma"), F.round(safe_ratio("saldo", "limite") + OFF_TIES, 8).alias("ratio"), F.round(delta_pct("trx", "debito") + OFF_TIES, 8).alias("cambio"))


_WK = "WINDOW o AS (PARTITION BY c ORDER BY t), k AS (PARTITION BY c ORDER BY t ROWS 3 PRECEDING), h AS (PARTITION BY c ORDER BY t ROWS UNBOUNDED PRECEDING)"


@query(
    sql=f"""WITH {PANEL_SQL}, z AS (SELECT c, t, present, saldo, trx, lag(saldo, 1) OVER o AS lag_1_saldo, lag(saldo, 2) OVER o AS lag_2_saldo, lag(trx, 1) OVER o AS lag_1_trx, lag(trx, 2) OVER o AS lag_2_trx,
avg(saldo) OVER k AS avg_3_saldo, max(saldo) OVER k AS max_3_saldo, min(saldo) OVER k AS min_3_saldo, stddev_samp(saldo) OVER k AS sd, avg(trx) OVER k AS avg_3_trx, sum(present) OVER h AS p, row_number() OVER o AS place FROM pan {_WK})
SELECT c, t, lag_1_saldo, lag_2_saldo, lag_1_trx, lag_2_trx, round(avg_3_saldo, 4) AS avg_3_saldo, max_3_saldo, min_3_saldo, round(sd, 3) AS stddev_3_saldo, round(avg_3_trx, 6) AS avg_3_trx, CAST(p AS BIGINT) AS present_so_far, CAST(place AS INTEGER) AS place,
round(saldo - lag_1_saldo, 4) AS delta_1_saldo, trx - lag_2_trx AS delta_2_trx, round((saldo - lag_1_saldo) / nullif(abs(lag_1_saldo), 0), 6) AS deltapct_1_saldo, round(saldo / nullif(avg_3_saldo, 0), 5) AS ratio_avg_3_saldo FROM z WHERE present = 1"""
)
def w2_series(spark: SparkSession, sf: str) -> DataFrame:
    """Lags, deltas, moving windows, ratios and presence on the dense panel."""
    p = dense_panel(monthly(spark, sf, "saldo", "trx").drop("clase", "n"), "c", "t")
    s = add_series(p, "c", "t", ["saldo", "trx"]).where("present = 1")
    r = {"avg_3_saldo": 4, "stddev_3_saldo": 3, "avg_3_trx": 6, "delta_1_saldo": 4, "deltapct_1_saldo": 6, "ratio_avg_3_saldo": 5}
    plain = ["lag_1_saldo", "lag_2_saldo", "lag_1_trx", "lag_2_trx", "max_3_saldo", "min_3_saldo", "present_so_far", "place", "delta_2_trx"]
    return s.select("c", "t", *plain, *[F.round(c, k).alias(c) for c, k in r.items()])


@query(
    sql=f"""WITH {PANEL_SQL}, z AS (SELECT c, t, present, regr_slope(saldo, CAST(antig AS DOUBLE)) OVER k AS b, count(CASE WHEN saldo IS NOT NULL AND antig IS NOT NULL THEN 1 END) OVER k AS n, min(CASE WHEN saldo IS NOT NULL THEN antig END) OVER k AS lo, max(CASE WHEN saldo IS NOT NULL THEN antig END) OVER k AS hi FROM pan {_WK})
SELECT c, t, CASE WHEN n > 1 AND lo < hi THEN round(sign(b) * ln(abs(b) + 1), 6) END AS pendiente FROM z WHERE present = 1"""
)
def w8_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of the balance against the client's age over the window (signed log scale), for every client of the panel; a client number shared by many has its largest age of the month."""
    p = dense_panel(monthly(spark, sf, "saldo", "antig").drop("clase", "n"), "c", "t")
    s = add_series(p, "c", "t", ["saldo"], SeriesSpec(trend_against="antig", lags=(), deltas=(), delta_pcts=(), stats=(), ratio=False)).where("present = 1")
    return s.select("c", "t", F.round(F.signum("trend_3_saldo") * F.log1p(F.abs("trend_3_saldo")), 6).alias("pendiente"))


@query(
    sql=f"""WITH {PANEL_SQL}, n AS (SELECT c, t, lag(saldo, 1) OVER (PARTITION BY c ORDER BY t) AS l FROM m), d AS (SELECT c, t, present, lag(saldo, 1) OVER (PARTITION BY c ORDER BY t) AS l FROM pan)
SELECT n.c, n.t FROM n JOIN d ON n.c = d.c AND n.t = d.t WHERE d.present = 1 AND n.l IS DISTINCT FROM d.l"""
)
def w22_naive_lag_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows where a lag over present rows differs from the lag over periods."""
    from pyspark.sql import Window

    m = monthly(spark, sf, "saldo")
    w = Window.partitionBy("c").orderBy("t")
    naive = m.select("c", "t", F.lag("saldo", 1).over(w).alias("a"))
    dense = dense_panel(m, "c", "t").select("c", "t", "present", F.lag("saldo", 1).over(w).alias("b")).where("present = 1")
    return naive.join(dense, ["c", "t"]).where(~F.col("a").eqNullSafe(F.col("b"))).select("c", "t")


_RANKED = {"saldo": "saldo", "rent": "rent", "trx": "CAST(trx AS DOUBLE)"}


@query(
    sql=f"WITH {M_SQL}, " + ", ".join(counted(f"r_{f}", e) for f, e in _RANKED.items()) + ", z AS (SELECT m.c, m.t, " + ", ".join(f"{placed(f'r_{f}')} AS {f}" for f in _RANKED) + " FROM m "
    + " ".join(f"LEFT JOIN r_{f} ON r_{f}.t = m.t AND r_{f}.x = {e.replace(f, 'm.' + f)}" for f, e in _RANKED.items()) + ") SELECT c, t, "
    + ", ".join(f"round({f}, 8) AS pr_{f}, CASE WHEN {f} IS NOT NULL THEN CAST(least(1 + floor(10 * {f} + 1e-9), 10) AS INTEGER) END AS dec_{f}" for f in _RANKED) + " FROM z"
)
def w9_percent_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Null-safe percent ranks and deciles of several fields in one ordering."""
    r = percent_ranks(monthly(spark, sf, "saldo", "rent", "trx"), "t", ["saldo", "rent", "trx"], ["c"])
    return r.select("c", "t", *[F.round(f"pr_{f}", 8).alias(f"pr_{f}") for f in ("saldo", "rent", "trx")], *[f"dec_{f}" for f in ("saldo", "rent", "trx")])


@query(sql=f"WITH {M_SQL} SELECT c, t, CAST(row_number() OVER w AS BIGINT) AS place, CAST(ntile(10) OVER w AS INTEGER) AS ntile_10, CAST(ntile(4) OVER w AS INTEGER) AS ntile_4 FROM m WINDOW w AS (PARTITION BY t ORDER BY saldo ASC NULLS LAST, c)")
def w11_ntiles(spark: SparkSession, sf: str) -> DataFrame:
    return ntiles(monthly(spark, sf, "saldo"), "t", "saldo", "c", [10, 4]).select("c", "t", F.col("place").cast("long").alias("place"), "ntile_10", "ntile_4")


def _signed_sql(f: str, rows: str = "m") -> tuple[str, str, str]:
    """Tables of the sizes on either side of zero, the joins to them, and the signed share."""
    sides = ", ".join(counted(f"{side}_{f}", f"CASE WHEN {test} THEN abs({f}) END", rows) for side, test in (("up", f"{f} > 0"), ("down", f"{f} < 0")))
    joins = f"LEFT JOIN up_{f} ON {rows}.{f} > 0 AND up_{f}.t = {rows}.t AND up_{f}.x = {rows}.{f} LEFT JOIN down_{f} ON {rows}.{f} < 0 AND down_{f}.t = {rows}.t AND down_{f}.x = -{rows}.{f}"
    return sides, joins, f"CASE WHEN {rows}.{f} = 0 THEN 0.0::DOUBLE ELSE coalesce(up_{f}.upto::DOUBLE / up_{f}.n, -(down_{f}.upto::DOUBLE / down_{f}.n)) END"


_SIGNED = {f: _signed_sql(f) for f in ("saldo", "rent")}


@query(sql=f"WITH {M_SQL}, " + ", ".join(s for s, _, _ in _SIGNED.values()) + " SELECT m.c, m.t, " + ", ".join(f"round({e}, 8) AS sr_{f}" for f, (_, _, e) in _SIGNED.items()) + " FROM m " + " ".join(j for _, j, _ in _SIGNED.values()))
def w12_signed_ranks(spark: SparkSession, sf: str) -> DataFrame:
    r = signed_ranks(monthly(spark, sf, "saldo", "rent"), "t", ["saldo", "rent"], ["c"])
    return r.select("c", "t", F.round("sr_saldo", 8).alias("sr_saldo"), F.round("sr_rent", 8).alias("sr_rent"))


@query(sql=f"WITH {M_SQL}, d AS (SELECT t, median(CASE WHEN saldo > 0 THEN saldo END) AS a, median(CASE WHEN payroll > 0 THEN payroll END) AS b FROM m GROUP BY t) SELECT c, t, round(saldo / nullif(a, 0), 6) AS df_saldo, round(payroll / nullif(b, 0), 6) AS df_payroll FROM m JOIN d USING (t)")
def w13_deflated(spark: SparkSession, sf: str) -> DataFrame:
    d = deflated(stage(monthly(spark, sf, "saldo", "payroll"), "months"), "t", ["saldo", "payroll"], accuracy=None)
    return d.select("c", "t", F.round("df_saldo", 6).alias("df_saldo"), F.round("df_payroll", 6).alias("df_payroll"))


@query(
    sql=f"""WITH {M_SQL}, pos AS (SELECT t, t // 100 * 12 + t % 100 AS i, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM m)), a AS (SELECT m.*, i, k, coalesce(nomina, 0) > 0 AS paid FROM m JOIN pos USING (t)),
cal AS (SELECT o.t, p1.i AS i1, p2.i AS i2 FROM pos o LEFT JOIN pos p1 ON p1.k = o.k - 1 LEFT JOIN pos p2 ON p2.k = o.k - 2)
SELECT a.c, a.t, CAST(NOT a.paid AND (coalesce(b.paid, false) OR coalesce(d.paid, false)) AS INTEGER) AS f_perdio_payroll, CAST(greatest(greatest(b.prod, d.prod) - a.prod, 0) AS INTEGER) AS n_productos_perdidos,
CAST(a.k > 1 AND coalesce(a.vst, 0) > greatest(coalesce(b.vst, 0), CASE WHEN a.k > 2 THEN coalesce(d.vst, 0) ELSE coalesce(b.vst, 0) END) AS INTEGER) AS f_visa_sube,
CAST(a.k > 1 AND coalesce(a.mst, 0) > greatest(coalesce(b.mst, 0), CASE WHEN a.k > 2 THEN coalesce(d.mst, 0) ELSE coalesce(b.mst, 0) END) AS INTEGER) AS f_master_sube,
CAST(CASE WHEN a.trx > 0 THEN 0 WHEN b.trx > 0 THEN a.i - i1 WHEN d.trx > 0 THEN a.i - i2 WHEN a.k > 2 THEN 3 END AS INTEGER) AS meses_desde_trx, CAST(CASE WHEN a.visa > 0 THEN 0 WHEN b.visa > 0 THEN a.i - i1 WHEN d.visa > 0 THEN a.i - i2 WHEN a.k > 2 THEN 3 END AS INTEGER) AS meses_desde_consumo,
round(a.saldo / nullif(greatest(a.saldo, b.saldo, d.saldo, 0), 0), 6) AS r_saldo_vs_max, round(a.limite / nullif(greatest(a.limite, b.limite, d.limite, 0), 0), 6) AS r_limite_vs_max,
CASE WHEN coalesce(a.trx < b.trx, false) THEN 1 + coalesce(b.trx < d.trx, false)::INTEGER ELSE 0 END AS racha_caida
FROM a JOIN cal ON cal.t = a.t LEFT JOIN a b ON b.c = a.c AND b.k = a.k - 1 LEFT JOIN a d ON d.c = a.c AND d.k = a.k - 2"""
)
def w14_behaviour(spark: SparkSession, sf: str) -> DataFrame:
    """The behaviour events against self-joins on the place of the month."""
    spec = Behaviour(
        payroll=("nomina",), products="prod", status={"f_visa_sube": "vst", "f_master_sube": "mst"}, recency={"meses_desde_trx": ("trx > 0", ("trx",)), "meses_desde_consumo": ("visa > 0", ("visa",))},
        balances={"r_saldo_vs_max": "saldo", "r_limite_vs_max": "limite"}, activity=("racha_caida", "trx"),
    )
    p = dense_panel(monthly(spark, sf, "nomina", "prod", "vst", "mst", "trx", "visa", "saldo", "limite"), "c", "t")
    b = add_behaviour(p, "c", "t", spec, Catalog()).where("present = 1")
    rounded = [F.round(r, 6).alias(r) for r in ("r_saldo_vs_max", "r_limite_vs_max")]
    return b.select("c", "t", "f_perdio_payroll", "n_productos_perdidos", "f_visa_sube", "f_master_sube", "meses_desde_trx", "meses_desde_consumo", *rounded, "racha_caida")


@query(
    sql=f"WITH {M_SQL}, e AS (SELECT c, t, -coalesce(antig, 3) AS r, coalesce(trx, 0) AS f, coalesce(saldo, 0) AS a FROM m), " + ", ".join(counted(f"q_{k}", k, "e") for k in "rfa") + " SELECT e.c, e.t, CAST("
    + " + ".join(f"least(1 + floor(5 * ({placed(f'q_{k}')}) + 1e-9), 5)" for k in "rfa") + " AS INTEGER) AS rfm_score FROM e " + " ".join(f"JOIN q_{k} ON q_{k}.t = e.t AND q_{k}.x = e.{k}" for k in "rfa")
)
def w15_rfm(spark: SparkSession, sf: str) -> DataFrame:
    return rfm_score(monthly(spark, sf, "antig", "trx", "saldo"), "t", ["c"], "antig", "trx", "saldo")


@query(sql="SELECT modelo, foto_mes, numero_de_cliente, rank() OVER w + (count(*) OVER (PARTITION BY modelo, foto_mes, prob) - 1) / 2.0::DOUBLE AS avg_rank FROM (SELECT modelo, foto_mes, numero_de_cliente, max(prob) AS prob FROM puntajes WHERE numero_de_cliente IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) AND prob BETWEEN 0 AND 1 GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY modelo, foto_mes ORDER BY prob)")
def w19_average_rank(spark: SparkSession, sf: str) -> DataFrame:
    return average_rank(scores(spark, sf), ["modelo", "foto_mes"], "prob").select("modelo", "foto_mes", "numero_de_cliente", "avg_rank")


# The feature table under the pipeline's own names: amounts and counts of a client and month added up, of the rest the largest.
_SUMMED = (
    "mrentabilidad", "mrentabilidad_annual", "mcomisiones", "mactivos_margen", "mpasivos_margen", "mcuenta_corriente", "mcaja_ahorro", "mcuentas_saldo", "mautoservicio", "mtarjeta_visa_consumo", "mpayroll",
    "master_mlimitecompra", "master_msaldototal", "visa_mlimitecompra", "visa_msaldototal",
)
_ADDED = ("ctrx_quarter", "cpayroll_trx", "ctarjeta_debito_transacciones", "ctarjeta_visa_transacciones", "chomebanking_transacciones")
_LARGEST = ("cproductos", "cliente_edad", "cliente_antiguedad", "master_status", "visa_status", "master_fechaalta", "visa_fechaalta", "active_quarter", "cliente_vip", "internet", "tcuentas", "tmobile_app")
_WIDE_SQL = (
    V_SQL + ", w AS (SELECT numero_de_cliente AS c, foto_mes AS t, " + ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(27, 2))) AS DOUBLE) AS {c}" for c in _SUMMED) + ", " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _ADDED) + ", "
    + ", ".join(f"max({c}) AS {c}" for c in _LARGEST) + " FROM v WHERE numero_de_cliente IS NOT NULL AND foto_mes IS NOT NULL GROUP BY 1, 2)"
)


def wide_months(spark: SparkSession, sf: str) -> DataFrame:
    """One row per client and month with all numeric columns of the landing table, under their names."""
    v = valid(spark, sf, "numero_de_cliente", "foto_mes", *_SUMMED, *_ADDED, *_LARGEST).where("numero_de_cliente is not null and foto_mes is not null")
    return v.groupBy(F.col("numero_de_cliente").alias("c"), F.col("foto_mes").alias("t")).agg(
        *[F.sum(F.col(x).cast("decimal(27,2)")).cast("double").alias(x) for x in _SUMMED], *[F.sum(x).cast("long").alias(x) for x in _ADDED], *[F.max(x).alias(x) for x in _LARGEST]
    )


DECILES = ("mrentabilidad", "mcuentas_saldo", "ctrx_quarter", "cproductos")
PLAN = FeaturePlan(
    rows=row_spec("partial"), series_fields=SERIES_FIELDS, series=SeriesSpec(trend_against="cliente_antiguedad"), rank_fields=RANK_FIELDS, decile_fields=DECILES, calendar="observed", behaviour=behaviour_spec(),
    rfm=("meses_desde_trx", "ctrx_quarter", "mcuentas_saldo"),
)


def _compressed(df: DataFrame) -> DataFrame:
    """Doubles on a signed log scale with four decimals: sums of doubles depend on their order."""
    log = lambda c: F.round(F.signum(c) * F.log1p(F.abs(c)), 4) + F.lit(0.0)
    return df.select(*[log(F.col(c)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in df.dtypes])


@query(sql=plan_sql(_WIDE_SQL))
def plan_features(spark: SparkSession, sf: str) -> DataFrame:
    """The whole feature table of the pipeline's families as far as the landing table has their sources, doubles on a log scale."""
    return _compressed(build_features(wide_months(spark, sf), "c", "t", PLAN)[0])


@query
def plan_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog of the feature table, without reading it."""
    return features.plan_catalog(wide_months(spark, sf), "c", "t", PLAN).to_df(spark)


RESCALED = FeaturePlan(rows=RowSpec(sums={"suma": ("saldo", "rent")}), series_fields=("saldo", "suma"), series=SeriesSpec(lags=(1,), deltas=(1,), delta_pcts=(), stats=("max",), ratio=False), rescaled=("saldo", "suma"), calendar="observed")
_RESCALED_SQL = {f: _signed_sql(f, "e") for f in ("saldo", "suma")}


@query(
    sql=f"WITH {M_SQL}, e AS (SELECT c, t, saldo, coalesce(saldo, 0) + coalesce(rent, 0) AS suma FROM m), " + ", ".join(s for s, _, _ in _RESCALED_SQL.values()) + ", pos AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM m)), a AS (SELECT e.c, e.t, k, "
    + ", ".join(f"{x} AS {f}" for f, (_, _, x) in _RESCALED_SQL.items()) + " FROM e JOIN pos ON pos.t = e.t " + " ".join(j for _, j, _ in _RESCALED_SQL.values()) + ") SELECT a.c, a.t, round(a.saldo, 8) AS saldo, round(a.suma, 8) AS suma, round(b.saldo, 8) AS lag_1_saldo, "
    "round(a.suma - b.suma + 3e-11, 8) AS delta_1_suma, round(greatest(a.saldo, b.saldo, d.saldo, g.saldo), 8) AS max_3_saldo FROM a LEFT JOIN a b ON b.c = a.c AND b.k = a.k - 1 LEFT JOIN a d ON d.c = a.c AND d.k = a.k - 2 LEFT JOIN a g ON g.c = a.c AND g.k = a.k - 3"
)
def plan_rescaled(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts rescaled before sums and series are made of them."""
    d = build_features(monthly(spark, sf, "saldo", "rent").drop("clase", "n"), "c", "t", RESCALED)[0]
    r = lambda c, e=0.0: F.round(F.col(c) + F.lit(e), 8).alias(c)
    return d.select("c", "t", r("saldo"), r("suma"), r("lag_1_saldo"), r("delta_1_suma", OFF_TIES), r("max_3_saldo"))


@query(sql="SELECT bloque, feature, expresion, origen FROM catalogo")
def d8_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The stored catalog; a feature named twice is refused."""
    c = table(spark, sf, "catalogo")
    if not c.groupBy("feature").count().where("count > 1").isEmpty():
        raise ValueError("a feature stands twice in the catalog")
    return c.select("bloque", "feature", "expresion", "origen")
