"""Problem 1: totals and averages over trailing periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.operators.latest import valid_records
from cohortex.operators.rolling import rolling_totals
from cohortex.plans.catalog import query, table

_MONTHLY_SQL = """WITH v AS (SELECT * FROM competencia_01 WHERE registro_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY registro_id ORDER BY fecha_carga DESC NULLS LAST, fila_id DESC NULLS LAST) = 1),
m AS (SELECT numero_de_cliente AS e, (foto_mes // 100) * 12 + foto_mes % 100 - 1 AS t,
  sum(coalesce(CAST(ctrx_quarter AS DECIMAL(27, 4)), 0)) AS c, sum(coalesce(CAST(mcuentas_saldo AS DECIMAL(27, 4)), 0)) AS s
  FROM v WHERE numero_de_cliente IS NOT NULL AND foto_mes % 100 BETWEEN 1 AND 12 GROUP BY 1, 2),
spine AS (SELECT e, unnest(generate_series(min(t), max(t))) AS t FROM m GROUP BY e),
d AS (SELECT spine.e, spine.t, coalesce(c, 0) AS c, coalesce(s, 0) AS s FROM spine LEFT JOIN m ON m.e = spine.e AND m.t = spine.t),
r AS (SELECT e, CAST((t // 12) * 100 + t % 12 + 1 AS INTEGER) AS foto_mes, sum(c) OVER w3 AS c3, sum(c) OVER w6 AS c6, sum(s) OVER w3 AS s3, sum(s) OVER w6 AS s6 FROM d
  WINDOW w3 AS (PARTITION BY e ORDER BY t ROWS 2 PRECEDING), w6 AS (PARTITION BY e ORDER BY t ROWS 5 PRECEDING))
"""


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    v = valid_records(table(spark, sf, "competencia_01"), "numero_de_cliente", "foto_mes", "ctrx_quarter", "mcuentas_saldo")
    return rolling_totals(v, "numero_de_cliente", "foto_mes", ["ctrx_quarter", "mcuentas_saldo"], [3, 6])


@query(sql=_MONTHLY_SQL + "SELECT e AS numero_de_cliente, foto_mes FROM r WHERE c3 = 0 AND c6 > 0 AND s3 > 0")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    r = _monthly(spark, sf)
    return r.where("ctrx_quarter_total_3 = 0 and ctrx_quarter_total_6 > 0 and mcuentas_saldo_total_3 > 0").select("numero_de_cliente", "foto_mes")


@query(
    sql=_MONTHLY_SQL
    + """SELECT e AS numero_de_cliente, foto_mes, CAST(c3 AS DOUBLE) AS ctrx_quarter_total_3, round(CAST(c3 AS DOUBLE) / 3, 6) AS ctrx_quarter_avg_3,
CAST(c6 AS DOUBLE) AS ctrx_quarter_total_6, round(CAST(c6 AS DOUBLE) / 6, 6) AS ctrx_quarter_avg_6, CAST(s3 AS DOUBLE) AS mcuentas_saldo_total_3,
round(CAST(s3 AS DOUBLE) / 3, 6) AS mcuentas_saldo_avg_3, CAST(s6 AS DOUBLE) AS mcuentas_saldo_total_6, round(CAST(s6 AS DOUBLE) / 6, 6) AS mcuentas_saldo_avg_6 FROM r"""
)
def p1_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Every client and month with the 3- and 6-month totals and averages."""
    r = _monthly(spark, sf)
    return r.select(*[F.round(c, 6).alias(c) if "_avg_" in c else F.col(c).cast("double").alias(c) if "_total_" in c else F.col(c) for c in r.columns])


@query(
    sql="""WITH m AS (SELECT user_id AS e, CAST(ts AS DATE) AS t, sum(CAST(value AS DECIMAL(27, 4))) AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
spine AS (SELECT e, CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM m GROUP BY e),
d AS (SELECT spine.e, spine.t, coalesce(v, 0) AS v FROM spine LEFT JOIN m ON m.e = spine.e AND m.t = spine.t)
SELECT e AS user_id, t AS ts, CAST(sum(v) OVER w7 AS DOUBLE) AS value_total_7, round(CAST(sum(v) OVER w7 AS DOUBLE) / 7, 6) AS value_avg_7,
CAST(sum(v) OVER w30 AS DOUBLE) AS value_total_30, round(CAST(sum(v) OVER w30 AS DOUBLE) / 30, 6) AS value_avg_30 FROM d
WINDOW w7 AS (PARTITION BY e ORDER BY t ROWS 6 PRECEDING), w30 AS (PARTITION BY e ORDER BY t ROWS 29 PRECEDING)"""
)
def p1_daily(spark: SparkSession, sf: str) -> DataFrame:
    """7- and 30-day totals of every user's events, days without events included."""
    r = rolling_totals(table(spark, sf, "events"), "user_id", "ts", ["value"], [7, 30], calendar="day")
    return r.select(*[F.round(c, 6).alias(c) if "_avg_" in c else F.col(c).cast("double").alias(c) if "_total_" in c else F.col(c) for c in r.columns])
