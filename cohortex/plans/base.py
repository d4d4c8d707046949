"""The tables that the core's queries start from, and their SQL.

``v``: current records; ``m``: one row per client and month, amounts summed
exactly; ``s``: clean scores with labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.operators.latest import valid_records
from cohortex.operators.metrics import clean_scores
from cohortex.plans.catalog import query, table

AMOUNTS = {
    "saldo": "mcuentas_saldo", "rent": "mrentabilidad", "payroll": "mpayroll", "visa": "mtarjeta_visa_consumo", "limite": "visa_mlimitecompra",
    "comis": "mcomisiones", "msaldo": "master_msaldototal", "vsaldo": "visa_msaldototal",
}
COUNTS = {"trx": "ctrx_quarter", "nomina": "cpayroll_trx", "debito": "ctarjeta_debito_transacciones"}
MAXIMA = {"prod": "cproductos", "antig": "cliente_antiguedad", "edad": "cliente_edad", "vst": "visa_status", "mst": "master_status"}
LABEL = "upper(regexp_replace(clase_ternaria, '\\\\s+', ''))"

_PARTS = [
    *(f"CAST(sum(CAST({c} AS DECIMAL(27, 2))) AS DOUBLE) AS {n}" for n, c in AMOUNTS.items()),
    *(f"CAST(sum({c}) AS BIGINT) AS {n}" for n, c in COUNTS.items()),
    *(f"max({c}) AS {n}" for n, c in MAXIMA.items()),
]
V_SQL = """v AS (SELECT * FROM competencia_01 WHERE registro_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY registro_id ORDER BY fecha_carga DESC NULLS LAST, fila_id DESC NULLS LAST) = 1)"""
M_SQL = (
    V_SQL
    + ", m AS (SELECT numero_de_cliente AS c, foto_mes AS t, count(*) AS n, "
    + ", ".join(_PARTS)
    + ", max(upper(regexp_replace(clase_ternaria, '\\s+', '', 'g'))) AS clase FROM v WHERE numero_de_cliente IS NOT NULL AND foto_mes IS NOT NULL GROUP BY 1, 2)"
)
S_SQL = (
    M_SQL
    + """, s AS (SELECT p.*, coalesce(m.clase = 'BAJA+2', false) AS y FROM (SELECT modelo, foto_mes, numero_de_cliente, max(prob) AS prob FROM puntajes
  WHERE numero_de_cliente IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) AND prob BETWEEN 0 AND 1 GROUP BY 1, 2, 3) p
  LEFT JOIN m ON m.c = p.numero_de_cliente AND m.t = p.foto_mes)"""
)


def valid(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return valid_records(table(spark, sf, "competencia_01"), *columns)


def monthly(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """Client and month (``c, t``), ``n``, ``clase`` and the chosen fields (all, if none is named)."""
    want = list(fields) or [*AMOUNTS, *COUNTS, *MAXIMA]
    src = {**AMOUNTS, **COUNTS, **MAXIMA}
    v = valid(spark, sf, "numero_de_cliente", "foto_mes", "clase_ternaria", *dict.fromkeys(src[f] for f in want))
    aggs = []
    for f in want:
        if f in AMOUNTS:
            aggs.append(F.sum(F.col(src[f]).cast("decimal(27,2)")).cast("double").alias(f))
        elif f in COUNTS:
            aggs.append(F.sum(src[f]).cast("long").alias(f))
        else:
            aggs.append(F.max(src[f]).alias(f))
    known = v.where("numero_de_cliente is not null and foto_mes is not null")
    return known.groupBy(F.col("numero_de_cliente").alias("c"), F.col("foto_mes").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), *aggs, F.max(F.upper(F.regexp_replace("clase_ternaria", r"\s+", ""))).alias("clase")
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """``modelo, foto_mes, numero_de_cliente, prob, y``: clean scores and whether the client left two months on."""
    p = clean_scores(table(spark, sf, "puntajes"), ["modelo", "foto_mes"], "numero_de_cliente", "prob")
    m = monthly(spark, sf, "prod").select("c", "t", "clase")
    return p.join(m, (F.col("c") == F.col("numero_de_cliente")) & (F.col("t") == F.col("foto_mes")), "left").select(*p.columns, F.coalesce(F.col("clase") == "BAJA+2", F.lit(False)).alias("y"))


def same_sql(name: str, text: str, duck: str | None = None, *, needs: str = "m", doc: str = "") -> None:
    """Register a query whose SQL both engines run over ``v``, ``m``, ``s`` and the plain tables; ``duck`` where DuckDB spells it otherwise."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        views = {"m": lambda: monthly(spark, sf), "s": lambda: scores(spark, sf), "v": lambda: valid(spark, sf, *[c for c in table(spark, sf, "competencia_01").columns if c != "registro_id"])}
        for k in needs.split():
            (views[k]() if k in views else table(spark, sf, k)).createOrReplaceTempView(k)
        return spark.sql(text)

    run.__name__, run.__doc__ = name, doc
    ctes = S_SQL if "s" in needs.split() else M_SQL if "m" in needs.split() else V_SQL if "v" in needs.split() else ""
    body = duck or text
    query(sql=(f"WITH {ctes}" + (", " + body[5:] if body.lstrip().upper().startswith("WITH ") else " " + body)) if ctes else body)(run)
