"""Sources and sinks: every round trip goes through shared storage and comes back equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.plans.base import V_SQL, scores, valid
from cohortex.plans.catalog import query, table
from cohortex.sources import io
from cohortex.staging import shared_root


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query(sql="SELECT par_id, cliente_a, cliente_b FROM pares_control")
def s1_csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """CSV with a header out and in; all rows decide the types."""
    p = _place(spark, "pares.csv")
    io.write_csv(table(spark, sf, "pares_control"), p)
    return io.read_csv(spark, p).withColumns({c: F.col(c).cast("long") for c in ("par_id", "cliente_a", "cliente_b")})


@query(sql="SELECT modelo, foto_mes, numero_de_cliente FROM puntajes")
def s2_csv_forced_types(spark: SparkSession, sf: str) -> DataFrame:
    """Ids forced to long never pass through floats."""
    p = _place(spark, "puntajes.csv")
    io.write_csv(table(spark, sf, "puntajes").select("modelo", "foto_mes", "numero_de_cliente"), p)
    return io.read_csv(spark, p, forced={"numero_de_cliente": "bigint", "foto_mes": "int"})


@query(sql="SELECT foto_mes, numero_de_cliente, cproductos FROM competencia_01 WHERE foto_mes IN (202104, 202105)")
def s4_parquet_pushdown(spark: SparkSession, sf: str) -> DataFrame:
    """Two months and three columns: both reach the scan."""
    return io.read_parquet(spark, f"{sf}/competencia_01.parquet", ["foto_mes", "numero_de_cliente", "cproductos"], foto_mes=[202104, 202105])


@query(sql="SELECT reingreso_id, cliente_anterior, cliente_nuevo FROM reingresos")
def s6_csv_gzip(spark: SparkSession, sf: str) -> DataFrame:
    p = _place(spark, "reingresos.csv.gz")
    table(spark, sf, "reingresos").select("reingreso_id", "cliente_anterior", "cliente_nuevo").write.option("header", True).option("compression", "gzip").csv(p)
    return io.read_csv(spark, p, "reingreso_id long, cliente_anterior long, cliente_nuevo long")


@query(sql=f"WITH {V_SQL} SELECT registro_id, numero_de_cliente, foto_mes, mcuentas_saldo FROM v")
def s9_parquet_swap(spark: SparkSession, sf: str) -> DataFrame:
    """zstd Parquet by month, written beside and swapped in, twice."""
    p = _place(spark, "panel")
    v = valid(spark, sf, "numero_de_cliente", "foto_mes", "mcuentas_saldo")
    io.write_parquet(v.limit(0), p)
    io.write_parquet(v, p, by=["foto_mes"])
    return spark.read.parquet(p).select("registro_id", "numero_de_cliente", F.col("foto_mes").cast("int").alias("foto_mes"), "mcuentas_saldo")


@query(sql="SELECT numero_de_cliente FROM (SELECT numero_de_cliente, max(prob) AS p FROM puntajes WHERE modelo = 'modelo_a' AND foto_mes = 202108 AND numero_de_cliente IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) AND prob BETWEEN 0 AND 1 GROUP BY 1) ORDER BY p DESC, numero_de_cliente LIMIT 50")
def s11_id_list(spark: SparkSession, sf: str) -> DataFrame:
    """The list of the 50 best, written, read back as text and validated: the sink's own size is 50."""
    from cohortex.operators.metrics import top_n

    s = scores(spark, sf).where("modelo = 'modelo_a' and foto_mes = 202108")
    n = min(50, s.count())
    p = _place(spark, "ids")
    if n == 0:
        return s.select("numero_de_cliente")
    io.write_id_list(top_n(s, "numero_de_cliente", "prob", n), "numero_de_cliente", p, n, valid(spark, sf, "numero_de_cliente").select("numero_de_cliente"))
    return spark.read.text(p).select(F.col("value").cast("long").alias("numero_de_cliente"))


@query(sql="SELECT modelo, count(*) AS n FROM puntajes WHERE modelo IS NOT NULL GROUP BY 1")
def s12_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """A folder per model in one pass."""
    p = _place(spark, "envios")
    io.write_csv(table(spark, sf, "puntajes").where("modelo is not null"), p, by=["modelo"])
    return spark.read.option("header", True).csv(p).groupBy("modelo").agg(F.count(F.lit(1)).alias("n"))


@query(sql="SELECT column_name AS \"column\", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp' END AS \"type\" FROM (DESCRIBE competencia_01)")
def s14_schema(spark: SparkSession, sf: str) -> DataFrame:
    s = io.schema_table(table(spark, sf, "competencia_01"))
    return s.select("column", F.regexp_replace("type", "timestamp_ntz", "timestamp").alias("type"))


@query(sql="SELECT 'run_' || k AS run, 'ok' AS state, CASE WHEN k = 1 THEN 0 ELSE 1 END AS has_files FROM (VALUES (1), (2)) x(k)")
def s18_run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs appended to the ledger, the second with the hashes of what it wrote."""
    p, out = _place(spark, "corridas"), _place(spark, "salida")
    io.write_csv(table(spark, sf, "division_objetivo"), out)
    io.append_run(spark, p, "run_1", {"semilla": 104729})
    io.append_run(spark, p, "run_2", {"semilla": 104729}, outputs=out)
    hashed = F.size(F.filter("files", lambda f: F.length(f["sha256"]) == 64))
    return spark.read.parquet(p).select("run", "state", (hashed > 0).cast("int").alias("has_files"))


@query(
    sql="""WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, value FROM events WHERE ts IS NOT NULL), h AS (SELECT max(day) AS last FROM e)
SELECT day, user_id, count(*) AS n, round(sum(value), 4) AS total FROM e, h WHERE day < last - 2 GROUP BY 1, 2"""
)
def stream_daily_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of daily files in order into the days that the watermark of two days has finished; a row of a finished day that comes late is left out."""
    from cohortex.streaming.panel_stream import daily_totals, landing_stream, run_to_table

    src, out, at = _place(spark, "stream-in"), _place(spark, "stream-out"), _place(spark, "stream-at")
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value").where("ts is not null")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    e.where(F.col("ts") < F.lit(last)).write.parquet(src)
    run_to_table(daily_totals(landing_stream(spark, src, e.schema, 1_000), "ts", "user_id", "value", "2 days"), out, at)
    late = spark.createDataFrame([(-1, 1e9)], "user_id long, value double").select(F.lit(first).alias("ts"), "user_id", "value")
    e.where(F.col("ts") >= F.lit(last)).write.mode("append").parquet(src)
    run_to_table(daily_totals(landing_stream(spark, src, e.schema, 1_000), "ts", "user_id", "value", "2 days"), out, at)
    late.write.mode("append").parquet(src)  # its day is finished
    q = run_to_table(daily_totals(landing_stream(spark, src, e.schema, 1_000), "ts", "user_id", "value", "2 days"), out, at)
    assert q.exception() is None
    done = spark.read.schema("day date, user_id long, n long, total double").parquet(out)
    end = F.date_sub(F.lit(last).cast("date"), 2)
    return done.where(F.col("day") < end).select("day", "user_id", "n", F.round("total", 4).alias("total"))
