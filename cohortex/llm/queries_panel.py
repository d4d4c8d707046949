"""Queries of problems 2 to 6 over the client-month panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.llm.clusters import describe_clusters, similar_groups, usual_levels
from cohortex.llm.queries import VALID_SQL, panel, query, table
from cohortex.llm.sampling import Sample, proportional_sample
from cohortex.llm.sketches import median_jumps, merge_sketches, percentiles, sketch_fields
from cohortex.llm.splits import leaking_entities, split_records
from cohortex.llm.topn import top_n_banded
from cohortex.staging import stage

PERSON_SQL = f"""WITH RECURSIVE {VALID_SQL},
e AS (SELECT DISTINCT cliente_anterior a, cliente_nuevo b FROM reingresos WHERE cliente_anterior IS NOT NULL AND cliente_nuevo IS NOT NULL),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON r.other = u.a),
comp AS (SELECT node, min(other) AS person FROM reach GROUP BY node),
who AS (SELECT v.*, coalesce(c.person, v.numero_de_cliente) AS person FROM v LEFT JOIN comp c ON v.numero_de_cliente = c.node WHERE v.numero_de_cliente IS NOT NULL)"""


@query(
    sql=PERSON_SQL
    + """, bad AS (SELECT person FROM who WHERE trim(particion) <> '' GROUP BY person HAVING count(DISTINCT lower(trim(particion))) >= 2)
SELECT DISTINCT numero_de_cliente FROM who WHERE person IN (SELECT person FROM bad)"""
)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    v = panel(spark, sf, "numero_de_cliente", "particion")
    return leaking_entities(v, "numero_de_cliente", "particion", table(spark, sf, "reingresos"), "cliente_anterior", "cliente_nuevo")


def _split(spark: SparkSession, sf: str) -> DataFrame:
    shares = {r["particion"]: r["proporcion"] for r in table(spark, sf, "division_objetivo").select("particion", "proporcion").collect()}
    return split_records(panel(spark, sf, "numero_de_cliente"), "numero_de_cliente", table(spark, sf, "reingresos"), "cliente_anterior", "cliente_nuevo", shares)


@query
def p2_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every client with its person and its split; records follow their client."""
    return _split(spark, sf).select("numero_de_cliente", "person", "split")


@query(
    sql=f"""WITH {VALID_SQL}, n AS (SELECT count(*) AS n FROM v WHERE numero_de_cliente IS NOT NULL),
d AS (SELECT particion, proporcion / sum(proporcion) OVER () * n.n AS goal, row_number() OVER (ORDER BY proporcion DESC, particion DESC) AS k, n.n FROM division_objetivo, n),
r AS (SELECT *, CASE WHEN k > 1 THEN CAST(ceil(goal - 0.5) AS BIGINT) END AS got FROM d)
SELECT particion AS split, coalesce(got, n - sum(got) OVER ())::BIGINT AS records, round(goal, 6) AS target, round(coalesce(got, n - sum(got) OVER ()) - goal, 6) AS gap FROM r"""
)
def p2_split_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Records of each split, what its share asks for, and the gap.  The SQL holds where every total can be reached, as with many persons of few records."""
    goals = table(spark, sf, "division_objetivo").select("particion", "proporcion")
    s = _split(spark, sf).groupBy("split").agg(F.sum("n").alias("records"))
    all_ = goals.agg(F.sum("proporcion").alias("w")).crossJoin(s.agg(F.sum("records").alias("n")))  # one row each
    j = goals.crossJoin(all_).join(s, F.col("particion") == F.col("split"), "left")  # one row a split
    r, t = F.coalesce("records", F.lit(0)), F.col("proporcion") / F.col("w") * F.col("n")
    return j.select(F.col("particion").alias("split"), r.alias("records"), F.round(t, 6).alias("target"), F.round(r - t, 6).alias("gap"))


@query
def p2_split_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Records, persons and reached share of each split."""
    s = _split(spark, sf).groupBy("split").agg(F.sum("n").alias("records"), F.countDistinct("person").alias("persons"))
    return s.crossJoin(s.agg(F.sum("records").alias("all_records"))).select("split", "records", "persons", (F.col("records") / F.col("all_records")).alias("share"))


@query(
    sql=f"""WITH {VALID_SQL}
SELECT numero_de_cliente, registro_id FROM v WHERE ctrx_quarter IS NOT NULL AND numero_de_cliente IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY numero_de_cliente ORDER BY ctrx_quarter DESC, foto_mes DESC NULLS LAST, registro_id) <= 3"""
)
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    v = panel(spark, sf, "numero_de_cliente", "foto_mes", "ctrx_quarter")
    ties = [F.col("foto_mes").desc_nulls_last(), F.col("registro_id").asc()]
    return top_n_banded(v, "numero_de_cliente", "ctrx_quarter", ties, 3, ["registro_id", "foto_mes"]).select("numero_de_cliente", "registro_id")


def _category(month: str, label: str):
    """``YYYYMM|CLASS``, the class in upper case without blanks; null when either is missing."""
    c = F.upper(F.regexp_replace(label, r"\s+", ""))
    return F.when(F.col(month).isNotNull() & (c != ""), F.concat(F.col(month).cast("string"), F.lit("|"), c))


def _sample(spark: SparkSession, sf: str, **how) -> Sample:
    v = valid_labelled(spark, sf)
    goals = table(spark, sf, "objetivo_muestra").withColumn("category", _category("foto_mes", "clase_ternaria"))
    return proportional_sample(v, "registro_id", "category", goals, "proporcion", "minimo", 0.1, **how)


def valid_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Valid records with a class; a missing month makes a category of its own, so that every labelled record counts."""
    c = F.upper(F.regexp_replace("clase_ternaria", r"\s+", ""))
    v = panel(spark, sf, "foto_mes", "clase_ternaria")
    return v.where(c != "").select("registro_id", F.concat_ws("|", F.coalesce(F.col("foto_mes").cast("string"), F.lit("")), c).alias("category"))


@query(
    sql=f"""WITH {VALID_SQL},
l AS (SELECT foto_mes, upper(regexp_replace(clase_ternaria, '\\s+', '', 'g')) AS c FROM v WHERE regexp_replace(clase_ternaria, '\\s+', '', 'g') <> ''),
n AS (SELECT foto_mes, c, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT count(*) // 10 AS s FROM l)
SELECT o.foto_mes, o.clase_ternaria FROM objetivo_muestra o CROSS JOIN s
LEFT JOIN n ON n.foto_mes = o.foto_mes AND n.c = upper(regexp_replace(o.clase_ternaria, '\\s+', '', 'g'))
WHERE coalesce(n.n, 0) < greatest(o.minimo, o.proporcion * s.s)"""
)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    goals = table(spark, sf, "objetivo_muestra").select("foto_mes", "clase_ternaria", _category("foto_mes", "clase_ternaria").alias("category"))
    unmet = _sample(spark, sf).report.where("not met").select("category")
    return goals.join(unmet, "category", "left_semi").select("foto_mes", "clase_ternaria")


@query
def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sampled records."""
    s = _sample(spark, sf).rows
    parts = F.split("category", r"\|")
    return s.select("registro_id", parts[0].cast("int").alias("foto_mes"), parts[1].alias("clase_ternaria"))


_REPORT_SQL = f"""WITH {VALID_SQL},
l AS (SELECT foto_mes, upper(regexp_replace(clase_ternaria, '\\s+', '', 'g')) AS c FROM v WHERE regexp_replace(clase_ternaria, '\\s+', '', 'g') <> ''),
n AS (SELECT foto_mes, c, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT count(*) // 10 AS s FROM l),
w AS (SELECT o.foto_mes || '|' || upper(regexp_replace(o.clase_ternaria, '\\s+', '', 'g')) AS category, o.proporcion AS share, o.minimo AS minimum, greatest(o.minimo, o.proporcion * s.s) AS wanted, coalesce(n.n, 0) AS available, o.proporcion * s.s AS plain
  FROM objetivo_muestra o CROSS JOIN s LEFT JOIN n ON n.foto_mes = o.foto_mes AND n.c = upper(regexp_replace(o.clase_ternaria, '\\s+', '', 'g'))),
f AS (SELECT {{scale}} AS k FROM w), q AS (SELECT w.*, least(available, CAST(ceil(greatest(minimum, k * plain) - 1e-9) AS BIGINT)) AS quota FROM w, f)
SELECT category, share, CAST(minimum AS INTEGER) AS minimum, round(wanted, 6) AS wanted, available, quota, available >= wanted - 1e-9 AS met, round(quota::DOUBLE / sum(quota) OVER (), 9) AS reached_share FROM q"""


def _rounded(report: DataFrame) -> DataFrame:
    return report.withColumns({"wanted": F.round("wanted", 6), "reached_share": F.round("reached_share", 9)})


@query(sql=_REPORT_SQL.format(scale="max(1.0::DOUBLE)"))
def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted, available and drawn rows of every target category."""
    return _rounded(_sample(spark, sf).report)


@query(sql=_REPORT_SQL.format(scale="least(1.0::DOUBLE, min(CASE WHEN plain > 0 AND available > 0 THEN available / plain END))"))
def p5_kept_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the largest sample that keeps the shares of all categories with rows."""
    return _rounded(_sample(spark, sf, keep_shares=True).report)


@query(sql=f"SELECT category, quota AS drawn FROM ({_REPORT_SQL.format(scale='max(1.0::DOUBLE)')}) WHERE quota > 0")
def p5_drawn(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the sample by category: exactly the quotas."""
    return _sample(spark, sf).rows.groupBy("category").agg(F.count(F.lit(1)).alias("drawn"))


AMOUNTS = ["mpayroll", "mrentabilidad"]
PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query(
    sql=f"""WITH {VALID_SQL}, months AS (SELECT foto_mes, median(mpayroll) AS mpayroll, median(mrentabilidad) AS mrentabilidad FROM v WHERE foto_mes IS NOT NULL GROUP BY 1),
long AS (SELECT foto_mes, 'mpayroll' AS campo, mpayroll AS m FROM months UNION ALL SELECT foto_mes, 'mrentabilidad', mrentabilidad FROM months),
p AS (SELECT *, lag(m) OVER (PARTITION BY campo ORDER BY foto_mes) AS prev FROM long)
SELECT foto_mes, campo FROM p WHERE abs(m - prev) > abs(prev) / 2"""
)
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    v = stage(panel(spark, sf, "foto_mes", *AMOUNTS).where("foto_mes is not null"), "amounts")
    return median_jumps(v, "foto_mes", AMOUNTS, 0.5).withColumnRenamed("field", "campo")


@query
def p6_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per month from the sketches, with the bounds of their stated rank error."""
    s = sketch_fields(panel(spark, sf, "foto_mes", *AMOUNTS), "foto_mes", AMOUNTS)
    return percentiles(s, PERCENTILES).select(F.col("grp").cast("int").alias("foto_mes"), F.col("field").alias("campo"), "p", "n", "value", "lo", "hi")


@query
def p6_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per calendar year, from the monthly sketches alone."""
    s = sketch_fields(panel(spark, sf, "foto_mes", *AMOUNTS), "foto_mes", AMOUNTS)
    years = merge_sketches(s.withColumn("grp", F.substring("grp", 1, 4)))
    return percentiles(years, PERCENTILES).select(F.col("grp").cast("int").alias("year"), F.col("field").alias("campo"), "p", "n", "value", "lo", "hi")


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    v = panel(spark, sf, "numero_de_cliente", "mrentabilidad", "cproductos")
    levels = stage(usual_levels(v, "numero_de_cliente", ["mrentabilidad", "cproductos"]), "levels")
    return similar_groups(levels, "numero_de_cliente", "mrentabilidad", "cproductos")


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    g = stage(_groups(spark, sf).select("numero_de_cliente", "cluster"), "groups")
    side = lambda c: g.select(F.col("numero_de_cliente").alias(c), F.col("cluster").alias(f"{c}_cluster"))
    pairs = table(spark, sf, "pares_control").join(side("cliente_a"), "cliente_a").join(side("cliente_b"), "cliente_b")
    return pairs.where("cliente_a_cluster = cliente_b_cluster").select("cliente_a", "cliente_b")


@query
def p3_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every cluster's size and its three most typical clients."""
    return describe_clusters(stage(_groups(spark, sf), "members"), "numero_de_cliente")


@query
def p3_members(spark: SparkSession, sf: str) -> DataFrame:
    """The cluster of every client."""
    return _groups(spark, sf)
