"""Reading and writing tables and validated id lists."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.staging import _fs


def read_csv(spark: SparkSession, path: str, schema: str | None = None, forced: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header, plain or gzip.  Without ``schema`` the types are inferred over all rows; ``forced`` columns are read as text and cast, so ids never pass through floats."""
    r = spark.read.option("header", True).option("sep", sep)
    if schema:
        return r.schema(schema).csv(path)
    inferred = r.option("inferSchema", True).csv(path).schema
    for f in inferred.fields:
        if forced and f.name in forced:
            f.dataType = __import__("pyspark.sql.types", fromlist=["StringType"]).StringType()
    df = r.schema(inferred).csv(path)
    return df.withColumns({c: F.col(c).cast(t) for c, t in (forced or {}).items() if c in df.columns})


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, **isin) -> DataFrame:
    """Parquet with only the wanted columns and, per keyword, only rows whose column is in the list; both reach the scan."""
    df = spark.read.parquet(path)
    for c, values in isin.items():
        df = df.where(F.col(c).isin(list(values)))
    return df.select(*columns) if columns else df


def _swap(spark: SparkSession, tmp: str, path: str) -> None:
    fs, t = _fs(spark, tmp)
    _, p = _fs(spark, path)
    _, old = _fs(spark, f"{path}.old-{uuid.uuid4().hex[:8]}")
    had = fs.exists(p)
    if had and not fs.rename(p, old):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(t, p):
        if had:
            fs.rename(old, p)
        raise OSError(f"{tmp} could not be renamed to {path}")
    if had:
        fs.delete(old, True)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """zstd Parquet, written beside the target and renamed.

    The old table is moved aside, the new one moved in, and only then is the
    old one deleted: a failure puts it back, and after a crash between the two
    renames both tables still exist under their own names beside the target.
    """
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(tmp)
    _swap(df.sparkSession, tmp, path)


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """CSV with header, swapped in like Parquet; ``by``: a folder per value, one pass for all (models, cuts)."""
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    w = df.write.option("header", True)
    (w.partitionBy(*by) if by else w).csv(tmp)
    _swap(df.sparkSession, tmp, path)


def write_id_list(ids: DataFrame, column: str, path: str, expected: int, valid: DataFrame | None = None) -> None:
    """One integer per line, no header; read back as text and checked, deleted if anything is wrong.

    Checked: every line is digits only, the number of lines is ``expected``, no
    id twice, all ids in ``valid``.  Checks are aggregates and anti-joins.
    """
    spark = ids.sparkSession
    ids.select(F.col(column).cast("long").cast("string")).write.mode("overwrite").text(path)
    back = spark.read.text(path)
    a = back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("d"), F.sum((~F.col("value").rlike(r"^\d+$")).cast("long")).alias("bad")).first()
    problem = None
    if a["bad"]:
        problem = f"{a['bad']} lines are not integers"
    elif a["n"] != expected:
        problem = f"{a['n']} lines instead of {expected}"
    elif a["d"] != a["n"]:
        problem = "an id stands twice"
    elif valid is not None and not back.select(F.col("value").cast("long").alias(column)).join(valid.select(column), column, "left_anti").isEmpty():
        problem = "an id is not valid"
    if problem:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
        raise ValueError(problem)


def schema_table(df: DataFrame) -> DataFrame:
    """``column, type, nullable`` of a DataFrame, without a job."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "column string, type string, nullable boolean")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256`` of all files below ``path``; every file is hashed in its task."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_run(spark: SparkSession, path: str, run: str, params: dict, state: str = "ok", outputs: str | None = None) -> None:
    """One more row of the ledger of runs: its parameters as JSON, how it ended, and the hashes of the files below ``outputs``."""
    row = spark.createDataFrame([(run, json.dumps(params, sort_keys=True), state)], "run string, params string, state string").withColumn("at", F.current_timestamp())
    if outputs:
        hashes = file_hashes(spark, outputs).agg(F.sort_array(F.collect_list(F.struct("file", "bytes", "sha256"))).alias("files"))  # the files of one output
        row = row.crossJoin(hashes)  # one row each
    else:
        row = row.withColumn("files", F.expr("cast(array() as array<struct<file:string,bytes:bigint,sha256:string>>)"))
    row.write.mode("append").parquet(path)
