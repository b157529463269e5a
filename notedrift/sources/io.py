"""Scans and sinks.

Everything is ``spark.read`` / ``df.write`` with explicit schemas: no schema
inference, strings stay strings (leading zeros kept), and the reference's four
spellings of "missing" ('NA', NaN, 0 in panels, '') become SQL NULL by
explicit per-column options (``normalize_missing``).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The filing record as scraped: 12 strings.
FILING_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in (
    "crp_cls", "crp_nm", "crp_cd", "rpt_nm", "rcp_no", "dic_cls", "dcm_no", "col_dcm_no",
    "foot_note", "consolidated_foot_note", "acc_crp", "rcp_dt")])

RESULTS_SCHEMA = T.StructType([T.StructField(f"c{i}", T.DoubleType(), True) for i in range(10)])


def read_shards(spark: SparkSession, path: str, keyword: str, fmt: str = "parquet",
                schema: T.StructType | None = None, extension: str | None = None) -> DataFrame:
    """A1: every file under ``path`` (recursively) with the ``extension`` (that of the
    format by default) whose base name before the first '.' contains ``keyword``; empty shards add nothing; the union keeps
    only the columns common to all shards (``join='inner'``)."""
    reader = spark.read.format(fmt).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{keyword}*.{extension or fmt}")
    if schema is not None:
        reader = reader.schema(schema)
    files = (reader.load(path).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("n"))
             .filter(F.split(F.col("n"), r"\.").getItem(0).contains(keyword)).select("p").distinct())
    paths = sorted(r["p"] for r in files.collect())  # file names only, never rows; a shard without rows has none here
    if not paths:
        raise FileNotFoundError(f"no shard with '{keyword}' under {path}")

    def load(some: list[str]) -> DataFrame:
        return (spark.read.schema(schema) if schema is not None else spark.read).format(fmt).load(some)

    if schema is not None:
        return load(paths)
    # shards of one footer schema are one load: the plan grows with the distinct schemas, not with the files
    with ThreadPoolExecutor(16) as pool:
        schemas = list(pool.map(inheritable_thread_target(spark)(lambda p: load([p]).schema), paths))
    groups: dict[str, list[str]] = {}
    for p, found in zip(paths, schemas):
        groups.setdefault(found.json(), []).append(p)
    frames = [load(some) for some in groups.values()]
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    out = frames[0].select(*common)
    for f in frames[1:]:
        out = out.unionByName(f.select(*common))
    return out


def read_panel(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """A3: a panel sheet with an explicit schema (typed casts happen later with try_cast)."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def read_codes(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "csv", header: bool = True) -> DataFrame:
    """A4: code lists read as strings (leading zeros kept)."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return spark.read.format(fmt).schema(schema).option("header", header).load(path)


def lookup_from_json(payloads: DataFrame, key: str = "crp_cd", payload: str = "payload",
                     field: str = "ind_cd") -> DataFrame:
    """A5: one JSON payload per company -> (key, field)."""
    schema = T.StructType([T.StructField(field, T.StringType(), True)])
    return payloads.select(key, F.from_json(F.col(payload), schema)[field].alias(field))


def normalize_missing(df: DataFrame, na_strings: dict[str, Sequence[str]] | None = None,
                      zero_is_missing: Sequence[str] = (), nan_is_missing: Sequence[str] = ()) -> DataFrame:
    """Turn the per-column missing spellings into NULL."""
    na_strings = na_strings or {}
    out = []
    for c in df.columns:
        x = F.col(c)
        if c in na_strings:
            x = F.when(x.isin(*na_strings[c]), F.lit(None)).otherwise(x)
        if c in zero_is_missing:
            x = F.nullif(x, F.lit(0))
        if c in nan_is_missing:
            x = F.when(F.isnan(x), F.lit(None)).otherwise(x)
        out.append(x.alias(c))
    return df.select(*out)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Persist a cleaning stage as parquet (also a lineage cut), by the denser codec, since a stage holds whole texts."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", header: bool = True) -> str:
    """CSV with header; UTF-8 by default, any Java charset via ``encoding``."""
    df.write.mode("overwrite").option("header", header).option("encoding", encoding).csv(path)
    return path


def chunk_ids(df: DataFrame, order: str, max_rows: int, out: str = "chunk") -> DataFrame:
    """Consecutive chunks of at most ``max_rows`` rows in ``order``:
    chunk = (position - 1) div max_rows, with distributed positions."""
    from ..operators.stats import group_ranks
    r = group_ranks(df.withColumn("_g", F.lit(0)), "_g", order, out="_pos").drop("_g")
    return r.withColumn(out, F.floor((F.col("_pos") - 1) / max_rows).cast("long")).drop("_pos")


def write_chunks(df: DataFrame, path: str, max_rows: int, order: str | None = None) -> str:
    """One directory per chunk (visible chunk id) when ``order`` is given,
    else files of at most ``max_rows`` records each."""
    if order is None:
        df.write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(path)
    else:
        chunk_ids(df, order, max_rows).write.mode("overwrite").partitionBy("chunk").parquet(path)
    return path


def write_vectors(df: DataFrame, path: str, key: str, vec: str = "features") -> str:
    """Store a feature matrix as (key, vector) parquet."""
    df.select(key, vec).write.mode("overwrite").parquet(path)
    return path


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A9."""
    return spark.read.parquet(path)


def weights_to_vectors(weights: DataFrame, id_col: str = "id", num_features: int = 1 << 18,
                       out: str = "features") -> DataFrame:
    """Long-form weights -> sparse ML vectors of ``num_features``
    (terms hashed with xxhash64; colliding terms add).  The per-document
    coordinates are gathered by a keyed aggregate (bounded by the document's
    vocabulary); only the final packing into a SparseVector is a small
    row-level helper."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def _pack(idx, val):
        pairs = sorted(zip(idx, val))
        return SparseVector(num_features, [i for i, _ in pairs], [v for _, v in pairs])

    idx = F.pmod(F.xxhash64("term"), F.lit(num_features)).cast("int")
    per = (weights.withColumn("_i", idx).groupBy(id_col, "_i").agg(F.sum("weight").alias("_w"))
                  .groupBy(id_col).agg(F.collect_list("_i").alias("_is"), F.collect_list("_w").alias("_ws")))
    return per.select(id_col, _pack("_is", "_ws").alias(out))


def filings_scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A10: page files of scraped filings, read with the fixed 12-string schema."""
    return spark.read.format(fmt).schema(FILING_SCHEMA).option("recursiveFileLookup", "true").load(path)


def results_scan(spark: SparkSession, path: str, names: Sequence[str] | None = None, header: bool = True) -> DataFrame:
    """Experiment results (10 positional score columns) with names."""
    df = spark.read.schema(RESULTS_SCHEMA).option("header", header).csv(path)
    if names:
        df = df.toDF(*names)
    return df


def unpivot_results(df: DataFrame, value: str = "value") -> DataFrame:
    """Wide result columns -> (metric, value) long rows."""
    return df.unpivot([], df.columns, "metric", value)
