"""Scans of delimited and Parquet tables as strings, previews, and report sinks.

Workbooks and PDFs need readers this environment lacks; their words, drawings and sheets come as Parquet.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.tokens import printable

#: Limits of previews and header inspection.
PREVIEW_ROWS, MOST_COLUMNS, MOST_ROWS, HEADER_ROWS = 20, 100, 20_000, 1000


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header, all columns strings; blanks stay empty."""
    sep = sep or ("\t" if path.lower().endswith((".tsv", ".tab")) else ",")
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False, multiLine=True, quote='"', escape='"').na.fill("")


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))


def with_row_numbers(df: DataFrame, order: str) -> DataFrame:
    """row_no from a column that gives the order of the source; row order in a partition means nothing."""
    return df.withColumn("row_no", F.col(order).cast("long"))


def inspect(df: DataFrame) -> dict:
    """Columns, a row count up to MOST_ROWS, and three rows."""
    head = df.select(*(f"`{c}`" for c in df.columns[:MOST_COLUMNS]))
    return {"columns": head.columns, "rows": df.limit(MOST_ROWS).count(), "preview": [r.asDict() for r in head.limit(3).collect()]}


def inspect_table(df: DataFrame) -> DataFrame:
    """(column, position, rows): the first MOST_COLUMNS columns, and the number of rows up to MOST_ROWS."""
    names = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).cast("long").alias("position")) for k, c in enumerate(df.columns[:MOST_COLUMNS])))
    counted = df.select(F.lit(1).alias("one")).limit(MOST_ROWS).agg(F.count("*").alias("rows"))
    return counted.select(F.explode(names).alias("c"), "rows").select("c.column", "c.position", "rows")


def preview(df: DataFrame, columns: dict[str, list[str]], rows: int = PREVIEW_ROWS) -> DataFrame:
    """display name -> the first candidate column that exists, for the first rows."""
    picked = [(name, next((c for c in cs if c in df.columns), None)) for name, cs in columns.items()]
    return df.select(*(F.col(f"`{c}`").alias(name) for name, c in picked if c)).limit(rows)


_roots: dict[str, str] = {}


def report_path(spark: SparkSession) -> str:
    """A new folder for a report, where executors share one; a local folder for a local master only.  All go when the driver ends."""
    application = spark.sparkContext.applicationId
    if application not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="tessera-reports-")
        root = f"{shared.rstrip('/')}/tessera-reports-{application}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _roots[application] = root
    return f"{_roots[application]}/{uuid.uuid4().hex}"


def once(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: for what a query uses several times, computed once; cuts its lineage."""
    spark, schema, path = df.sparkSession, df.schema, report_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 400_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, computed once, marked for broadcast only if its counted rows are few."""
    df = once(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def write_report(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> list[str]:
    """One folder for each table that has rows; private columns are dropped and text made printable."""
    written = []
    for name, df in tables.items():
        df = df.select(*(printable(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields if not f.name.startswith("_")))
        if df.isEmpty():
            continue
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")
        written.append(name)
    return written


def verify(spark: SparkSession, path: str) -> int:
    """Read an output back and count it."""
    return spark.read.parquet(path).count()


def snapshot_config(spark: SparkSession, path: str, config: dict) -> None:
    """The run's options beside its output."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def output_name(tool: str, mode: str, stamp: str, taken: set[str] = frozenset()) -> str:
    """tool_mode_stamp, with (2) to (99) where taken."""
    name = f"{tool}_{mode}_{stamp}"
    for k in range(2, 100):
        if name not in taken:
            return name
        name = f"{tool}_{mode}_{stamp} ({k})"
    raise ValueError("no free output name")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("digest"))
