"""Guest file to table: read, profile, clean the headers, write, verify."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventlift.functions.keys import column
from eventlift.sources.workspace import Folder

#: What the names of a table that is being written, and of one that is being replaced, go on with.
ASIDE, BEFORE = "__new_", "__old_"


def read_file(
    spark: SparkSession,
    path: str,
    format: str = "csv",
    schema: StructType | str | None = None,
    **options: str | bool,
) -> DataFrame:
    """Read a rectangular file with a header.

    Without a schema CSV types are inferred, which costs one more pass over the file;
    give a schema for large inputs. Spaces around values are kept. Further options go
    to the reader, such as ``multiLine=True`` for line breaks inside quotes.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        options = {"header": True, "inferSchema": schema is None, "escape": '"', **options}
    return reader.options(**options).format(format).load(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table by path or by (qualified) catalog name."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def write_table(df: DataFrame, target: str, mode: str = "overwrite") -> None:
    """Write to a path or to a catalog table; replaces what is there by default."""
    if "/" in target:
        df.write.mode(mode).parquet(target)
    else:
        df.write.mode(mode).saveAsTable(target)


def clean_header(name: str) -> str:
    """Lower case; every run of characters other than letters, digits and ``_`` is one ``_``."""
    return re.sub(r"\W+", "_", name.lower().strip()).strip("_")


def clean_headers(df: DataFrame) -> DataFrame:
    """Rename every column to its clean form; two columns may not end up alike."""
    names = [clean_header(c) or f"column_{i}" for i, c in enumerate(df.columns, start=1)]
    clashes = sorted(n for n, k in Counter(names).items() if k > 1)
    if clashes:
        raise ValueError(f"columns alike after cleaning: {clashes}")
    return df.toDF(*names)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def profile(df: DataFrame) -> DataFrame:
    """One row: number of rows, number of columns, column names."""
    return row_count(df).select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(", ".join(df.columns)).alias("column_names"),
    )


def header_report(df: DataFrame) -> DataFrame:
    """One row per column: position, raw and clean name, rows with a value."""
    names = list(df.columns)
    clean = clean_headers(df)
    counts = clean.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in clean.columns])
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(raw).alias("raw_name"),
            F.lit(c).alias("clean_name"),
            F.col(f"`{c}`").alias("filled_rows"),
        )
        for i, (raw, c) in enumerate(zip(names, clean.columns), start=1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def sample(df: DataFrame, n: int, order_by: list[str], columns: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by a key order, so that every run shows the same ones."""
    first = df.orderBy(*map(column, order_by)).limit(n)
    return first.select(*map(column, columns or df.columns))


def stored_rows(spark: SparkSession, path: str) -> int:
    """Rows of the files under ``path``."""
    return spark.read.parquet(path).count()


def replace_table(df: DataFrame, target: str) -> int:
    """Write ``df`` aside, verify it, then put it in the place of ``target``; returns its rows.

    Rows are counted while they are written and compared with those of the files; only then does
    the new table take the old one's name. If reading, writing or verifying fails, the
    old table stays as it was and nothing else is left behind. A folder is swapped by two renames;
    where the second fails the first is taken back, and what a driver killed between the two has put
    aside returns with the next load (``restore``). A catalog table is swapped by its location, one
    change of the catalog, or, if its columns differ, dropped and made anew at the end.
    """
    spark = df.sparkSession
    by_path = "/" in target
    if by_path:
        parent, _, name = target.rstrip("/").rpartition("/")
        restore(spark, target)
    else:
        parent, name = spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), target
    folder = Folder(spark, parent)
    new = f"{name}{ASIDE}{uuid.uuid4().hex}"
    counted = Observation("ingest")
    try:
        observed = df.observe(counted, F.count(F.lit(1)).alias("rows"))
        observed.write.parquet(f"{parent}/{new}")
        written, stored = counted.get["rows"], stored_rows(spark, f"{parent}/{new}")
        if written != stored:
            raise ValueError(f"{target}: {written} rows were written, the files hold {stored}")
        if by_path:
            _swap(folder, new, name)
            spark.catalog.refreshByPath(target)
        else:
            _relocate(spark, target, f"{parent}/{new}")
    except BaseException:
        folder.delete(new)
        raise
    return stored


def _swap(folder: Folder, new: str, name: str) -> None:
    old = f"{name}{BEFORE}{uuid.uuid4().hex}"
    there = folder.exists(name)
    if there and not folder.rename(name, old):
        raise OSError(f"{name} could not be put aside")
    if not folder.rename(new, name):
        if there:
            folder.rename(old, name)
        raise OSError(f"{name} could not be replaced")
    if there:
        folder.delete(old)


def restore(spark: SparkSession, target: str) -> None:
    """If a load was killed while it replaced the table at this path, the old one returns."""
    parent, _, name = target.rstrip("/").rpartition("/")
    folder = Folder(spark, parent)
    aside = [n for n in folder.names() if n.startswith(f"{name}{BEFORE}")]
    if aside and not folder.exists(name):
        folder.rename(aside.pop(), name)
    for left in aside:
        folder.delete(left)


def _relocate(spark: SparkSession, table: str, path: str) -> None:
    """Let a catalog table read the files under ``path``."""
    files = spark.read.parquet(path)
    if spark.catalog.tableExists(table):
        # only what a load has put there before goes away
        location = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()["data_type"]
        if spark.table(table).schema == files.schema:
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
            spark.catalog.refreshTable(table)
        else:
            spark.sql(f"DROP TABLE {table}")
            spark.catalog.createTable(table, path=path, source="parquet")
        parent, _, name = location.rstrip("/").rpartition("/")
        if ASIDE in name:
            Folder(spark, parent).delete(name)
    else:
        spark.catalog.createTable(table, path=path, source="parquet")


def ingest(
    spark: SparkSession,
    path: str,
    target: str,
    format: str = "csv",
    schema: StructType | str | None = None,
    mode: str = "overwrite",
    **options: str | bool,
) -> DataFrame:
    """Load a guest file into a table with clean headers and return that table.

    The table is replaced once the new one is verified (``replace_table``); with another ``mode``
    the rows are written as that says.
    """
    clean = clean_headers(read_file(spark, path, format, schema, **options))
    if mode == "overwrite":
        replace_table(clean, target)
    else:
        write_table(clean, target, mode)
    return read_table(spark, target)


class Ingested(NamedTuple):
    """A loaded table, the profile of the file, and the first rows of the table."""

    table: DataFrame
    profile: DataFrame
    sample: DataFrame


def ingest_verified(
    spark: SparkSession,
    path: str,
    target: str,
    order_by: list[str],
    format: str = "csv",
    schema: StructType | str | None = None,
    sample_rows: int = 5,
    **options: str | bool,
) -> Ingested:
    """``ingest`` plus profile and sample; raises if the table lacks rows of the file."""
    table = ingest(spark, path, target, format, schema, **options)
    raw = read_file(spark, path, format, schema, **options)
    return Ingested(table, profile(raw), sample(table, sample_rows, order_by))
