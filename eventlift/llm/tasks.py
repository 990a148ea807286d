"""What the operators share: shipping the package to Python workers, columns, white space."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The characters with the White_Space property, as the tokenizer libraries see them.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Python's str.split() also splits at these, the tokenizer libraries do not.
ONLY_PYTHON_SPLITS = frozenset("\x1c\x1d\x1e\x1f")
#: From here on, letters and digits are told apart by the tokenizer library's own tables.
BEYOND_LATIN = chr(0x250)

#: Bytes of an Arrow batch; Spark alone bounds its rows, and ten thousand texts may be long.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

Batches = Iterator[pa.RecordBatch]


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose machines lack that folder, install the package there or pass it with
    ``--py-files``; the setting then does nothing. Where the session does not say how large
    Arrow batches may be, that is set as well.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    return spark


def _give_back() -> None:
    """Return freed memory to the system: workers live on, and allocators keep what tasks before needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _tidied(batches: Batches, task: Callable[[Batches], Batches]) -> Batches:
    _give_back()  # of other operators
    try:
        yield from task(batches)
    finally:
        _give_back()


def arrow_map(df: DataFrame, task: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``mapInArrow`` by a task whose module the workers can import."""
    ship(df.sparkSession)
    return df.mapInArrow(partial(_tidied, task=task), schema)


def same_rows(df: DataFrame, task: Callable[[Batches], Batches]) -> DataFrame:
    """``mapInArrow`` by a task that gives back batches of the columns it got.

    The task sees numbered columns: Spark looks them up by name, which dots would break.
    """
    ship(df.sparkSession)
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.mapInArrow(partial(_tidied, task=task), numbered.schema).toDF(*df.columns)


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"{name}_"
    return name


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, as ``id`` and ``text``; a null text is empty.

    Other columns, whatever their names, are not carried along.
    """
    return df.select(
        df[id_col].cast("long").alias("id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )


def batch_of(schema: StructType | pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
