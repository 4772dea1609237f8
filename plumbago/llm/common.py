"""Helpers shared by the corpus operators: shared storage, sizing and word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed value: ASCII white space, the separators of words and the padding of lines.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only where a session in one process (local tests) names none, a temporary folder is set, once per session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbago-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/plumbago/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    The files survive lost executors, so later stages never recompute what stands above.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` returned and that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows in a batch to Python: a batch is held whole, and texts can be long.
BATCH_ROWS = 2000
_EXACT = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get


def _frame(part: pa.RecordBatch | pa.Table) -> pd.DataFrame:
    """A frame whose integer columns keep nulls and all their bits (floats would round ids beside a null)."""
    return part.to_pandas(types_mapper=_EXACT)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _table(frame: pd.DataFrame, shape: pa.Schema) -> pa.Table:
    return pa.Table.from_pandas(frame, shape, preserve_index=False) if len(frame) else shape.empty_table()


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` with exact integers in both directions, in batches of bounded size."""
    shape = _arrow(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (b.slice(a, BATCH_ROWS) for b in batches for a in range(0, max(1, b.num_rows), BATCH_ROWS))
        for out in run(map(_frame, small)):
            yield from _table(out, shape).to_batches()

    return df.mapInArrow(go, schema)


def group_frames(groups: GroupedData | PandasCogroupedOps, run: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """``applyInPandas`` of groups or cogroups with exact integers in both directions."""
    shape = _arrow(schema)
    if isinstance(groups, GroupedData):
        return groups.applyInArrow(lambda part: _table(run(_frame(part)), shape), schema)
    return groups.applyInArrow(lambda one, two: _table(run(_frame(one), _frame(two)), shape), schema)


def text_volume(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, from one column-pruned aggregate; sizes every partitioning below."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def parts_for(total: float, each: float, least: int = 1) -> int:
    """How many parts of about ``each`` hold ``total``: grows with the input, without a ceiling."""
    return max(least, int(-(-total // each)))


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 (``bytes.split`` breaks at exactly these bytes)."""
    return text.encode("utf-8").split() if text else []


class Cache(Protocol):
    def forget(self) -> None: ...


_held: Cache | None = None


def hold_cache(owner: Cache) -> None:
    """Let one kernel of this process hold a large cache; the one before forgets its own.

    Workers outlive jobs, and a pipeline runs several kernels and models in the same workers.
    """
    global _held
    if _held is not owner:
        if _held is not None:
            _held.forget()
            trim_memory()
        _held = owner


def trim_memory() -> None:
    """Give freed batches back to the system at the end of a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass
