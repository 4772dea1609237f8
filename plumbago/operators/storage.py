"""Crop stores: addresses, shards and summaries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INDEX_COLUMNS = ("shard", "offset", "length", "width", "height")


def conform_index(df: DataFrame) -> DataFrame:
    missing = [c for c in INDEX_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"the index lacks {', '.join(missing)}")
    return df.select(F.col("shard").cast("int"), F.col("offset").cast("long"), F.col("length").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"))


def assign_shards(df: DataFrame, group: str, order: str, length: str, limit: int) -> DataFrame:
    """Adds shard and offset within each writer group: a payload that would pass the limit opens a new shard.

    The running offset starts again at each shard, which no window frame expresses; each group is a
    writer of its own, folded in order.
    """
    schema = df.schema.simpleString()[7:-1] + ",shard:int,offset:bigint"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        shard, at, shards, offsets = 0, 0, [], []
        for n in pdf[length]:
            if at and at + n > limit:
                shard, at = shard + 1, 0
            shards.append(shard)
            offsets.append(at)
            at += n
        return pdf.assign(shard=shards, offset=offsets)

    return df.groupBy(group).applyInPandas(fold, schema)


def address_lookup(index: DataFrame, wanted: DataFrame, key: str = "index", rows: int | None = None) -> DataFrame:
    """Addresses of wanted positions; with ``rows`` positions wrap around the store."""
    asked = wanted.withColumn(key, F.pmod(F.col(key), F.lit(rows))) if rows else wanted
    return asked.join(index, key)


def store_summary(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Count, bytes, shards, and exact medians of height and aspect."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.count_distinct("shard").alias("shards"),
        F.median("height").alias("median_height"), F.median(F.col("width") / F.greatest(F.col("height"), F.lit(1))).alias("median_aspect"),
    )


def read_payloads(index: DataFrame, folder: str) -> DataFrame:
    """Adds payload: bytes at (shard, offset, length) in files ``shard_%05d.bin``; each file is opened once a partition."""
    schema = index.schema.simpleString()[7:-1] + ",payload:binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        held: dict[int, object] = {}
        for pdf in batches:
            out = []
            for shard, offset, length in zip(pdf["shard"], pdf["offset"], pdf["length"]):
                if shard not in held:
                    held[shard] = system.open_input_file(f"{path}/shard_{shard:05d}.bin")
                held[shard].seek(offset)
                out.append(held[shard].read(length))
            yield pdf.assign(payload=out)

    return index.repartition("shard").sortWithinPartitions("shard", "offset").mapInPandas(run, schema)


def write_index(df: DataFrame, path: str) -> None:
    """An index of the store's columns, each with its type."""
    conform_index(df).write.mode("overwrite").parquet(path)


def number_shards(df: DataFrame, group: str, order: str, length: str, limit: int) -> DataFrame:
    """``assign_shards`` with numbers that no two writer groups share, in order of the groups."""
    own = assign_shards(df, group, order, length, limit)
    used = own.groupBy(group).agg((F.max("shard") + 1).alias("used"))  # a row for a writer
    first = F.coalesce(F.sum("used").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_shard")
    return own.join(used.select(group, first), group).withColumn("shard", (F.col("shard") + F.col("first_shard")).cast("int")).drop("first_shard")


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_payloads(df: DataFrame, folder: str, payload: str = "payload") -> DataFrame:
    """Write rows (shard, offset, length, payload) as ``shard_%05d.bin`` and return them without the payload.

    A task writes its shards payload after payload under names of its own and moves a finished one to its place,
    so that a lost or repeated task leaves no half of a shard.
    """
    kept = df.drop(payload)
    names = kept.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        now = out = name = None
        for pdf in batches:
            for shard, data in zip(pdf["shard"], pdf[payload]):
                if shard != now:
                    if out is not None:
                        out.close()
                        system.move(name, f"{path}/shard_{now:05d}.bin")
                    now, name = shard, f"{path}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(name)
                out.write(data)
            yield pdf[names]
        if out is not None:
            out.close()
            system.move(name, f"{path}/shard_{now:05d}.bin")

    return df.repartition("shard").sortWithinPartitions("shard", "offset").mapInPandas(run, kept.schema)


def write_files(df: DataFrame, folder: str, name: str = "file", payload: str = "payload") -> DataFrame:
    """A file for each row; returns the rows without the payload, for the manifest."""
    kept = df.drop(payload)
    names = kept.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _file_system(folder)
        for pdf in batches:
            for file, data in zip(pdf[name], pdf[payload]):
                system.create_dir(f"{path}/{file}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{path}/{file}") as out:
                    out.write(data)
            yield pdf[names]

    return df.mapInPandas(run, kept.schema)
