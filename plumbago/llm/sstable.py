"""Token-id output as sorted-string-table shards.

Documents are dealt by ranges of their identifier and sorted; each task encodes its documents and
writes one shard:

    data blocks   entries (shared key bytes, new key bytes, value bytes as varints, key rest, value);
                  the first entry of a block shares nothing
    index         for each block its last key, offset and length
    filter        a Bloom filter of the keys
    footer        offsets and lengths of index and filter, counts, magic number (fixed size)

A key is one flag byte and the identifier as big-endian with the sign bit flipped, so byte order is
numeric order and a null identifier comes first. Values are ids as little-endian 16-bit integers
where the vocabulary allows, else 32-bit. A lookup takes the manifest's key ranges, the filter, a
binary search in the block index and one range read.

Defined cases: null and empty texts hold the end id alone; repeated identifiers stand next to each
other in text order; an empty table writes no shard; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbago.llm.common import fresh_dir, map_frames, materialise, parts_for, text_volume
from plumbago.llm.files import FolderWriter, open_file
from plumbago.llm.tokens import tokenizer

FOOTER = struct.Struct("<QQQQQQB7s")
MAGIC = b"PLMBSST"
MANIFEST = "file string, first_key binary, last_key binary, docs long, tokens long"


def encode_key(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def decode_key(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    """Ten bits and seven probes a key."""

    PROBES = 7

    def __init__(self, keys: list[bytes] | None = None, blob: bytes | None = None) -> None:
        if blob is not None:
            self.bits = np.frombuffer(blob, dtype=np.uint8)
        else:
            self.bits = np.zeros(max(8, len(keys) * 10 // 8 + 1), dtype=np.uint8)
            for k in keys:
                for at in self._at(k):
                    self.bits[at >> 3] |= 1 << (at & 7)

    def _at(self, key: bytes) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key)
        a, b, m = h & (1 << 64) - 1, h >> 64 | 1, 8 * len(self.bits)
        return [(a + i * b) % m for i in range(self.PROBES)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._at(key))


class ShardWriter:
    """Writes keys in ascending order; ``close`` returns the manifest row's counts."""

    def __init__(self, out, wide: bool, block_bytes: int) -> None:
        self.out, self.wide, self.block_bytes = out, wide, block_bytes
        self.block, self.index, self.keys = bytearray(), [], []
        self.at = self.docs = self.tokens = 0
        self.last = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype("<u4" if self.wide else "<u2").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.tokens += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append((self.last, self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bloom = Bloom(self.keys).bits.tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.tokens, self.wide, MAGIC))
        self.out.close()


class ShardReader:
    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.docs, self.tokens, wide, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.kind = "<u4" if wide else "<u2"
        source.seek(index_at)
        raw, self.last, self.place, at = source.read(index_n), [], [], 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.last.append(raw[at : at + n])
            offset, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            self.place.append((offset, length))
        source.seek(bloom_at)
        self.bloom = Bloom(blob=source.read(bloom_n))

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length = self.place[i]
        self.source.seek(offset)
        buf, at, key = self.source.read(length), 0, b""
        while at < length:
            shared, at = _read_varint(buf, at)
            fresh, at = _read_varint(buf, at)
            n, at = _read_varint(buf, at)
            key = key[:shared] + buf[at : at + fresh]
            at += fresh
            yield key, np.frombuffer(buf, dtype=self.kind, count=n // int(self.kind[2]), offset=at)
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.place)):
            yield from self.block(i)

    def get(self, key: bytes) -> list[np.ndarray]:
        """All values of a key: filter, binary search in the index, then the blocks that may hold it."""
        found: list[np.ndarray] = []
        if key in self.bloom:
            i = bisect_left(self.last, key)
            while i < len(self.last):
                found += [v for k, v in self.block(i) if k == key]
                if self.last[i] > key:
                    break
                i += 1
        return found


def write_shards(
    df: DataFrame, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    shard_bytes: int = 64 << 20, block_bytes: int = 64 << 10,
) -> tuple[str, DataFrame]:
    """Encode all texts into shards; returns their folder and the manifest."""
    spark = df.sparkSession
    folder = fresh_dir(spark, "token-shards")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, size = text_volume(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, writer, first, end = tokenizer(tokenizer_file), None, None, end_id.to_bytes(4, "little")
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                key = encode_key(None if doc_id is pd.NA else int(doc_id))
                if writer is None:
                    name, out = FolderWriter(folder).create(".sst")
                    writer, first = ShardWriter(out, max(tok.top_id, end_id) > 0xFFFF, block_bytes), key
                writer.add(key, np.frombuffer(tok.ids(text) + end if text else end, dtype="<u4"))
        if writer is not None:
            writer.close()
            yield pd.DataFrame({"file": [name], "first_key": [first], "last_key": [writer.last], "docs": [writer.docs], "tokens": [writer.tokens]})

    # a small table still gives every core a shard
    shards = max(parts_for(size + 64 * n, shard_bytes), min(spark.sparkContext.defaultParallelism, parts_for(size, shard_bytes >> 5)))
    dealt = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return folder, materialise(dealt.transform(map_frames, run, MANIFEST), "token-manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) from the files; start counts over all shards in key order."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = materialise(manifest.select("file", before.alias("base")), "token-bases")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, at in zip(pdf["file"], pdf["base"]):
                with open_file(folder, name) as source:
                    shard, rows = ShardReader(source), []
                    for i in range(len(shard.place)):
                        for key, ids in shard.block(i):
                            wide = ids.astype("<u4")
                            rows.append((decode_key(key), at, len(ids), zlib.crc32(wide.tobytes()), *([wide.tolist()] if with_ids else [])))
                            at += len(ids)
                        if len(rows) >= 2000 or i == len(shard.place) - 1:
                            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4], dtype=object)
                            rows = []

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.repartition(max(1, files.count())).transform(map_frames, run, schema)


class ShardSet:
    """Lookups over a manifest that is held sorted (a row for a shard)."""

    def __init__(self, folder: str, manifest_rows: list) -> None:
        self.folder = folder
        self.rows = sorted(manifest_rows, key=lambda r: bytes(r["first_key"]))
        self.last = [bytes(r["last_key"]) for r in self.rows]  # ascending too, as shards are dealt by ranges

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of one document: binary search over the shards, then filter, block index and a range read."""
        key, found = encode_key(doc_id), []
        for r in islice(self.rows, bisect_left(self.last, key), None):
            if bytes(r["first_key"]) > key:
                break
            with open_file(self.folder, r["file"]) as source:
                found += ShardReader(source).get(key)
        return found


def lookup(folder: str, manifest_rows: list, doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document; for several, hold a ``ShardSet``."""
    return ShardSet(folder, manifest_rows).get(doc_id)
