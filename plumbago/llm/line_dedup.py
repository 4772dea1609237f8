"""Line dedup: sharded cuckoo filters over exact reference counts, reversible by document.

The exact table holds one row per line key and document; its grouped counts (combined map-side)
say which keys are frequent and who keeps them. One cuckoo filter per shard of the key space
summarises the frequent keys. A document pass probes the filters and sends only lines that may be
frequent to the exact join, so almost no line is shuffled twice. Filters are broadcast when their
measured size is within a bound; beyond it every line key is sent to the shard of its filter and probed
there. Both ways give the exact join the same keys.
Deleting documents removes their rows and takes keys that fall below the limit out of the filters.

Defined cases: null and empty texts are one empty line; blank and short lines are never dropped;
a repeated row counts once for its document id; rows without an id are one document, which never keeps a
frequent line where one with an id holds it; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import group_frames, map_frames, materialise, parts_for, trim_memory

_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: str, least: int) -> bytes | None:
    """16 bytes for a line that counts (stripped, ASCII-lower-cased, ``least`` code points or more)."""
    if len(line) < least:
        return None
    key = line.encode("utf-8").strip(_SPACE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """A cuckoo filter of 16-bit fingerprints in buckets of four, with insertion and deletion.

    Keys are 64-bit integers that are already uniform. A key that finds no place grows the table
    (``insert`` returns False and the caller rebuilds from the exact rows).
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, table: np.ndarray | None = None) -> None:
        size = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (0.85 * self.SLOTS)))))
        self.table = np.zeros((size, self.SLOTS), dtype=np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    @staticmethod
    def prints(keys: np.ndarray) -> np.ndarray:
        f = (keys >> np.uint64(48)).astype(np.uint16)
        return np.where(f == 0, np.uint16(1), f)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (at ^ (prints.astype(np.int64) * 0x5BD1E995)) & self.mask

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = self.prints(keys)
        a = (keys & np.uint64(self.mask)).astype(np.int64)
        return f, a, self._other(a, f)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, a, b = self.places(keys)
        return ((self.table[a] == f[:, None]) | (self.table[b] == f[:, None])).any(axis=1)

    def insert(self, key: int) -> bool:
        f, a, b = (x[0] for x in self.places(np.array([key], dtype=np.uint64)))
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return True
        at = int(b)
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            f, self.table[at, slot] = self.table[at, slot], f
            at = int(self._other(np.array([at]), np.array([f], dtype=np.uint16))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return True
        return False

    def delete(self, key: int) -> bool:
        f, a, b = (x[0] for x in self.places(np.array([key], dtype=np.uint64)))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == f)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def fill(self, keys: np.ndarray) -> bool:
        """Insert many keys into an empty filter: whole rounds into the first and the second bucket, kicks for the rest."""
        for second in (False, True):
            f, a, b = self.places(keys)
            at = b if second else a
            order = np.argsort(at, kind="stable")
            at, f, keys = at[order], f[order], keys[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            slot = (self.table[at] != 0).sum(axis=1) + rank
            fits = slot < self.SLOTS
            self.table[at[fits], slot[fits]] = f[fits]
            keys = keys[~fits]
        return all(self.insert(int(k)) for k in keys)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds all ``keys``, grown until they fit."""
        capacity = max(8, len(keys))
        while True:
            out = cls(capacity)
            if out.fill(keys):
                return out
            capacity *= 2

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(blob, dtype=np.uint16).reshape(-1, cls.SLOTS).copy())


def _shards(hi: np.ndarray, shards: int) -> np.ndarray:
    return ((hi.view(np.uint64) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def postings(docs: DataFrame, least: int) -> DataFrame:
    """Rows (hi, lo, doc_id): each counting line key once per input row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, ids = [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                own = {k for line in (text or "").split("\n") if (k := line_key(line, least))}
                keys.extend(own)
                ids.extend([doc_id] * len(own))
            pair = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"hi": pair[:, 0], "lo": pair[:, 1], "doc_id": pd.array(ids, dtype="Int64")})

    return docs.transform(map_frames, run, "hi long, lo long, doc_id long")


def frequent(posted: DataFrame, least_docs: int) -> DataFrame:
    """Rows (hi, lo, docs, keeper) of the keys that ``least_docs`` documents or more hold.

    Two grouped stages: one row per key and document, then sums per key; both combine map-side.
    """
    once = posted.groupBy("hi", "lo", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("hi", "lo").agg(F.count("one").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= least_docs)


def shard_of(shards: int) -> Column:
    return F.expr(f"cast(floor((shiftrightunsigned(hi, 32) * {shards}L) / 4294967296) as long)")


def build_filters(hot: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, filter): a cuckoo filter for each shard of the key space. Each key occurs once in ``hot``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.of(pdf["lo"].to_numpy(dtype=np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [held.dump()]})

    return group_frames(hot.select("lo", shard_of(shards).alias("shard")).groupBy("shard"), run, "shard long, filter binary")


@dataclass
class LineIndex:
    """The reversible state: exact postings, frequent keys and their filters, all in the shared folder."""

    posted: DataFrame
    hot: DataFrame
    filters: DataFrame
    shards: int
    least: int
    least_docs: int

    @classmethod
    def build(cls, docs: DataFrame, least: int = 20, least_docs: int = 3, keys_per_shard: int = 1 << 16, keep_postings: bool = True) -> LineIndex:
        """From rows (doc_id, text). Without kept postings the index answers but can't be updated."""
        posted = postings(docs, least)
        posted = materialise(posted.distinct(), "line-postings") if keep_postings else posted
        hot = materialise(frequent(posted, least_docs), "line-keys")
        shards = parts_for(hot.count(), keys_per_shard)
        return cls(posted, hot, materialise(build_filters(hot, shards), "line-filters"), shards, least, least_docs)

    def _moved(self, posted: DataFrame) -> LineIndex:
        """The index over other postings: keys that became or ceased to be frequent enter or leave the filters."""
        hot = materialise(frequent(posted, self.least_docs), "line-keys")
        came = hot.join(self.hot, ["hi", "lo"], "left_anti").select("hi", "lo", F.lit(True).alias("came"))
        gone = self.hot.join(hot, ["hi", "lo"], "left_anti").select("hi", "lo", F.lit(False).alias("came"))
        changes = came.union(gone).select("lo", "came", shard_of(self.shards).alias("shard"))

        def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            held = CuckooFilter.load(old["filter"].iloc[0]) if len(old) else CuckooFilter(len(new))
            for lo in new.loc[~new["came"], "lo"]:
                held.delete(int(lo) & (1 << 64) - 1)
            full = not all(held.insert(int(lo) & (1 << 64) - 1) for lo in new.loc[new["came"], "lo"])
            shard = int((old if len(old) else new)["shard"].iloc[0])
            return pd.DataFrame({"shard": [shard], "filter": [None if full else held.dump()]})

        moved = materialise(group_frames(self.filters.groupBy("shard").cogroup(changes.groupBy("shard")), run, "shard long, filter binary"), "line-filters")
        if moved.where("filter is null").limit(1).count():  # a shard outgrew its table: build anew from the exact rows
            moved = materialise(build_filters(hot, self.shards), "line-filters")
        return LineIndex(posted, hot, moved, self.shards, self.least, self.least_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._moved(materialise(self.posted.union(postings(docs, self.least)).distinct(), "line-postings"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Forget documents (column doc_id): reverses their insertion exactly."""
        return self._moved(materialise(self.posted.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select("hi", "lo", "doc_id"), "line-postings"))

    def _routed(self, posted: DataFrame, filter_bytes: int, salts: int = 16, part_bytes: int = 64 << 20) -> DataFrame:
        """Postings that may be frequent: each meets its shard's filter in one of ``salts`` places, so that no line makes a place hot.

        A place reads its filter first and then any number of postings, batch by batch.
        """
        shards = self.shards
        held = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("doc_id"), "filter")
        sent = posted.select(shard_of(shards).alias("shard"), F.pmod(F.xxhash64("doc_id", "hi"), F.lit(salts)).cast("int").alias("salt"), "hi", "lo", "doc_id", F.lit(None).cast("binary").alias("filter"))
        places = parts_for(filter_bytes * salts, part_bytes, self.filters.sparkSession.sparkContext.defaultParallelism)
        dealt = held.union(sent).repartition(places, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, now = None, None
            for pdf in batches:
                place = list(zip(pdf["shard"], pdf["salt"]))
                hit = np.zeros(len(pdf), dtype=bool)
                cuts = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if a == b:
                        continue
                    if pdf["filter"].iat[a] is not None:
                        at, now = place[a], CuckooFilter.load(pdf["filter"].iat[a])
                        a += 1
                    if place[b - 1] == at and a < b:
                        hit[a:b] = now.contains(pdf["lo"].iloc[a:b].to_numpy(dtype=np.int64).view(np.uint64))
                yield pdf.loc[hit, ["hi", "lo", "doc_id"]]

        return dealt.transform(map_frames, probe, "hi long, lo long, doc_id long")

    def drops(self, docs: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
        """Rows (doc_id, keys): the keys whose lines each document loses, packed, 16 bytes each."""
        least, shards = self.least, self.shards
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size <= broadcast_bytes:
            sent = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})

            def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                held = {k: CuckooFilter.load(b) for k, b in sent.value.items()}
                for pdf in batches:
                    hi, lo = pdf["hi"].to_numpy(dtype=np.int64), pdf["lo"].to_numpy(dtype=np.int64)
                    at, hit = _shards(hi, shards), np.zeros(len(pdf), dtype=bool)
                    for shard in np.unique(at):
                        own = np.flatnonzero(at == shard)
                        if shard in held:
                            hit[own] = held[shard].contains(lo[own].view(np.uint64))
                    yield pdf[hit]

            may = postings(docs, least).transform(map_frames, probe, "hi long, lo long, doc_id long")
        else:
            may = self._routed(postings(docs, least), size)
        lost = may.join(self.hot, ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, least_docs: int = 3,
    columns: tuple[str, ...] = (), index: LineIndex | None = None, texts: bool = True,
) -> DataFrame:
    """Drop frequent lines from all documents but the one with the largest id.

    Returns doc_id, n_lines, n_dropped, kept_sha256, kept_text (unless ``texts`` is false) and the
    further ``columns`` asked for.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *columns)
    bare = docs.select("doc_id", "text")
    index = index or LineIndex.build(bare, least, least_docs, keep_postings=False)
    lost = index.drops(bare).select(F.col("doc_id").alias("of"), F.flatten(F.transform("keys", lambda k: F.array(k["hi"], k["lo"]))).alias("line_keys"))
    joined = docs.join(lost, docs["doc_id"].eqNullSafe(lost["of"]), "left")
    least = index.least

    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string, changed string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for whole, drop in batches:
            rows = []
            for text, keys in zip(whole, drop):
                lines = (text or "").split("\n")
                stay = lines
                if keys is not None and len(keys):
                    gone = {k.tobytes() for k in np.asarray(keys, dtype=np.int64).reshape(-1, 2)}
                    stay = [x for x in lines if line_key(x, least) not in gone]
                kept = "\n".join(stay)
                rows.append((len(lines), len(lines) - len(stay), hashlib.sha256(kept.encode("utf-8")).hexdigest(), kept if texts and len(stay) < len(lines) else None))
            yield pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_sha256", "changed"])
        trim_memory()

    answer = cut("text", "line_keys")  # one call for all fields
    told = [answer[c].alias(c) for c in ("n_lines", "n_dropped", "kept_sha256")]
    # only texts that lost a line come back from Python
    return joined.select("doc_id", *columns, *told, *([F.coalesce(answer["changed"], "text", F.lit("")).alias("kept_text")] if texts else []))
