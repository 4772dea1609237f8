"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two fingerprints that differ in
at most two bits differ in one of three ways (pigeonhole on the segments):

* the first segment is equal and the second differs in two bits at most,
* the second is equal and the first differs in two bits at most,
* the third is equal and the first two differ in one bit each.

In each case an exact segment together with a shared nearby Golay codeword index of another
segment is a join key, so no link is missed. Keys are counted first: buckets of up to
``bucket_limit`` distinct fingerprints are compared pair by pair; in larger ones each fingerprint
meets its neighbours at the midpoints (itself and its one-bit flips): two of them within two bits
share one, and all that share one are within two bits, so a star around the least of each replaces
the pairs. Copies are folded into one fingerprint beforehand.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; null ids
get a fingerprint but never name a component unless all members are null; repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import map_frames, materialise
from plumbago.llm.golay import near_codewords
from plumbago.llm.graph import connected_components

SEED = 42
#: Bits in which linked fingerprints may differ; the segments and midpoints above are made for it.
MAX_BITS = 2


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of the whole sequence if it is shorter; none for a blank text."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = len(words) - shingle + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=n)


def simhash(text: str | None, shingle: int = 3) -> int:
    """Majority bits over the shingle hashes, as a signed 64-bit integer."""
    h = shingle_hashes(text, shingle).astype("<u8")
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([simhash(t, shingle) for t in pdf["text"]], dtype=np.int64)})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(map_frames, run, "doc_id long, fp long")


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``fp`` and join keys: case (2 bits), exact segment (23 bits), codeword index (12 bits)."""
    x = fp.view(np.uint64)
    s1, s2, s3 = ((x >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in ((0, 23), (23, 23), (46, 18)))
    r1, c1 = near_codewords(s1)
    r2, c2 = near_codewords(s2)
    rows = np.r_[r2, r1, r1]
    keys = np.r_[s1[r2] << 12 | c2, 1 << 35 | s2[r1] << 12 | c1, 2 << 35 | s3[r1] << 12 | c1]
    return rows, keys


def links(prints: DataFrame, bucket_limit: int = 32) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints (column fp) within two bits.

    Buckets up to the limit give each such pair; larger ones give stars with the same components.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(dtype=np.int64)
            for a in range(0, len(fp), 2000):
                rows, keys = golay_keys(fp[a : a + 2000])
                yield pd.DataFrame({"key": keys, "fp": fp[a : a + 2000][rows]})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            us, vs = [], []
            for group in pdf["fps"]:
                g = np.asarray(group, dtype=np.int64)
                i, j = np.triu_indices(len(g), 1)
                near = np.bitwise_count((g[i] ^ g[j]).view(np.uint64)) <= MAX_BITS
                us.append(g[i][near])
                vs.append(g[j][near])
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)} if us else {"u": [], "v": []}).astype("int64")

    def midpoints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)].view(np.int64)
        for pdf in batches:
            fp = pdf["fp"].to_numpy(dtype=np.int64)
            for a in range(0, len(fp), 4000):
                part = fp[a : a + 4000]
                yield pd.DataFrame({"mid": (part[:, None] ^ flips).ravel(), "fp": np.repeat(part, len(flips))})

    keys = materialise(prints.select("fp").transform(map_frames, keyed, "key long, fp long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot_keys = sizes.where(F.col("n") > bucket_limit).select("key")
    small = keys.join(sizes.where(F.col("n").between(2, bucket_limit)).select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))
    pairs = small.select("fps").transform(map_frames, compared, "u long, v long").distinct()
    hot = keys.join(hot_keys, "key").select("fp").distinct().transform(map_frames, midpoints, "mid long, fp long")
    centres = hot.groupBy("mid").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", "v")
    stars = hot.join(centres, "mid").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.union(stars)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket_limit: int = 32) -> DataFrame:
    """Rows (doc_id, fp, component_id) of every document; component_id is the least doc_id reachable."""
    marks = materialise(fingerprints(df, id_col, text_col, shingle), "simhash")
    prints = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    parts = connected_components(links(prints, bucket_limit=bucket_limit)).withColumnRenamed("node", "fp")
    linked = prints.join(parts, "fp")
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    final = linked.join(least, "component").select("fp", "component_id").union(prints.join(parts, "fp", "left_anti").select("fp", F.col("first_id").alias("component_id")))
    return marks.join(final, "fp").select("doc_id", "fp", "component_id")
