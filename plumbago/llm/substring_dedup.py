"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt into chunks of a few megabytes. Each chunk hashes all its windows with one
vectorised pass and sends every distinct hash once, packed by hash range, to the counting
stage; a window therefore costs about six bytes of shuffle instead of a row. The counting stage
returns to each chunk the hashes that other chunks hold too, and the chunk merges all repeated
windows into maximal removal intervals. The text is shuffled once (both uses share the exchange).

Defined cases: null and empty texts have no words; a document shorter than the window has no
window; a repeated row counts as another occurrence, so both copies lose their words; extra
columns are ignored; null ids are kept as a group of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import ascii_words, group_frames, parts_for, text_volume

#: Base of the polynomial; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 3
MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least ``n`` positions."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        def run(x: int) -> np.ndarray:
            out = np.full(size, x & MASK, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _powers.clear()
        _powers[size] = run(BASE), run(pow(BASE, -1, 1 << 64))
    return _powers[size]


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words.

    Prefix sums of ``hash(word) * BASE**i`` give every window as one difference, brought to a
    common exponent by the inverse power: the rolling hash without a loop.
    """
    n = len(words)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    power, inverse = _tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * power[:n], out=sums[1:])
    out = (sums[width:] - sums[:-width]) * inverse[: n - width + 1]
    out ^= out >> np.uint64(31)  # spreads the low bits, which carry most of the order, over the range used for dealing
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def pack(values: np.ndarray) -> bytes:
    """Sorted hashes as byte planes: the leading planes hardly vary and compress away in the shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def covered(repeated: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Mask of the words that a repeated window covers."""
    step = np.zeros(n_words + 1, dtype=np.int32)
    at = np.flatnonzero(repeated)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:-1]) > 0


def _places(values: np.ndarray, buckets: int) -> np.ndarray:
    """The range of hashes, out of ``buckets``, that each value is in; finer ranges lie within coarser ones."""
    return (values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)


def _deal(buckets: int, width: int):
    """The distinct hashes of a chunk, a row for each range: (bucket, chunk, hashes by owner)."""

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [window_hashes(ascii_words(t), width) for t in pdf["text"]]
        values = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
        bucket = _places(values, buckets)
        first = _runs(bucket)
        chunk = int(pdf["chunk"].iloc[0])
        return pd.DataFrame({
            "bucket": bucket[first].astype(np.int64),
            "chunk": np.full(len(first), chunk, dtype=np.int64),
            "owners": [[chunk]] * len(first),
            "sizes": [[n] for n in np.diff(np.r_[first, len(values)]).tolist()],
            "hashes": [pack(values[a:b]) for a, b in zip(first, np.r_[first[1:], len(values)])],
        })

    return emit


def _owned(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a group of rows, and the chunk each comes from."""
    values = np.concatenate([unpack(b) for b in pdf["hashes"]])
    owners, sizes = (np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf[c]]) for c in ("owners", "sizes"))
    return values, np.repeat(owners, sizes)


def _refine(buckets: int):
    """Rows of one coarse range and some chunks, dealt anew to the finer ranges."""

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        values, owner = _owned(pdf)
        bucket = _places(values, buckets)
        order = np.lexsort((owner, bucket))
        values, owner, bucket = values[order], owner[order], bucket[order]
        first, rows = _runs(bucket), []
        for a, b in zip(first, np.r_[first[1:], len(values)]):
            cut = _runs(owner[a:b])
            rows.append((int(bucket[a]), int(owner[a]), owner[a:b][cut], np.diff(np.r_[cut, b - a]), pack(values[a:b])))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "owners", "sizes", "hashes"])

    return emit


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range, the hashes that two chunks or more hold, returned to each of them."""
    values, owner = _owned(pdf)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    same = values[1:] == values[:-1]
    keep = np.r_[same, False] | np.r_[False, same]
    values, owner = values[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    first = _runs(owner)
    return pd.DataFrame({"chunk": owner[first], "hashes": [pack(values[a:b]) for a, b in zip(first, np.r_[first[1:], len(values)])]})


def _cut(width: int):
    def apply(docs: pd.DataFrame, dups: pd.DataFrame) -> pd.DataFrame:
        words = [ascii_words(t) for t in docs["text"]]
        hashes = [window_hashes(w, width) for w in words]
        values, times = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.empty(0, np.uint64), np.empty(0, int))
        seen = np.concatenate([values[times > 1], *(unpack(b) for b in dups["hashes"])])
        seen.sort()
        rows = []
        for doc_id, text, w, h in zip(docs["doc_id"], docs["text"], words, hashes):
            spans, kept = [], w
            if len(seen) and len(h):
                at = np.minimum(np.searchsorted(seen, h), len(seen) - 1)
                hit = seen[at] == h
                if hit.any():
                    mask = covered(hit, len(w), width)
                    edge = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
                    spans = [{"first": int(a), "after": int(b)} for a, b in edge.reshape(-1, 2)]
                    kept = [x for x, gone in zip(w, mask) if not gone]
            out = b" ".join(kept)
            rows.append((doc_id, len(w), len(w) - len(kept), spans, out.decode("utf-8"), hashlib.sha256(out).hexdigest()))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "removed", "kept_text", "kept_sha256"], dtype=object)

    return apply


ROWS = "bucket long, chunk long, owners array<long>, sizes array<long>, hashes binary"


def dedup_substrings(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35,
    chunk_bytes: int = 4 << 20, bucket_bytes: int = 24 << 20, ranges: int = 2048, texts: bool = True,
) -> DataFrame:
    """Remove every word that a repeated window of ``width`` words covers.

    A chunk sends a row for each of at most ``ranges`` ranges of hashes. Where these would hold more than
    ``bucket_bytes``, a second exchange deals the rows of many chunks to finer ranges, so that rows grow with
    the input and not with its square.

    Returns doc_id, n_words, n_removed, removed (maximal intervals of word positions, end
    exclusive), kept_text (left out when ``texts`` is false) and kept_sha256.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, size = text_volume(docs)
    chunks, buckets = parts_for(size + 64 * n, chunk_bytes), parts_for(size, bucket_bytes)
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    dealt = group_frames(docs.groupBy("chunk"), _deal(min(buckets, ranges), width), ROWS)
    if buckets > ranges:
        finer = -(-buckets // ranges) * ranges
        together = max(1, ranges * bucket_bytes // chunk_bytes)  # chunks whose rows of one coarse range make a bucket
        dealt = group_frames(dealt.groupBy("bucket", F.expr(f"div(chunk, {together}L)")), _refine(finer), ROWS)
    shared = group_frames(dealt.groupBy("bucket"), _shared, "chunk long, hashes binary")
    cut = _cut(width)
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<first:long,after:long>>, kept_sha256 string"
    schema = schema.replace(", kept_sha", ", kept_text string, kept_sha") if texts else schema
    return group_frames(docs.groupBy("chunk").cogroup(shared.groupBy("chunk")), cut, schema)
