"""Near-copies by a 256-bit SimHash and pairs of softly decoded Golay blocks.

For texts whose five-word shingles are 80 % alike, a 64-bit SimHash differs in about ten bits, far
beyond what segments of it can meet exactly. Here six 23-bit blocks of a longer fingerprint are decoded
to codewords with the votes behind their bits (a bit that hangs by a few shingles counts little), and
each of three disjoint pairs of blocks gives ``KEYS`` join keys: the pairs of codeword indices that
agree best with the votes. Each key is split by classes of set size, which a pair at ``LEAST`` can't miss and
which part most texts that meet by chance. At a similarity of 0.8 a pair of blocks meets about three times in four, so
that by simulation 98 % meet in one of the three (of 150 edited texts at 0.80 to 0.85, 149 did). Pairs that meet
are screened by 128 bits, then by all 256: ``MAX_BITS`` of them may differ, four deviations and more above
the distance to expect at 0.8. What is left is verified by the sets of shingles themselves: only a Jaccard
similarity of ``LEAST`` or more is a link.

Buckets of more than ``TILE`` nodes are dealt into tiles at random, a row a member, and compared tile by
tile: first by the check bits alone, then, for members that have a candidate, with their sets. A bucket that
the links found so far connect whole is done. The others are dealt once more, and then each pair of members
of different groups is compared, but for pairs inside the bucket's largest group, which are connected: with
n members, k of them outside the largest group, that costs up to k * n / ``TILE`` rows. So no link that could
connect two components is left out. Within a tile only members not yet connected are verified, and no more
links leave it than connect them.

A node is a distinct set of shingles, named by a 64-bit hash of it (10^10 sets have about three chance
collisions, each of which would link two texts).

Defined cases: null, empty and blank texts are one node; rows without an id are linked like any other but
never name a component unless all its members lack one; repeated rows and equal sets of shingles are one
node; one id on two texts is two nodes; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import hold_cache, map_frames, materialise, trim_memory
from plumbago.llm.golay import LENGTH, soft_codewords
from plumbago.llm.graph import connected_components
from plumbago.llm.simhash import shingle_hashes

LANES, PAIRS = 4, 3
#: Keys of a pair of blocks, and the codewords of a block they are made from.
KEYS, NEAR = 12, 8
#: Bits that may differ between near-copies, of 256 and of the last two lanes' 128.
MAX_BITS, MAX_CHECK = 60, 35
#: The similarity of near-copies, and about how many members of a bucket make a side of a tile.
LEAST, TILE = 0.8, 256
_LANE = np.array([0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1 for k in range(LANES)], dtype=np.uint64)
FP = [f"f{k}" for k in range(LANES)]


class _NoCache:
    """Takes the place of a kernel's cache in workers that need none."""

    def forget(self) -> None:
        pass


_NONE = _NoCache()


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The sorted, distinct XXH64 hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, shingle))


def votes(h: np.ndarray) -> np.ndarray:
    """For each bit of four mixes of the hashes of a set of shingles, ones less zeros."""
    ones = np.zeros(64 * LANES, dtype=np.int64)
    for a in range(0, len(h), 2048):
        x = h[a : a + 2048, None] + _LANE
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * ones - len(h)


def wide_simhash(count: np.ndarray) -> np.ndarray:
    """Majority bits of rows of votes, as four signed integers each."""
    return np.packbits(count > 0, axis=-1, bitorder="little").view(np.int64)


def pair_keys(count: np.ndarray) -> np.ndarray:
    """Join keys of rows of votes: pair number, and the indices of codewords of its two blocks that agree best together."""
    out = []
    for t in range(PAIRS):
        (a, la), (b, lb) = (soft_codewords(count[:, LENGTH * k : LENGTH * (k + 1)], NEAR) for k in (2 * t, 2 * t + 1))
        loss = (la[:, :, None] + lb[:, None, :]).reshape(len(count), -1)
        both = (a[:, :, None] << 12 | b[:, None, :]).reshape(len(count), -1)
        best = np.argpartition(loss, KEYS - 1, axis=1)[:, :KEYS]
        out.append(np.int64(t) << 24 | np.take_along_axis(both, best, axis=1))
    return np.concatenate(out, axis=1)


def _sized(keys: Column, size: Column) -> Column:
    """Each key in a set's size class, and in the next where a set ``LEAST`` alike may be in that: classes double in size."""
    level = lambda n: F.floor(F.log2(F.greatest(n, F.lit(1))))
    # the margin is for rounding: it only puts more sets in two classes
    levels = F.array_distinct(F.array(level(size), level(size * (1.01 / LEAST))))
    return F.flatten(F.transform(levels, lambda up: F.transform(keys, lambda k: F.shiftleft(up, 26) + k)))


def text_mark(text: Column) -> Column:
    """What tells the texts of a repeated id apart, besides the id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _dealt(members: DataFrame, salt: int) -> DataFrame:
    """Members (key, n, node, group, f2, f3) of buckets, each in one tile (key, i, j) of its bucket, drawn by ``salt``: a row a member."""
    tile = F.pmod(F.xxhash64("node", "key", F.lit(salt)), F.ceil(F.col("n") / TILE))
    return members.select("key", tile.alias("i"), tile.alias("j"), "node", F.lit(-1).cast("long").alias("side"), "group", "f2", "f3")


def _across(members: DataFrame) -> DataFrame:
    """Members (key, n, n_largest, largest, node, group, f2, f3) dealt to tiles that hold each pair of a bucket's members, but for pairs inside its largest group.

    A pair is on the two sides of its tile, or (side -1) inside it. The rest of a bucket has the first tiles, its largest group those that follow.
    """
    inside = F.col("group") == F.col("largest")
    rest, large = F.ceil((F.col("n") - F.col("n_largest")) / TILE), F.ceil(F.col("n_largest") / TILE)
    drawn = F.xxhash64("node", "key", F.lit(-1))
    own = F.when(inside, rest + F.pmod(drawn, large)).otherwise(F.pmod(drawn, rest))
    others = F.sequence(F.lit(0).cast("long"), F.when(inside, rest).otherwise(rest + large) - 1)
    tiles = members.withColumn("own", own).withColumn("other", F.explode(others))
    side = F.when(F.col("own") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("own"))
    return tiles.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", side.alias("side"), "group", "f2", "f3")


def _open(crowd: DataFrame, links: DataFrame) -> DataFrame:
    """Members of those crowded buckets (key, n, node, f2, f3) that links don't connect whole, with their component as group."""
    parts = connected_components(links)
    named = materialise(crowd.join(parts, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"), "wide-crowd")
    groups = named.groupBy("key", "group").agg(F.count(F.lit(1)).alias("held"))
    most = groups.groupBy("key").agg(F.max(F.struct("held", "group")).alias("most"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return named.join(most.select("key", F.col("most.held").alias("n_largest"), F.col("most.group").alias("largest")), "key")


def _near(lanes: list[np.ndarray], k: int, side: np.ndarray, most: int) -> np.ndarray:
    """Later members of a tile that are within ``most`` bits of member ``k``, and on the other side of the tile."""
    bits = sum(np.bitwise_count(f[k + 1 :] ^ f[k]) for f in lanes)
    return k + 1 + np.flatnonzero((bits <= most) & ((side[k + 1 :] != side[k]) | (side[k] < 0)))


def _active(tiles: DataFrame) -> DataFrame:
    """Members (key, i, j, node, side, group) of tiles that have one of another group within the check bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold_cache(_NONE)
        for pdf in batches:
            out = []
            for key, i, j, *columns in zip(*(pdf[c] for c in ("key", "i", "j", "node", "side", "group", "f2", "f3"))):
                node, side, group, f2, f3 = (np.asarray(c, dtype=np.int64) for c in columns)
                lanes, hit = [f2.view(np.uint64), f3.view(np.uint64)], np.zeros(len(node), dtype=bool)
                for k in range(len(node) - 1):
                    found = _near(lanes, k, side, MAX_CHECK)
                    found = found[group[found] != group[k]]
                    if len(found):
                        hit[found] = hit[k] = True
                out += [(key, i, j, int(node[k]), int(side[k]), int(group[k])) for k in np.flatnonzero(hit)]
            yield pd.DataFrame(out, columns=["key", "i", "j", "node", "side", "group"])

    lists = tiles.groupBy("key", "i", "j").agg(F.collect_list(F.struct("node", "side", "group", "f2", "f3")).alias("m"))  # at most two sides of about TILE
    return lists.select("key", "i", "j", *[F.col(f"m.{c}").alias(c) for c in ("node", "side", "group", "f2", "f3")]).transform(map_frames, run, "key long, i long, j long, node long, side long, group long")


def _verified(active: DataFrame, held: DataFrame) -> DataFrame:
    """Links (u, v) between members whose sets are at least ``LEAST`` alike: of each tile as many as connect all that are linked in it."""

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        if len(small) < LEAST * len(large) - 1e-6:
            return False
        if not len(large):
            return True
        both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        return both >= LEAST * (len(x) + len(y) - both) - 1e-6

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for nodes, sides, groups, blobs, *lanes in zip(*(pdf[c] for c in ("node", "side", "group", "held", *FP))):
                node, side = np.asarray(nodes, dtype=np.int64), np.asarray(sides, dtype=np.int64)
                lanes, sets = [np.asarray(f, dtype=np.int64).view(np.uint64) for f in lanes], [np.frombuffer(b, dtype=np.uint64) for b in blobs]
                part = np.array(groups, dtype=np.int64)
                for k in range(len(node) - 1):
                    for m in _near(lanes, k, side, MAX_BITS):
                        if part[m] != part[k] and alike(sets[k], sets[m]):
                            out.append((int(node[k]), int(node[m])))
                            part[part == part[m]] = part[k]
            yield pd.DataFrame(out, columns=["u", "v"])
        trim_memory()

    columns = ["node", "side", "group", "held", *FP]
    lists = active.join(held, "node").groupBy("key", "i", "j").agg(F.collect_list(F.struct(*columns)).alias("m"))
    return lists.select(*[F.col(f"m.{c}").alias(c) for c in columns]).transform(map_frames, run, "u long, v long").distinct()


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, f0..f3, held) of nodes: the text of one row stands for each, and its set of shingles is held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                yield part[["node", *FP]].assign(held=[shingle_set(t, shingle).tobytes() for t in part["text"]])
        trim_memory()

    chosen = nodes.select("node", *FP, F.col("first_id").alias("chosen_id"), F.col("first_mark").alias("chosen_mark"))
    both = F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("mark") == F.col("chosen_mark"))
    texts = docs.join(chosen, both).select("node", *FP, "text")
    return texts.transform(map_frames, run, "node long, " + ", ".join(f"{c} long" for c in FP) + ", held binary").dropDuplicates(["node"])


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """Rows (doc_id, mark, component_id, stays) of every document.

    component_id is the least id reachable. ``mark`` is the text's (``text_mark``), and of each component the rows
    stay that have its least id and, where that id has several texts there, the text with the least mark.
    """

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold_cache(_NONE)
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                sizes, digests, count = [], [], np.empty((len(part), 64 * LANES), dtype=np.int64)
                for i, t in enumerate(part["text"]):
                    h = shingle_set(t, shingle)
                    count[i] = votes(h)
                    sizes.append(len(h))
                    digests.append(xxhash.xxh64_intdigest(h.tobytes()))
                lanes = wide_simhash(count)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].array, "mark": part["mark"].array, **{c: lanes[:, k] for k, c in enumerate(FP)},
                    "node": np.array(digests, dtype=np.uint64).view(np.int64), "size": np.array(sizes, dtype=np.int64), "keys": list(pair_keys(count)),
                })
        trim_memory()

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", text_mark(F.col("text")))
    lanes = ", ".join(f"{c} long" for c in FP)
    marks = materialise(docs.transform(map_frames, prints, f"doc_id long, mark long, {lanes}, node long, size long, keys array<long>"), "wide-marks")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark"))
    facts = marks.groupBy("node").agg(*[F.min(c).alias(c) for c in (*FP, "size")], least.alias("first"))
    nodes = materialise(facts.select("node", *FP, "size", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark")), "wide-prints")
    one = marks.join(nodes.select("node", "first_id", "first_mark"), "node").where(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark")))
    keys = materialise(one.dropDuplicates(["node"]).select("node", F.explode(_sized(F.col("keys"), F.col("size"))).alias("key")), "wide-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keys.join(sizes, "key").join(nodes.select("node", "f2", "f3", F.col("node").alias("group")), "node")
    members = materialise(members, "wide-members")

    def linked(tiles: DataFrame) -> DataFrame:
        active = materialise(_active(tiles), "wide-active")
        held = materialise(_sets(docs, nodes.join(active.select("node").distinct(), "node"), shingle), "wide-sets")
        return materialise(_verified(active, held), "wide-links")

    links = linked(_dealt(members, 0))
    crowd = members.where(F.col("n") > TILE).drop("group")
    if not crowd.isEmpty():
        links = links.union(linked(_dealt(_open(crowd, links), 1)))  # joins the pieces that tiles cut a group into
        links = links.union(linked(_across(_open(crowd, links))))
    parts = connected_components(links)
    placed = nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.struct(F.col("first_id").isNull().alias("bare"), F.col("first_id").alias("id"), F.col("first_mark").alias("mark")).alias("first"))
    heads = placed.groupBy("component").agg(F.min("first").alias("head"))
    named = materialise(placed.join(heads, "component").select("node", "head"), "wide-named")
    stays = F.col("doc_id").eqNullSafe(F.col("head.id")) & (F.col("mark") == F.col("head.mark"))
    return marks.join(named, "node").select("doc_id", "mark", F.col("head.id").alias("component_id"), stays.alias("stays"))
