"""Best-fit packing by bin completion branch-and-bound over the histogram of piece lengths.

How pieces fill sequences depends only on how many pieces have each length, and there are at most
``capacity`` lengths, so the search runs on the driver over a table whose size no corpus changes.
It works with patterns (a filling and how often it is used):

* the first incumbent is best-fit decreasing, and every better solution found takes its place,
* the bound is the total length over the capacity, or the large-item bound where that is stronger,
* each node takes the largest length left and branches over undominated fillings around it; a branch ends
  when the waste so far exceeds what a solution better than the incumbent may waste,
* the filling tried first has the largest pieces among those that waste no more than an allowance, a multiple
  (``SPENDING``) of the mean waste per sequence that is still allowed: so short pieces are kept for the
  end. Sums that fillings can reach come from a bounded knapsack over the lengths left.

Spark then hands pieces to patterns: a piece's rank among those of its length (ranked in salted
groups, with prefix sums over the groups) falls into one pattern's range, which gives sequence and
offset without collecting any group.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbago.llm.common import map_frames, materialise, parts_for, trim_memory
from plumbago.llm.tokens import tokenizer

Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the Martello-Toth bound over all thresholds."""
    best = ceil(sum(s * n for s, n in counts.items()) / capacity)
    for k in sorted({s for s in counts if s <= capacity // 2} | {0}):
        big = sum(n for s, n in counts.items() if s > capacity - k)
        mid = [(s, n) for s, n in counts.items() if capacity - k >= s > capacity / 2]
        low = sum(s * n for s, n in counts.items() if k <= s <= capacity / 2)
        room = sum(n * (capacity - s) for s, n in mid)
        best = max(best, big + sum(n for _, n in mid) + max(0, ceil((low - room) / capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Best-fit decreasing on whole groups of equal lengths and equal open sequences."""
    room: dict[int, dict[Pattern, int]] = {}

    def put(left: int, pattern: Pattern, times: int) -> None:
        if times:
            room.setdefault(left, {})[pattern] = room.get(left, {}).get(pattern, 0) + times

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            fits = [r for r in room if r >= s]
            if not fits:
                per = capacity // s
                put(capacity - per * s, ((s, per),), n // per)
                if n % per:
                    put(capacity - n % per * s, ((s, n % per),), 1)
                break
            r = min(fits)
            group = room.pop(r)
            per = r // s
            for pattern, times in group.items():
                used = min(times, n // per)
                put(r - per * s, (*pattern, (s, per)), used)
                n -= used * per
                if used < times and n:  # fewer left than one more sequence takes
                    put(r - n * s, (*pattern, (s, n)), 1)
                    used, n = used + 1, 0
                put(r, pattern, times - used)
    out: dict[Pattern, int] = {}
    for group in room.values():
        for pattern, times in group.items():
            out[pattern] = out.get(pattern, 0) + times
    return out


def _dominated(filling: list[int], waste: int, left: dict[int, int]) -> bool:
    """Whether one length still to be had could take the place of some pieces of the filling and waste no more."""
    if len(filling) > 12:
        return False
    single, sums = 0, 1
    for s in filling:
        single |= 1 << s
        sums |= sums << s
    for x, n in left.items():
        if n > filling.count(x) and (sums >> max(0, x - waste)) & ((1 << (x - max(0, x - waste))) - 1) & ~1:
            return True  # a subset smaller than x that x replaces
    return False


def completions(largest: int, counts: dict[int, int], order: list[int], capacity: int, want: int, visits: int, slack: int) -> list[tuple[int, Pattern]]:
    """Undominated fillings around one piece of the largest length, least waste first."""
    found: dict[tuple[int, ...], int] = {}
    budget, perfect = visits, 0
    negative = [-s for s in order]

    def free(s: int, chosen: list[int]) -> bool:
        return counts.get(s, 0) - (s == largest) > chosen.count(s)

    def grow(at: int, left: int, chosen: list[int]) -> None:
        nonlocal budget, perfect
        budget -= 1
        if left and (not chosen or left <= chosen[-1]) and free(left, chosen):  # one piece closes it
            found[(*chosen, left)] = 0
            perfect += 1
        fits = False
        for i in range(max(at, bisect_left(negative, -left)), len(order)):
            if budget <= 0 or perfect >= want:
                return
            if free(order[i], chosen):
                fits = True
                if order[i] < left:
                    chosen.append(order[i])
                    grow(i, left - order[i], chosen)
                    chosen.pop()
        if not fits and left <= slack:
            found[tuple(chosen)] = left

    grow(0, capacity - largest, [])
    out = []
    for chosen, waste in sorted(found.items(), key=lambda x: (x[1], len(x[0]))):
        if waste and _dominated(list(chosen), waste, counts):
            continue
        pattern: dict[int, int] = {largest: 1}
        for s in chosen:
            pattern[s] = pattern.get(s, 0) + 1
        out.append((waste, tuple(sorted(pattern.items(), reverse=True))))
        if len(out) >= want:
            break
    return out


def filling(largest: int, counts: dict[int, int], capacity: int, allowance: int) -> tuple[int, Pattern]:
    """The filling around one piece of the largest length with the largest pieces among those that waste at most
    ``allowance``, or that waste least if none does; and its waste."""
    room = capacity - largest
    sizes = sorted(s for s in counts if s <= room)
    mask, sums = (1 << room + 1) - 1, [1]
    for s in sizes:  # bit t of sums[i]: the first i lengths can make up t
        reach, n, step = sums[-1], min(counts[s] - (s == largest), room // s), 1
        while n > 0:
            step = min(step, n)
            reach |= reach << step * s & mask
            n, step = n - step, 2 * step
        sums.append(reach)
    high = room
    low = min(sums[-1].bit_length() - 1, max(0, room - allowance))
    pattern = {largest: 1}
    for i in range(len(sizes) - 1, -1, -1):
        s = sizes[i]
        for n in range(min(counts[s] - (s == largest), high // s), -1, -1):
            least = max(0, low - n * s)
            if sums[i] >> least & (1 << high - n * s - least + 1) - 1:
                if n:
                    pattern[s] = pattern.get(s, 0) + n
                low, high = low - n * s, high - n * s
                break
        if low <= 0 and (not i or sizes[0] > high):
            break
    return capacity - sum(s * n for s, n in pattern.items()), tuple(sorted(pattern.items(), reverse=True))


#: Multiples of the mean waste still allowed that a filling may have; the last is for any waste (largest piece first).
SPENDING = (4.0, 1.0, 10.0, 0.0, 20.0, 2.0, float("inf"))


def pack_histogram(counts: dict[int, int], capacity: int, nodes: int = 400, branches: int = 3, visits: int = 250) -> tuple[dict[Pattern, int], int]:
    """Patterns and their uses for a histogram of lengths, and the lower bound.

    ``nodes`` (for each of ``SPENDING``, beyond a first descent), ``branches`` and ``visits`` bound the search
    only: whatever it leaves, every piece is packed.
    """
    counts = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    if not counts:
        return {}, 0
    best = best_fit_decreasing(counts, capacity)
    bins, bound = sum(best.values()), lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())

    def others(left: dict[int, int], wasted: int, tried: Pattern, allowed: int) -> list[tuple[int, Pattern]]:
        """Undominated fillings around the largest piece besides the one tried."""
        found = completions(max(left), left, sorted(left, reverse=True), capacity, branches, visits, allowed - wasted)
        return [x for x in found if x[1] != tried and wasted + x[0] <= allowed][: branches - 1]

    def search(spending: float) -> dict[Pattern, int] | None:
        """Depth first with an explicit stack; the first solution with fewer sequences wins."""
        allowed = (bins - 1) * capacity - total
        budget, descent = nodes, True
        stack: list[tuple[dict[int, int], int, int, list[tuple[Pattern, int]], Pattern | None]] = [(counts, 0, 0, [], None)]
        while stack and budget > 0:
            left, wasted, used, taken, tried = stack.pop()
            descent = descent and tried is None
            budget -= not descent
            if not left:
                solution: dict[Pattern, int] = {}
                for p, n in taken:
                    solution[p] = solution.get(p, 0) + n
                return solution
            if sum(s * n for s, n in left.items()) <= capacity:  # the last sequence
                stack.append(({}, wasted, used + 1, [*taken, (tuple(sorted(left.items(), reverse=True)), 1)], None))
                continue
            if tried is None:
                mean = max(0, allowed - wasted) / max(1, bins - 1 - used)
                way = filling(max(left), left, capacity, capacity if spending == float("inf") else int(spending * mean))
                stack.append((left, wasted, used, taken, way[1]))
                ways = [way] if wasted + way[0] <= allowed else []
            else:
                ways = others(left, wasted, tried, allowed)
            for waste, pattern in reversed(ways):
                times = min(left[s] // n for s, n in pattern)
                if waste:
                    times = min(times, (allowed - wasted) // waste)
                stack.append((_minus(left, pattern, times), wasted + waste * times, used + times, [*taken, (pattern, times)], None))
        return None

    for spending in SPENDING:
        while bins > bound and (better := search(spending)):
            best, bins = better, sum(better.values())
    return best, bound


def _minus(left: dict[int, int], pattern: Pattern, times: int) -> dict[int, int]:
    rest = dict(left)
    for s, n in pattern:
        rest[s] -= n * times
        if not rest[s]:
            del rest[s]
    return rest


def document_pieces(df: DataFrame, tokenizer_file: str, capacity: int, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): documents with their end id, longer ones cut.

    Only the first piece of a cut document may be shorter than the capacity.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, end, width = tokenizer(tokenizer_file), end_id.to_bytes(4, "little"), 4 * capacity
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = tok.ids(text) + end if text else end
                at = piece = 0
                while at < len(ids):
                    stop = at + (len(ids) - at - 1) % width + 1 if at == 0 else at + width
                    rows.append((doc_id, piece, at >> 2, (stop - at) >> 2, zlib.crc32(ids[at:stop])))
                    at, piece = stop, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"], dtype=object)
        trim_memory()

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.transform(map_frames, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, group_rows: int = 50_000, **search: int) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, length, ...)."""
    spark = pieces.sparkSession
    pieces = materialise(pieces, "pieces")
    salts = parts_for(pieces.count(), group_rows)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = materialise(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    patterns, _ = pack_histogram(histogram, capacity, **search)
    used = dict.fromkeys(histogram, 0)
    rows, base = [], 0
    for pattern, times in patterns.items():
        offset = 0
        for size, n in pattern:
            rows.append((size, used[size], used[size] + n * times, n, base, offset))
            used[size] += n * times
            offset += n * size
        base += times
    plan = spark.createDataFrame(rows, "size long, low long, high long, per long, base long, at long")
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    fits = (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    within = F.col("rank") - F.col("low")
    placed = ranked.join(F.broadcast(plan), fits)  # a row per length and pattern: bounded by the capacity, not by the corpus
    return placed.select(
        *[c for c in pieces.columns if c != "salt"],
        (F.col("base") + F.floor(within / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(within, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(df: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of all documents with their place in as few sequences as the search finds."""
    return pack(document_pieces(df, tokenizer_file, capacity, end_id, id_col, text_col), capacity)
