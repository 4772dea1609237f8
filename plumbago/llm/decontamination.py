"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Test items are a stated query set; they are indexed in parts of bounded size (all items in one pass up to
that size), and each part meets all documents. Statistics and the width of passages are those of the whole
set, so that no score depends on the parts. Every document is cut into overlapping passages (each item fits
into one whole), and every passage is a query. Items are sorted by length into small blocks; each posting
list knows its largest contribution, and that of each block it has postings in. Lists that can't reach the
threshold together open no block. Of the blocks that the others name, those whose maxima can't reach it with
the rest are skipped; in what is left WAND walks the posting lists with the block's maxima as bounds.
An item's score is its BM25 sum divided by the score the item itself reaches, so that one threshold
holds for items of any length, and every item above it is returned.

Retrieved items are verified on the passage and its neighbours: an item is found if 80 % of its
five-word shingles occur there, or if 80 % of those of its question (all sentences but the last) and
of its answer (the last) do; a part of fewer than five words is one shingle.

Defined cases: null, empty and blank texts match nothing; items without a word are ignored; repeated
items and rows are matched each; an empty table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import map_frames, materialise

K1, B = 1.2, 0.75
SHINGLE = 5
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: All ASCII that is neither letter nor digit separates words; other characters belong to them.
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8").translate(_PLAIN).split() if text else []


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """Five-word shingles; a shorter text is one shingle."""
    return list(zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [tuple(words)] if words else []


def share_found(parts: list[tuple[bytes, ...]], words: list[bytes], there: set[tuple[bytes, ...]]) -> float:
    """Share of the shingles that occur among the words (there: their five-word shingles)."""
    if not parts:
        return 1.0
    if len(parts) == 1 and len(parts[0]) < SHINGLE:
        n = len(parts[0])
        return float(any(tuple(words[i : i + n]) == parts[0] for i in range(len(words) - n + 1)))
    return sum(p in there for p in parts) / len(parts)


@dataclass
class Statistics:
    """What scores need to know of all items: their number, words and longest one, and how many hold each word."""

    items: int
    words: int
    longest: int
    seen: Mapping[bytes, int]


class ItemIndex:
    """Inverted index of a part of the items, with block-max bounds. Without statistics the part is the whole set.

    Postings are flat arrays, list after list; so are the maxima of the blocks each list has postings in.
    """

    def __init__(self, items: list[tuple[int, str]], block: int = 4, whole: Statistics | None = None) -> None:
        known = [(item, text, words) for item, text in items if (words := words_of(text))]
        known.sort(key=lambda x: len(x[2]))  # like lengths share a block, so its maxima are tight
        self.ids, self.texts = [x[0] for x in known], [x[1] for x in known]
        lists = [x[2] for x in known]
        seen = Counter(w for own in lists for w in set(own))
        whole = whole or Statistics(len(lists), sum(map(len, lists)), max(map(len, lists), default=0), seen)
        n, mean = whole.items, whole.words / max(1, whole.items)
        self.terms = {w: i for i, w in enumerate(seen)}
        idf = {w: float(np.log1p((n - k + 0.5) / (k + 0.5))) for w, k in ((w, whole.seen[w]) for w in seen)}
        term, item, gain = [], [], []
        for i, own in enumerate(lists):
            gains = {w: idf[w] * k * (K1 + 1) / (k + K1 * (1 - B + B * len(own) / mean)) for w, k in Counter(own).items()}
            most = sum(gains.values()) or 1.0
            term += [self.terms[w] for w in gains]
            item += [i] * len(gains)
            gain += [g / most for g in gains.values()]
        term, item, gain = np.array(term, dtype=np.int64), np.array(item, dtype=np.int32), np.array(gain, dtype=np.float64)
        order = np.argsort(term, kind="stable")  # items ascend within a list
        term, self.items, self.gains = term[order], item[order], gain[order]
        self.starts = np.searchsorted(term, np.arange(len(self.terms) + 2))  # one list more, empty: words outside the index
        self.block = block
        place = self.items // block
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (place[1:] != place[:-1])]) if len(term) else np.empty(0, np.int64)
        self.blocks = place[first]
        self.bounds = (np.maximum.reduceat(self.gains, first) if len(first) else self.gains) * (1 + 1e-9)
        self.block_starts = np.searchsorted(term[first], np.arange(len(self.terms) + 2))
        self.tops = np.zeros(len(self.terms) + 1)
        np.maximum.at(self.tops, term[first], self.bounds)
        self.longest = whole.longest
        self.parts: dict[int, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parts": {}}

    def postings(self, term: int) -> list[tuple[int, float]]:
        """The list of a term: items and what it gives to each."""
        a, b = self.starts[term], self.starts[term + 1]
        return list(zip(self.items[a:b].tolist(), self.gains[a:b].tolist()))

    def shingles_of(self, i: int) -> tuple[list, list, list]:
        """Shingles of an item, its question and its answer; made when first asked for, for a bounded number of items."""
        if i not in self.parts:
            if len(self.parts) >= 4096:
                self.parts.clear()
            text = self.texts[i]
            sentences = _SENTENCE.split(text.strip())
            question, answer = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, "")
            self.parts[i] = tuple(shingles(words_of(x)) for x in (text, question, answer))
        return self.parts[i]

    def _gather(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that the lists of the terms have postings in, list after list, and their maxima there."""
        start = self.block_starts[terms]
        size = self.block_starts[terms + 1] - start
        ends = size.cumsum()
        at = np.arange(ends[-1]) + (start - ends + size).repeat(size)
        return self.blocks[at], self.bounds[at]

    def search(self, terms: np.ndarray, least: float, at_once: int = 20_000) -> list[tuple[int, float]]:
        """All items whose score over the given distinct terms is at least ``least``.

        The maxima of up to ``at_once`` blocks are summed together. Beyond that, lists that can't reach the threshold
        together open no block, and are added, largest first, only for blocks that can still reach it.
        """
        tops = self.tops[terms]
        if tops.sum() < least:
            return []
        low = least * (1 - 1e-9)
        if (self.block_starts[terms + 1] - self.block_starts[terms]).sum() <= at_once:
            blocks, bounds = self._gather(terms)
            named = np.flatnonzero(np.bincount(blocks, bounds) >= low)
        else:
            order = np.argsort(tops)
            below = np.cumsum(tops[order])
            idle = int(np.searchsorted(below, low))
            blocks, bounds = self._gather(terms[order[idle:]])
            named, place = np.unique(blocks, return_inverse=True)
            reach = np.bincount(place, bounds, len(named))
            for k in range(idle - 1, -1, -1):
                open_ = reach + below[k] >= low
                named, reach = named[open_], reach[open_]
                if not len(named):
                    break
                a, b = self.block_starts[terms[order[k]]], self.block_starts[terms[order[k]] + 1]
                at = np.minimum(np.searchsorted(self.blocks[a:b], named), b - a - 1)
                reach += np.where(self.blocks[a:b][at] == named, self.bounds[a:b][at], 0.0)
            named = named[reach >= low]
        return [hit for k in named.tolist() for hit in self._wand(terms, k, least)]

    def _wand(self, terms: np.ndarray, block: int, least: float) -> list[tuple[int, float]]:
        """WAND over the postings of one block of items, with the block's maxima as bounds."""
        end = (block + 1) * self.block
        cursors = []  # item, bound, position, end of the list
        for t in terms.tolist():
            low, high = int(self.block_starts[t]), int(self.block_starts[t + 1])
            k = bisect_left(self.blocks, block, low, high)
            if k < high and self.blocks[k] == block:
                stop = int(self.starts[t + 1])
                at = bisect_left(self.items, block * self.block, int(self.starts[t]), stop)
                cursors.append([int(self.items[at]), float(self.bounds[k]), at, stop])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[1]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:  # what is left can't reach the threshold together
                break
            at = cursors[pivot][0]
            if cursors[0][0] == at:  # every list before the pivot is there: score the item
                score, moved = 0.0, []
                for c in cursors:
                    if c[0] == at:
                        score += float(self.gains[c[2]])
                        moved.append((c, c[2] + 1))
                if score >= least:
                    found.append((at, score))
            else:  # skip the items that the lists before the pivot can't bring to the threshold
                moved = [(c, bisect_left(self.items, at, c[2], c[3])) for c in cursors[:pivot] if c[0] < at]
            for c, place in moved:
                c[2] = place
                c[0] = int(self.items[place]) if place < c[3] else end
            cursors = [c for c in cursors if c[0] < end]
        return found

    def passages(self, known: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """Starts of the overlapping passages that may hold an item, with their distinct terms."""
        terms = len(self.terms)
        for first in (0, width // 2):
            at = np.flatnonzero(known[first:] >= 0)
            if len(at):
                pairs = np.unique(at // width * terms + known[first:][at])
                window, term = pairs // terms, pairs % terms
                cuts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
                yield from ((first + int(window[a]) * width, term[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(pairs)]))

    def matches(self, text: str | None, least: float, overlap: float) -> list[tuple[int, float, float, float, float]]:
        """Verified items of a document: (item, best score, share of item, of question, of answer)."""
        words = words_of(text)
        known = np.fromiter(map(self.terms.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        width = max(32, 2 * self.longest)
        best: dict[int, tuple[float, float, float, float]] = {}
        for a, terms in self.passages(known, width):
            hits = self.search(terms, least)
            if not hits:
                continue
            near = words[max(0, a - width // 2) : a + width + width // 2]
            there = set(shingles(near))
            for i, score in hits:
                whole, question, answer = (share_found(p, near, there) for p in self.shingles_of(i))
                if (whole >= overlap or question >= overlap and answer >= overlap) and (i not in best or (score, whole) > best[i][:2]):
                    best[i] = (score, whole, question, answer)
        return [(self.ids[i], *found) for i, found in sorted(best.items())]


def item_parts(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed to the driver partition by partition."""
    held, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(r["t"]) + 64
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def indexes(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[ItemIndex]:
    """An index for each block. Beyond one block, Spark counts words over all items, and a block gets those it holds."""
    blocks = item_parts(items, id_col, text_col, block_bytes)
    first = list(islice(blocks, 2))
    if len(first) < 2:
        yield from map(ItemIndex, first)
        return

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = [w for t in pdf["t"] if (w := words_of(t))]
            seen = Counter(w for own in lists for w in set(own))
            yield pd.DataFrame({"word": [None, *seen], "items": [len(lists), *seen.values()], "words": sum(map(len, lists)), "longest": max(map(len, lists), default=0)})

    texts = items.select(F.col(text_col).alias("t")).where("t is not null")
    sums = texts.transform(map_frames, counted, "word binary, items long, words long, longest long").groupBy("word").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest"))
    sums = materialise(sums, "item-words")  # the row without a word is for all items
    total = sums.where("word is null").first()
    for block in chain(first, blocks):
        own = pd.DataFrame({"word": list({w for _, t in block for w in words_of(t)})}, dtype=object)
        held = sums.join(F.broadcast(items.sparkSession.createDataFrame(own, "word binary")), "word").select("word", "items").collect() if len(own) else []
        yield ItemIndex(block, whole=Statistics(total["items"], total["words"], total["longest"], {bytes(r["word"]): r["items"] for r in held}))


def find_leaks(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    least: float = 0.6, overlap: float = 0.8, block_bytes: int = 16 << 20, columns: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (doc_id, *columns, item_id, score, item_share, question_share, answer_share) of every verified match.

    ``least`` is the share of its own BM25 score an item must reach in a passage. One pass over the
    documents for each ``block_bytes`` of items; only such a part, whose size is bounded, is broadcast.
    ``columns`` (integers) go along.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("long") for c in columns], F.col(text_col).alias("text"))
    own = ["doc_id", *columns]
    schema = ", ".join(f"{c} long" for c in own) + ", item_id long, score double, item_share double, question_share double, answer_share double"
    out = None
    for index in indexes(items, item_col, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            for pdf in batches:
                rows = [(*key, *m) for *key, t in zip(*(pdf[c] for c in own), pdf["text"]) for m in index.matches(t, least, overlap)]
                yield pd.DataFrame(rows, columns=[*own, "item_id", "score", "item_share", "question_share", "answer_share"], dtype=object)

        found = docs.transform(map_frames, run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)
