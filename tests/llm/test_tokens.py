"""Token ids, packing and token shards."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbago.llm import packing, sstable
from plumbago.llm.tokens import PieceTokenizer, tokenizer_path
from tests.llm import brute

ODD = [
    None, "", " ", "  a", "a  b", "a \n b\tc ", "İI ßs'T don't DON'T x’s   y", "<|endoftext|> a <|endoftext|>", "日本語 テスト 12½ ²³", "a\u0085b",
    "x\x1fy \x1f z", "Ω ς Σ", "a ́b", "1 2  3   4", "﻿a b", "word " * 6000, "ab\n\ncd ef gh", "Éa éa", "'s 't s 's",
]


def made():
    rng = random.Random(3)
    vocab = ["the", "Thing,", "öl", "naïve.", "x1", "don't", "Straße\nneu", "—", "αβ"]
    return [(i, t) for i, t in enumerate(ODD)] + [(100 + 7 * i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 700)))) for i in range(60)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in docs], "doc_id long, text string, piece string, length int, salt int").repartition(4)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_whole_tokenizer(name):
    texts = [t for _, t in made()]
    for limit in (5, 1000):
        own = PieceTokenizer(tokenizer_path(name), limit)
        for t, ids in zip(texts, brute.token_ids(name, texts)):
            assert np.frombuffer(own.ids(t or ""), dtype="<u4").tolist() == ids[:-1], t[:40]


def test_packing(spark):
    docs = made()
    ids = dict(zip((i for i, _ in docs), brute.token_ids("byte_bpe_50k.json", [t for _, t in docs])))
    rows = packing.pack_documents(frame(spark, docs), tokenizer_path("byte_bpe_50k.json")).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == brute.crc(ids[i][at : at + r["length"]])
            at += r["length"]
        assert at == len(ids[i]) and all(r["length"] == 1024 for r in own[1:])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    sizes = Counter(r["length"] for r in rows)
    assert len(by_sequence) <= packing.lower_bound(sizes, 1024) + 1
    assert packing.pack_documents(frame(spark, docs).limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing_search_is_optimal_on_small_sets():
    def least(sizes, cap):
        n, best = len(sizes), {0: (0, 0)}
        for mask in range(1, 1 << n):  # subset programme: (sequences, fill of the last)
            best[mask] = min((lambda b, f: (b, f + sizes[i]) if b and f + sizes[i] <= cap else (b + 1, sizes[i]))(*best[mask ^ (1 << i)]) for i in range(n) if mask >> i & 1)
        return best[(1 << n) - 1][0]

    rng = random.Random(5)
    hit = 0
    for _ in range(30):
        sizes = [rng.randint(15, 70) for _ in range(11)]
        found, bound = packing.pack_histogram(dict(Counter(sizes)), 100)
        used = Counter()
        for p, n in found.items():
            assert sum(s * k for s, k in p) <= 100
            for s, k in p:
                used[s] += k * n
        assert used == Counter(sizes)
        best = least(sizes, 100)
        assert bound <= best <= sum(found.values()) <= best + 1
        hit += sum(found.values()) == best
    assert hit >= 28


def test_best_fit_decreasing_equals_piecewise():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 300))]
        room = []
        for s in sorted(sizes, reverse=True):
            fits = [(r, i) for i, r in enumerate(room) if r >= s]
            if fits:
                room[min(fits)[1]] -= s
            else:
                room.append(100 - s)
        assert sum(packing.best_fit_decreasing(dict(Counter(sizes)), 100).values()) == len(room)


def test_token_shards(spark):
    docs = [(-5, "negative id"), (None, "no id"), *made(), (107, "107 once more")]
    path = tokenizer_path("word_bpe_49k.json")
    folder, manifest = sstable.write_shards(frame(spark, docs), path, shard_bytes=20_000, block_bytes=500)
    got = {(r["doc_id"], r["start"]): r for r in sstable.read_shards(spark, folder, manifest, with_ids=True).collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    start = 0
    for (i, _), ids in zip(order, brute.token_ids("word_bpe_49k.json", [t for _, t in order])):
        r = got[i, start]
        assert (r["n_tokens"], r["ids_crc32"], r["ids"]) == (len(ids), brute.crc(ids), ids)
        start += len(ids)
    assert len(got) == len(docs)
    rows = manifest.collect()
    assert len(rows) > 2
    assert len(sstable.lookup(folder, rows, 107)) == 2 and len(sstable.lookup(folder, rows, None)) == 1
    assert sstable.lookup(folder, rows, 101) == []
    folder, manifest = sstable.write_shards(frame(spark, docs).limit(0), path)
    assert sstable.read_shards(spark, folder, manifest).count() == 0


def test_bloom_filter():
    keys = [sstable.encode_key(i) for i in range(2000)]
    bloom = sstable.Bloom(keys)
    assert all(k in bloom for k in keys)
    assert sum(sstable.encode_key(i) in bloom for i in range(10_000, 30_000)) < 600


def test_packing_search_improves_on_best_fit():
    rng = random.Random(7)
    better = 0
    for _ in range(6):
        sizes = Counter(rng.choice((rng.randint(1, 300), rng.randint(200, 1000))) for _ in range(300))
        best_fit = sum(packing.best_fit_decreasing(dict(sizes), 1024).values())
        found, bound = packing.pack_histogram(dict(sizes), 1024)
        used = Counter()
        for p, n in found.items():
            assert sum(s * k for s, k in p) <= 1024
            for s, k in p:
                used[s] += k * n
        assert used == sizes and bound <= sum(found.values()) <= best_fit
        better += sum(found.values()) < best_fit
    assert better >= 1


def test_filling_wastes_no_more_than_allowed():
    rng = random.Random(8)
    for _ in range(200):
        counts = Counter(rng.randint(1, 60) for _ in range(rng.randint(1, 12)))
        largest, allowance = max(counts), rng.randint(0, 20)
        waste, pattern = packing.filling(largest, counts, 100, allowance)
        reach = {0}
        for s, n in (counts - Counter([largest])).items():
            reach = {t + k * s for t in reach for k in range(n + 1) if t + k * s <= 100 - largest}
        assert all(counts[s] >= n for s, n in pattern) and dict(pattern)[largest] >= 1 and 100 - sum(s * n for s, n in pattern) == waste
        assert waste <= max(allowance, 100 - largest - max(reach))
