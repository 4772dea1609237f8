"""SpotSigs, language identification and decontamination."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbago.llm import decontamination, language_id, spot_signatures

SCHEMA = "doc_id long, text string, range int, key string, lang string"
EN = "the cat and dog of house that running with stone river mountain for happy was is it on blue green".split()
DE = "der hund und die katze das haus mit einem grünen stein nicht für fluss schöner berg ist es auf blau".split()


def text(rng, vocab, n):
    return " ".join(rng.choice(vocab) + rng.choice(["", "", "s", "e", "."]) for _ in range(n))


def made():
    rng = random.Random(9)
    docs = [(-3, None), (0, ""), (1, "  \n"), (2, "the of and"), (3, "word"), (4, "the same text of it"), (5, "the same text of it"), (9, "Ünïcode the β γ δ. The 日本語 text"), (12, "the stone " * 30000)]
    docs += [(20 + 37 * k * k, text(rng, EN + DE, rng.randint(1, 300))) for k in range(60)]
    base = docs[-1][1]
    return docs + [(10**12 + k, base + f" tail{k} of mine{k}") for k in range(4)]


def frame(spark, docs, lang=None):
    return spark.createDataFrame([(i, t, 1, "k", lang(i) if lang else "xx") for i, t in docs], SCHEMA).repartition(3)


def sets(t, chain=3):
    import regex

    w = regex.sub(r"[^\p{L}\p{N}]+", " ", (t or "").lower()).strip(" ").split(" ")
    content = [(x, w[k - 1] if k and w[k - 1] in spot_signatures.ANCHORS else "^" if not k else None) for k, x in enumerate(w) if x and x not in spot_signatures.ANCHORS]
    out = {(a or "^", *(content[k + j][0] if k + j < len(content) else "" for j in range(chain))) for k, (_, a) in enumerate(content) if a or k == 0}
    return out or ({tuple(w)} if w[0] else set())


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_of_edits(spark):
    docs = sorted(made())
    rows = {r["doc_id"]: r for r in spot_signatures.fingerprint_edits(frame(spark, docs)).collect()}
    assert len(rows) == len(docs)
    prints = {}
    for k, (i, t) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        cut = len(t) // 4
        edit = t[: len(t) - cut] + nxt[:cut]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(sets(t), sets(edit))) and r["near_next"] == pytest.approx(like(sets(t), sets(nxt)))
        assert len(r["fingerprint"]) == 16 * len(sets(t))
        for s, f in ((t, r["fingerprint"]), (edit, r["edited_fingerprint"])):
            assert prints.setdefault(frozenset(sets(s)), f) == f


def test_fingerprints_small_tables(spark):
    assert spot_signatures.fingerprint_edits(frame(spark, made()).limit(0)).count() == 0
    one = spot_signatures.fingerprint_edits(frame(spark, [(7, "abcdefgh ijkl")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefgh iabc").hexdigest() and one["near_next"] == 1.0
    odd = spot_signatures.fingerprint_edits(frame(spark, [(None, "zzzz"), (-(1 << 63), "yyyy"), ((1 << 63) - 1, "xxxx"), (5, "wwww")])).collect()
    assert {r["edited_sha256"] for r in odd} >= {hashlib.sha256(x).hexdigest() for x in (b"wwwx",)} and len(odd) == 4


def test_ranges_of_uneven_ids(spark):
    ids = [*range(900), *range(10**12, 10**12 + 90), *[10**15 + k * 10**9 for k in range(10)]]
    random.Random(3).shuffle(ids)
    df = spark.createDataFrame([(i, f"stone{i} river{i * 7}") for i in ids], "doc_id long, text string").repartition(4)
    for rows_each in (10, 250, 5000):
        docs, ranges = spot_signatures.id_ranges(df, "doc_id", rows_each)
        held = {r["range"]: r for r in docs.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()}
        assert sum(r["n"] for r in held.values()) == len(ids) and max(r["n"] for r in held.values()) <= 2 * rows_each
        assert set(held) <= set(range(ranges)) and all(held[x]["b"] < held[y]["a"] for x, y in zip(sorted(held), sorted(held)[1:]))
        after = {r["doc_id"]: r["next_text"] for r in spot_signatures.with_next(df, "doc_id", "text", rows_each=rows_each).collect()}
        order = sorted(ids)
        assert after == {i: f"stone{j} river{j * 7}" for i, j in zip(order, order[1:] + order[:1])}


def test_spot_join(spark):
    docs = made()
    rng = random.Random(1)
    for i, t in list(docs)[15:45]:
        w = (t or "").split()
        for _ in range(len(w) // 60 + 1):
            w[rng.randrange(len(w))] = "changed"
        docs.append((10**9 + i, " ".join(w)))
    df = frame(spark, docs)
    member = {r["doc_id"]: r["class_id"] for r in spot_signatures.classes(df).collect()}
    whole = {}
    for i, t in docs:
        whole.setdefault(frozenset(sets(t)), []).append(i)
    assert all(member[i] == min(v) for v in whole.values() for i in v)
    got = {frozenset((r["class_a"], r["class_b"])) for r in spot_signatures.near_duplicates(df).collect()}
    assert got == {frozenset((min(whole[a]), min(whole[b]))) for a, b in combinations(whole, 2) if a and b and like(a, b) >= 0.8} and got


def test_language(spark):
    rng = random.Random(3)
    docs = [(i, text(rng, EN if i % 3 else DE, rng.randint(3, 60))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "12 34 !!"), (1003, "½ ²"), (1004, "the " * 30000), (1004, "the " * 30000), (None, "der hund und die katze")]
    df = frame(spark, docs, lambda i: None if i is None or i % 10 == 9 else "en" if i % 3 else "de")
    model = language_id.fit(df, sample_rows=200)
    assert model.languages == ["de", "en"]
    got = language_id.identify(df, model).collect()
    assert len(got) == len(docs)
    lang = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert all(lang[i] == ("und", 0.0) for i in (1000, 1001, 1002, 1003))
    assert all(0 <= s <= 1 for _, s in lang.values()) and lang[1004][0] == "en" and lang[None][0] == "de"
    test = [i for i in range(400) if i % 10 == 9]
    assert np.mean([lang[i][0] == ("en" if i % 3 else "de") for i in test]) > 0.97
    mixed = "the cat and the dog of that house " * 3 + "der hund und die katze mit einem schöner berg " * 3
    labels = language_id.label_words(frame(spark, [(1, mixed)]), model).first()["labels"]
    assert [x["lang"] for x in labels[2:20]] == ["en"] * 18 and [x["lang"] for x in labels[-18:]] == ["de"] * 18
    assert language_id.identify(df.limit(0), model).count() == 0
    assert language_id.fit(df.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}


def test_held_out(spark):
    import zlib

    rows = spark.range(-3, 50).select("id", language_id.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    model = language_id.LanguageCRF(["a", "b", "c"], np.zeros((1, 3), np.float32), rng.normal(size=(3, 3)), {})
    scores = rng.normal(size=(9, 3))
    starts = np.array([0, 4, 5])
    moves = np.zeros((3, 3))
    got = model.marginals(scores, starts, moves)
    want, pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for a, b in zip(starts, [4, 5, 9]):
        total = 0.0
        part, part_pairs = np.zeros((b - a, 3)), np.zeros((3, 3))
        for y in np.ndindex(*[3] * (b - a)):
            p = np.exp(sum(scores[a + t, y[t]] for t in range(b - a)) + sum(model.transitions[y[t - 1], y[t]] for t in range(1, b - a)))
            total += p
            for t in range(b - a):
                part[t, y[t]] += p
                if t:
                    part_pairs[y[t - 1], y[t]] += p
        want[a:b] = part / total
        pairs += part_pairs / total
    assert np.allclose(got, want) and np.allclose(moves, pairs)


def items():
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "zu", "ter", "non") for b in ("pa", "ri", "so", "the", "xen", "qua", "ble")]
    return [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 40))) + ". " + " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9))) + ".") for k in range(40)], vocab, rng


def test_leaks(spark):
    tests, vocab, rng = items()
    fill = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, want = [(0, None), (1, ""), (2, "... !!"), (3, fill(9000))], set()
    for k in range(60):
        own = tests[k % 40][1]
        if k % 3 == 0:
            docs.append((10 + k, fill(rng.randint(0, 900)) + "\n" + own.upper().replace(" ", "  ") + " " + fill(rng.randint(0, 300))))
            want.add((10 + k, k % 40))
        elif k % 3 == 1:
            docs.append((10 + k, fill(400) + " " + " ".join(own.split()[: len(own.split()) // 3]) + " " + fill(50)))
        else:
            docs.append((10 + k, fill(rng.randint(1, 500))))
    df = frame(spark, docs)
    bench = spark.createDataFrame([*tests, (900, None), (901, "..")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df, bench).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df, bench, block_bytes=900).collect()} == want
    assert decontamination.find_leaks(df.limit(0), bench).count() == 0 and decontamination.find_leaks(df, bench.limit(0)).count() == 0


def test_wand_returns_all_above_threshold():
    tests, vocab, rng = items()
    index = decontamination.ItemIndex(tests, block=3)
    for _ in range(200):
        own = np.array(sorted({index.terms[w.encode()] for w in rng.sample(vocab, rng.randint(1, 25)) if w.encode() in index.terms}), dtype=np.int64)
        want = {}
        for t in own:
            for i, g in index.postings(t):
                want[int(i)] = want.get(int(i), 0) + g
        for least in (0.05, 0.3, 0.5):
            got = dict(index.search(own, least))
            assert dict(index.search(own, least, at_once=0)) == got
            assert got.keys() == {i for i, s in want.items() if s >= least - 1e-12} or min(abs(s - least) for s in want.values()) < 1e-9
            assert all(abs(want[i] - s) < 1e-9 for i, s in got.items())


def test_leak_scores_do_not_depend_on_blocks(spark):
    from plumbago.llm.decontamination import find_leaks

    rng = random.Random(3)
    items = [(k, " ".join(f"{'common' if rng.random() < 0.3 else 'rare'}{rng.randrange(40)}" for _ in range(10 + 3 * (k % 9)))) for k in range(40)] + [(90, None), (91, " ")]
    docs = [(k, "before it " * 5 + (t or "").rpartition(" ")[0] + " after it" * 5) for k, t in items]  # the last word is missing
    held, texts = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    whole, blocks = (sorted(map(tuple, find_leaks(texts, held, block_bytes=n).collect())) for n in (1 << 20, 600))
    assert len(whole) >= 40 and [r[:2] for r in whole] == [r[:2] for r in blocks]
    assert all(abs(a - b) < 1e-9 for x, y in zip(whole, blocks) for a, b in zip(x, y))
