"""Language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features with a weight per language; a learned
transition matrix ties neighbours, so that code-switched text gets a language for every word by
forward-backward. A document's language is the one with the largest expected number of words.

Training takes a bounded, documented sample of labelled rows (``sample_rows``, lowest identifier
hashes first, whole texts): chains of up to 64 words, part of them joined from two documents, so
that transitions between languages are seen. Prediction reads whole texts, in chains of 64 words.

Words of more than 24 letters are read in parts of 24, each a word of the chain, so that scripts without
spaces are read whole.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text
where no labelled row exists; ties go to the language first in alphabetical order; repeated rows
are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import BATCH_ROWS, hold_cache, map_frames, trim_memory

CHAIN = 64
#: Size of the hashed feature space; one more row holds zero weights for absent features.
HASHED = 1 << 16
#: Distinct words whose features are made at a time.
WORDS = 4_000
WIDTH = 24
_WORD = re.compile(r"[^\W\d_]{1,%d}" % WIDTH)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
#: Share of a word's training uses in one language from which the lexicon calls it sure or likely.
SURE, LIKELY = 0.9, 0.5


def held_out(id_col: Column) -> Column:
    """Documents that training never sees: crc32 of the identifier's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_words(text: str | None) -> list[str]:
    """Lower-case letter words of a whole text; longer ones in parts."""
    return _WORD.findall(text.lower()) if text else []


def _shape(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word between boundary marks, and the lengths with marks."""
    size = np.array([len(w) for w in words], dtype=np.int64) + 2
    flat = np.zeros((len(words), WIDTH + 2), dtype=np.uint32)
    flat[:, 1:-1] = np.array(words, dtype=f"<U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
    flat[:, 0] = 1
    flat[np.arange(len(words)), size - 1] = 2
    return flat, size


def _bucket(value: np.ndarray, salt: int) -> np.ndarray:
    value = (value ^ np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(15)
    return (value * np.uint32(0x297A2D39) >> np.uint32(16)).astype(np.int64) & (HASHED - 1)


def word_features(words: list[str], lexicon: dict[str, tuple[int, int]]) -> np.ndarray:
    """Feature numbers of each word, padded with the zero row."""
    flat, size = _shape(words)
    column = np.arange(flat.shape[1])
    out = []
    for n in (2, 3):
        value = sum((flat[:, i : flat.shape[1] - n + 1 + i] * _MIX[i] for i in range(n)), np.uint32(0))
        inside = column[: value.shape[1]][None, :] + n <= size[:, None]
        out.append(np.where(inside, _bucket(value, n), HASHED)[:, : int(size.max()) - n + 1])
    rows = np.arange(len(words))
    for n in (4, 5):  # affixes with their boundary mark
        fits = size > n
        head = sum((flat[:, i] * _MIX[i % 3] * np.uint32(2 * i + 1) for i in range(n)), np.uint32(0))
        tail = sum((flat[rows, np.maximum(size - 1 - i, 0)] * _MIX[i % 3] * np.uint32(2 * i + 1) for i in range(n)), np.uint32(0))
        out.append(np.where(fits, _bucket(head, 10 + n), HASHED)[:, None])
        out.append(np.where(fits, _bucket(tail, 20 + n), HASHED)[:, None])
    known = [lexicon.get(w, (0, 0)) for w in words]
    out.append(np.array([[_lexical(a, b) for a, b in known]], dtype=np.int64).T.reshape(len(words), 1))
    whole = sum((flat[:, i] * np.uint32((2 * i + 1) * 0x01000193 & 0xFFFFFFFF) for i in range(flat.shape[1])), np.uint32(0))
    out.append(np.where(np.array([a > 0 for a, _ in known]), _bucket(whole, 30), HASHED)[:, None])
    return np.concatenate(out, axis=1)


def _lexical(strength: int, language: int) -> int:
    """Feature of the lexicon's verdict: unknown, mixed, likely or sure of a language."""
    return int(_bucket(np.array([strength * 64 + language], dtype=np.uint32), 40)[0])


class LanguageCRF:
    """Weights of a trained field and its forward-backward pass."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, lexicon: dict[str, tuple[int, int]]) -> None:
        self.languages, self.weights, self.transitions, self.lexicon = languages, weights, transitions, lexicon
        self.limit = 120_000
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)), dtype=np.float32)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("languages", "weights", "transitions", "lexicon", "limit")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words, languages); those of distinct words are kept up to a limit."""
        hold_cache(self)
        if len(self.rows) > self.limit:
            self.forget()
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            need = len(rows) + len(new)
            if need > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.table.shape[1]), np.float32)])
            for a in range(0, len(new), WORDS):
                part = new[a : a + WORDS]
                start = len(rows)
                self.table[start : start + len(part)] = self.weights[word_features(part, self.lexicon)].sum(axis=1)
                rows.update(zip(part, range(start, start + len(part))))
        return self.table[np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))]

    def marginals(self, scores: np.ndarray, starts: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
        """Posterior of each word's language; chains begin at ``starts``.

        ``moves``, if given, receives the expected number of transitions.
        """
        ends = np.r_[starts[1:], len(scores)]
        size = ends - starts
        width = int(size.max()) if len(size) else 0
        inside = np.arange(width)[None, :] < size[:, None]
        padded = np.zeros((len(starts), width, scores.shape[1]), dtype=np.float64)
        padded[inside] = np.exp(scores - scores.max(axis=1, keepdims=True))
        step = np.exp(self.transitions)
        forward = padded.copy()
        for t in range(width):
            if t:
                forward[:, t] *= forward[:, t - 1] @ step
            forward[:, t] /= np.maximum(forward[:, t].sum(axis=1, keepdims=True), 1e-300)
        back = np.ones_like(padded)
        for t in range(width - 2, -1, -1):
            message = (padded[:, t + 1] * back[:, t + 1]) @ step.T
            message /= np.maximum(message.sum(axis=1, keepdims=True), 1e-300)
            back[:, t] = np.where(inside[:, t + 1, None], message, 1.0)
        if moves is not None and width > 1:
            pair = forward[:, :-1, :, None] * step * (padded * back)[:, 1:, None, :]
            moves += (pair / np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300))[inside[:, 1:]].sum(axis=0)
        joint = forward * back
        return (joint / np.maximum(joint.sum(axis=2, keepdims=True), 1e-300))[inside]

    def label(self, texts: list[str | None], sub: int = 30_000) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """Words of the texts and their posteriors, with the number of the text.

        Whole texts, in runs of about ``sub`` words; a longer text comes in several parts, cut between chains.
        """
        sub = -(-sub // CHAIN) * CHAIN
        held: list[tuple[int, list[str]]] = []
        total = 0
        for i, text in enumerate(texts):
            found = (m[0] for m in _WORD.finditer(text.lower())) if text else iter(())
            while True:
                words = list(islice(found, sub))
                held.append((i, words))
                total += len(words)
                if total >= sub:
                    yield from self._label(held)
                    held, total = [], 0
                if len(words) < sub:
                    break
        yield from self._label(held)

    def _label(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[str], np.ndarray]]:
        flat = [w for _, words in held for w in words]
        if not flat:
            yield from ((i, words, np.zeros((0, len(self.languages)))) for i, words in held)
            return
        starts, at = [], 0
        for _, words in held:
            starts.extend(range(at, at + len(words), CHAIN))
            at += len(words)
        post = self.marginals(self.emissions(flat), np.array(starts, dtype=np.int64))
        at = 0
        for i, words in held:
            yield i, words, post[at : at + len(words)]
            at += len(words)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        mass, words_of = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        for i, words, post in self.label(texts):
            if not "".join(words).isalpha():
                post = post[np.array([any(map(str.isalpha, w)) for w in words], dtype=bool)]
            mass[i] += post.sum(axis=0)
            words_of[i] += len(post)
        for i in np.flatnonzero(words_of):
            share = mass[i] / words_of[i]
            k = int(share.argmax())
            names[i], scores[i] = self.languages[k], float(min(1.0, share[k]))
        return names, scores


def learn_lexicon(words: list[list[str]], labels: np.ndarray, size: int) -> dict[str, tuple[int, int]]:
    """The ``size`` most used words with their verdict: (1 mixed, 2 likely, 3 sure; language)."""
    uses: dict[str, Counter] = {}
    for own, k in zip(words, labels):
        for w, n in Counter(own).items():
            uses.setdefault(w, Counter())[int(k)] += n
    ranked = sorted(((sum(c.values()), w) for w, c in uses.items() if sum(c.values()) > 2), key=lambda x: (-x[0], x[1]))[:size]
    out = {}
    for total, w in ranked:
        k, n = min(uses[w].items(), key=lambda x: (-x[1], x[0]))
        out[w] = (3 if n >= SURE * total else 2 if n >= LIKELY * total else 1, k)
    return out


def train(texts: list[str], labels: list[str], epochs: int = 3, rate: float = 0.15, ridge: float = 1e-6, lexicon_size: int = 20_000, mixed: float = 0.3, seed: int = 7) -> LanguageCRF:
    """Maximum likelihood by adaptive stochastic gradient over chains of words."""
    languages = sorted(set(labels))
    code = {x: i for i, x in enumerate(languages)}
    y = np.array([code[x] for x in labels], dtype=np.int64)
    docs = [text_words(t) for t in texts]
    lexicon = learn_lexicon(docs, y, lexicon_size)
    model = LanguageCRF(languages, np.zeros((HASHED + 1, len(languages)), np.float32), np.zeros((len(languages), len(languages))), lexicon)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    chains: list[tuple[np.ndarray, np.ndarray]] = []
    for own, k in zip(docs, y):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in own], dtype=np.int64)
        chains += [(ids[a : a + CHAIN], np.full(len(ids[a : a + CHAIN]), k)) for a in range(0, len(ids), CHAIN)]
    if not chains or len(languages) < 2:
        return model
    names = list(vocabulary)
    features = [word_features(names[a : a + WORDS], lexicon) for a in range(0, len(names), WORDS)]
    wide = max(f.shape[1] for f in features)
    table = np.concatenate([np.pad(f, ((0, 0), (0, wide - f.shape[1])), constant_values=HASHED) for f in features])
    for i in np.flatnonzero(rng.random(len(chains)) < mixed):
        a, b = chains[i], chains[int(rng.integers(len(chains)))]
        p, q = int(rng.integers(1, len(a[0]) + 1)), int(rng.integers(1, len(b[0]) + 1))
        chains[i] = (np.r_[a[0][:p], b[0][:q]][:CHAIN], np.r_[a[1][:p], b[1][:q]][:CHAIN])
    energy = np.full(model.weights.shape, 1e-2, np.float32)
    energy_t = np.full(model.transitions.shape, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for s in range(0, len(order), 48):
            batch = [chains[i] for i in order[s : s + 48]]
            ids, gold = np.concatenate([c[0] for c in batch]), np.concatenate([c[1] for c in batch])
            starts = np.cumsum([0, *(len(c[0]) for c in batch[:-1])])
            used = table[ids]
            scores = model.weights[used].sum(axis=1)
            expected = np.zeros_like(model.transitions)
            post = model.marginals(scores, starts, expected)
            wrong = post.copy()
            wrong[np.arange(len(gold)), gold] -= 1
            touched, place = np.unique(used, return_inverse=True)
            place = place.reshape(used.shape)
            grad = np.stack([np.bincount(place.ravel(), np.repeat(wrong[:, k], used.shape[1]), len(touched)) for k in range(len(languages))], axis=1)
            grad = grad / len(batch) + ridge * model.weights[touched]
            energy[touched] += grad**2
            model.weights[touched] -= (rate * grad / np.sqrt(energy[touched])).astype(np.float32)
            model.weights[HASHED] = 0
            inner = np.ones(len(gold), dtype=bool)
            inner[starts] = False
            now = np.flatnonzero(inner)
            seen = np.zeros_like(model.transitions)
            np.add.at(seen, (gold[now - 1], gold[now]), 1)
            step = (expected - seen) / len(batch) + 1e-3 * model.transitions
            energy_t += step**2
            model.transitions -= rate * step / np.sqrt(energy_t)
    model.forget()
    return model


def fit(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = 1500, sample_chars: int = 100_000,
) -> LanguageCRF | None:
    """Train on up to ``sample_rows`` labelled rows outside the held-out part; None if there are none.

    Rows go by a hash of identifier and text, least first. Texts of more than ``sample_chars`` code points
    train only where the sample has room left, so that the driver holds no more than both bounds say while
    there are enough others.
    """
    rows = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    long = F.char_length(F.col(text_col)) > sample_chars
    rows = rows.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), long.alias("long"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    labelled = rows.count()
    share = 2 * sample_rows / max(1, labelled)
    while True:
        # only about twice the bound passes the threshold, so no task sends the driver more than its share
        low = rows if share >= 1 else rows.where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
        sample = low.orderBy("long", "h", "text").limit(sample_rows).select("text", "label").collect()
        if share >= 1 or len(sample) >= sample_rows:
            break
        share *= 8  # hashes of many equal rows can leave too few below
    return train([r["text"] for r in sample], [r["label"] for r in sample]) if sample else None


def identify(df: DataFrame, model: LanguageCRF | None, text_col: str = "text") -> DataFrame:
    """All columns of every row, and lang_pred and score of its whole text. Only the text goes to Python."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # a fixed feature space and a bounded lexicon

    @F.pandas_udf("lang_pred string, score double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts in batches:
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            for a in range(0, len(texts) if own else 0, BATCH_ROWS):
                names[a : a + BATCH_ROWS], scores[a : a + BATCH_ROWS] = own.predict(texts.iloc[a : a + BATCH_ROWS].tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})
        trim_memory()

    # a column of the input with such a name gives way to the prediction
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    answer = told(F.col(text_col))  # one call for both fields
    return df.select(*kept, answer["lang_pred"].alias("lang_pred"), answer["score"].alias("score"))


def label_words(df: DataFrame, model: LanguageCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, labels): the language and posterior of every word, for code-switched text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for pdf in batches:
            labels: list[list[dict]] = [[] for _ in range(len(pdf))]
            for i, words, post in own.label(pdf["text"].tolist()):
                best = post.argmax(axis=1) if len(post) else []
                labels[i] += [{"word": w, "lang": own.languages[k], "p": float(p[k])} for w, k, p in zip(words, best, post)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "labels": labels})

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.transform(map_frames, run, "doc_id long, labels array<struct<word:string,lang:string,p:double>>")
