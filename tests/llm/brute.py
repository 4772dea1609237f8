"""Brute-force versions of the contracts, in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def op2(docs):
    prints = {}
    for i, text in docs:
        w = words((text or "").translate(LOWER))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, f"{prints[i]:016x}", root(i)) for i in ids}


def op7(docs):
    held = defaultdict(set)
    key = lambda x: x.strip(SPACE).translate(LOWER)
    for i, text in docs:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    out = set()
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        out.add((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def op10(docs, width=35):
    seen = Counter()
    for _, text in docs:
        w = words(text)
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = set()
    for i, text in docs:
        w = words(text)
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.add((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def token_ids(name, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def crc(ids):
    import zlib

    import numpy as np

    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
