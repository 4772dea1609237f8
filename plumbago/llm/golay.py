"""The perfect binary Golay code of length 23: decoding, and the codewords near a word or near a row of votes."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator polynomial of the code.
GENERATOR = 0xC75
LENGTH, DATA, CHECK = 23, 12, 11


def _remainder(v: int) -> int:
    for i in range(LENGTH - 1, CHECK - 1, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - CHECK)
    return v


def _error_table() -> np.ndarray:
    """The error of weight three or less for each of the 2048 syndromes (the code is perfect)."""
    table = np.zeros(1 << CHECK, dtype=np.int64)
    single = [_remainder(1 << i) for i in range(LENGTH)]
    for weight in (1, 2, 3):
        for at in combinations(range(LENGTH), weight):
            syndrome = error = 0
            for i in at:
                syndrome ^= single[i]
                error |= 1 << i
            table[syndrome] = error
    return table


_ERRORS = _error_table()
_HIGH = np.array([_remainder(x << CHECK) for x in range(1 << DATA)], dtype=np.int64)


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    syndrome = _HIGH[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
    return (words ^ _ERRORS[syndrome]) >> CHECK


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and indices of the codewords within four bits of each word.

    They are the decodings of the word and of its 23 neighbours at one bit. Two words that differ
    in at most two bits have a common neighbour (or are neighbours), so they share an index.
    """
    flips = np.r_[0, 1 << np.arange(LENGTH)].astype(np.int64)
    index = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    new = np.c_[np.ones(len(words), bool), index[:, 1:] != index[:, :-1]]
    row, col = np.nonzero(new)
    return row, index[row, col]


#: All codewords as rows of -1 and 1, systematic: the index stands in the upper twelve bits.
_SIGNS = (((np.arange(1 << DATA)[:, None] << CHECK | _HIGH[:, None]) >> np.arange(LENGTH) & 1) * 2 - 1).astype(np.float32)


def soft_codewords(votes: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``times`` codewords that agree best with rows of 23 signed votes, and how much less than the best they do.

    Soft decoding: a bit counts by its majority, so that bits that hang by a few votes hardly hold a codeword back.
    """
    score = votes.astype(np.float32) @ _SIGNS.T
    index = np.argpartition(score, -times, axis=1)[:, -times:]
    found = np.take_along_axis(score, index, axis=1)
    return index, found.max(axis=1, keepdims=True) - found
