"""Word shingles of many texts at a time, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

K = 5
U = np.uint64
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U), np.cumprod(np.full(max(0, n - 1), base, U))])


def run_hashes(raw: list[bytes], inside: np.ndarray, separator: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of every maximal run of the bytes marked in `inside`, to which the separator doesn't belong.
    Equal runs have equal hashes wherever they stand: a prefix sum of byte times power, divided by the power of the start."""
    data = np.frombuffer(separator + separator.join(raw) + separator, np.uint8)
    edges = np.diff(inside[data].view(np.int8))
    start, stop = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * powers(_P, len(data)))])
    hashes = mix((sums[stop] - sums[start]) * powers(_P_INVERSE, len(data))[start] + (stop - start).astype(U))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return np.searchsorted(ends, start - 1, side="right"), hashes


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of every word of all texts, A-Z lower-cased."""
    return run_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts], IS_WORD, b"\0")


def weighted_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash, count) of the distinct shingles of K words, sorted; a text of fewer words, but not none, is one
    shingle. Takes at most 256 texts, whose number takes the place of the hash's top byte in the sort."""
    owner, words = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    step = powers(0xD6E8FEB86659FD93, K)
    whole = sum(words[j:len(words) - K + 1 + j] * step[j] for j in range(K)) if len(words) >= K else np.zeros(0, U)
    fits = owner[:len(whole)] == owner[K - 1:] if len(whole) else np.zeros(0, bool)
    keys = [(owner[:len(whole)][fits].astype(U) << U(56)) | (mix(whole[fits]) >> U(8))]
    for i in np.flatnonzero((n > 0) & (n < K)):
        short = words[first[i]:first[i] + n[i]]
        h = mix((short * step[:len(short)]).sum(keepdims=True) + U(len(short)))
        keys.append((U(i) << U(56)) | (h >> U(8)))
    keys = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([new, [len(keys)]]))
    keys = keys[new]
    return (keys >> U(56)).astype(np.int64), keys & U((1 << 56) - 1), counts
