"""Word shingles of whole texts as 64-bit hashes, vectorised over batches of texts.

Words are split at ASCII white space only, and A-Z are lower-cased, so bytes can be worked on directly.
A word's hash is a polynomial over random 64-bit values of its bytes, taken from prefix sums; a shingle's
hash mixes those of its words. Both are 64 bits wide and stand for the words from then on: two different
shingles of a pair of texts fall together about once in 2**63 / (pairs of shingles) cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on at a time; a longer text is a batch of its own.
BATCH_BYTES = 1 << 21

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_BYTES = _byte_values()
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BATCH_BYTES + (1 << 16)), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * BATCH_BYTES:
            _powers[base] = have
    return have[:n]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and len(texts) + 1 offsets of each text's words."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts_at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts_at[1:])
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[joined] * _power(_BASE, len(joined)), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power(_INVERSE, len(joined))[start])
    return hashes, np.searchsorted(start, starts_at)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct ``k``-word shingles, ascending; with fewer words, all of them as one; without words, none."""
    words, at = hash_words(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * _U(pow(_INVERSE, 2 * j + 1, 1 << 64))
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            own = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                own = mix(own * _U(_BASE) + words[i : i + 1])
        else:
            own = np.zeros(0, dtype=np.uint64)
        out.append(own)
    return out


def batches(texts: list[str | None], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """The texts in order as bytes (null: empty), in runs of about ``limit`` bytes."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if run and size + len(raw) > limit:
            yield run
            run, size = [], 0
        run.append(raw)
        size += len(raw)
    if run:
        yield run
