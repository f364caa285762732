"""Word shingles as 64-bit hashes.

Words are what stands between ASCII white space, with A-Z in lower case; a shingle is five words in a row, and a
text of one to four words is one shingle. Shingles get the same hash wherever they stand: a word's hash is the sum,
modulo 2^64, of a random number per byte times a power of an odd base for its place, moved to place 0 by a power of
the base's inverse, and mixed. All words of a block of texts are hashed at once, with array operations.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes hashed at once; longer texts go piece by piece, cut at white space.
BLOCK = 1 << 16

_rng = np.random.default_rng(20_231)
_BASE = 0x9E3779B97F4A7C15
_VALUE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE[_SPACE] = 0
_MULT = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < size:
        n = max(size, BLOCK + (1 << 16))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULT
    h = (h ^ (h >> np.uint64(29))) * _MULT
    return h ^ (h >> np.uint64(32))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash and first byte."""
    b = np.frombuffer(raw, np.uint8)
    power, inverse = _power_tables(len(b))
    total = np.cumsum(_VALUE[b] * power[: len(b)])
    edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    # the length tells apart what a leading byte of value 0 would not
    return mixed((total[end - 1] - before) * inverse[start] + (end - start).astype(np.uint64)), start


def _long_word_hashes(raw: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        out.append(_word_hashes(raw[at:end])[0])
        at = end
    return np.concatenate(out)


def _shingled(w: np.ndarray, k: int) -> np.ndarray:
    n = len(w) - k + 1
    h = w[:n].copy()
    for i in range(1, k):
        h = mixed(h * _MULT + w[i : i + n])
    return h


def _distinct(h: np.ndarray) -> np.ndarray:
    if len(h) < 2:
        return h
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingle_sets(texts: list[str], k: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending (unsigned 64-bit); none without words."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    found: list[np.ndarray] = [np.empty(0, np.uint64)] * len(raws)
    group: list[int] = []
    size = 0

    def hash_group() -> None:
        w, start = _word_hashes(b"\n".join(raws[i] for i in group))
        at = np.cumsum([0] + [len(raws[i]) + 1 for i in group])
        cuts = np.searchsorted(start, at).tolist()
        full = _shingled(w, k) if len(w) >= k else w
        for n, i in enumerate(group):
            a, z = cuts[n], cuts[n + 1]
            found[i] = full[a : z - k + 1] if z - a >= k else _shingled(w[a:z], z - a) if z > a else w[:0]

    for i, raw in enumerate(raws):
        if len(raw) > BLOCK:
            w = _long_word_hashes(raw)
            found[i] = _shingled(w, min(k, len(w))) if len(w) else w
            continue
        if group and size + len(raw) > BLOCK:
            hash_group()
            group, size = [], 0
        group.append(i)
        size += len(raw) + 1
    if group:
        hash_group()
    return [_distinct(h) for h in found]
