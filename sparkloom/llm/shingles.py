"""Sets of word shingles as sorted 64-bit hashes, for many texts at once (numpy only, no Spark)."""

from __future__ import annotations

import numpy as np

WORDS = 5
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[IS_SPACE] = 0
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_GRAM = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_SHORT = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits each depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _places(n: int) -> np.ndarray:
    """A fixed random odd multiplier for each place in a word, as many as the longest word asks for."""
    global _PLACE
    if n > len(_PLACE):
        more = mix(np.arange(len(_PLACE), max(n, 2 * len(_PLACE)), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)) | np.uint64(1)
        _PLACE = np.concatenate([_PLACE, more])
    return _PLACE


def hash_pieces(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ascending pieces [start, end) of ``joined``; A-Z count as a-z."""
    origin = starts[0]
    place = np.arange(ends[-1] - origin, dtype=np.int32)
    place -= np.repeat((starts - origin).astype(np.int32), np.diff(np.append(starts, ends[-1])))
    longest = int((ends - starts).max())
    np.minimum(place, longest, out=place)  # white space counts as zero, wherever it stands
    values = _BYTE[joined[origin : ends[-1]]]
    values *= _places(longest + 1)[place]
    return mix(np.add.reduceat(values, starts - origin))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of each word of ``texts``, in order; A-Z count as a-z."""
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = IS_SPACE[joined]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hash_pieces(joined, starts, np.flatnonzero(~space[:-1] & space[1:]) + 1)
    begins = np.cumsum([1] + [len(t) + 1 for t in texts[:-1]])
    return h, np.searchsorted(begins, starts, "right") - 1


def by_text(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """The order by text, then value."""
    order = np.argsort(values)
    kind = np.uint16 if texts <= 1 << 16 else np.int64  # 16-bit integers are sorted by radix
    return order[np.argsort(text[order].astype(kind), kind="stable")]


class Sets:
    """Shingle sets of a batch: set ``d`` is ``values[bounds[d]:bounds[d + 1]]``, ascending.

    ``names[d]`` is a 128-bit digest of its content, by which sets are told apart; ``sid[d]``, its first half, only steers
    the search for candidates (58 bits of content, and six of how much a prefix must share).
    """

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        h, doc = word_hashes(texts)
        words = np.bincount(doc, minlength=n)
        if len(h) >= WORDS:
            m = len(h) - WORDS + 1
            g = np.zeros(m, np.uint64)
            for k in range(WORDS):
                g += h[k : k + m] * _GRAM[k]
            own = doc[:m] == doc[WORDS - 1 :]
            g, at = g[own], doc[:m][own]
        else:
            g, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = (words > 0) & (words < WORDS)
        if few.any():  # the whole sequence is one shingle
            is_few = few[doc]
            hs, ds = h[is_few], doc[is_few]
            first = np.append(True, ds[1:] != ds[:-1])
            heads = np.flatnonzero(first)
            place = np.arange(len(ds)) - np.repeat(heads, np.diff(np.append(heads, len(ds))))
            s = np.add.reduceat(hs * _GRAM[place], heads) + _SHORT[words[ds[heads]]]
            g, at = np.concatenate([g, s]), np.concatenate([at, ds[heads]])
        g = mix(g)
        order = by_text(g, at, n)
        g, at = g[order], at[order]
        if len(g):
            new = np.append(True, (g[1:] != g[:-1]) | (at[1:] != at[:-1]))
            g, at = g[new], at[new]
        self.values, self.doc = g, at
        self.sizes = np.bincount(at, minlength=n)
        self.bounds = np.append(0, np.cumsum(self.sizes))
        sums, more = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            salted = mix(g ^ np.uint64(0xA5A5A5A55A5A5A5A))
            sums[full] = np.add.reduceat(salted, self.bounds[full])
            salted ^= salted >> np.uint64(29)
            salted *= np.uint64(0x9FB21C651E98DF25)
            more[full] = np.add.reduceat(salted ^ (salted >> np.uint64(32)), self.bounds[full])
        #: So many shingles of its prefix a set must share with another to be compared (1 to 64), also in the name's last six bits.
        self.share = np.minimum(1 + self.sizes // 16, 64)
        name = mix(sums + self.sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.sid = ((name & ~np.uint64(63)) | (self.share - 1).astype(np.uint64)).view(np.int64)
        self.names = [b"".join(p) for p in zip((x.tobytes() for x in self.sid), (x.tobytes() for x in mix(more + name)))]

    def __getitem__(self, d: int) -> np.ndarray:
        return self.values[self.bounds[d] : self.bounds[d + 1]]
