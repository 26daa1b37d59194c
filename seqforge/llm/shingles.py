"""Weighted word shingles of many texts at once, in numpy.

A word is what stands between ASCII white space, lower-cased. A shingle is five words in a row (a shorter text is one
shingle); its weight is how often the text has it. Shingles are 54-bit hashes.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
BITS = 54
_B = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Of all words of all texts a hash and the text that it belongs to; the texts in a row, and where in it words begin
    and end."""
    joined = b" ".join(raw) + b" "
    b = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[1], space.view(np.int8)])))
    starts, ends = edge[::2], edge[1::2]  # the texts end with a space, so words begin and end in turn
    ends = ends[: len(starts)]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), joined, starts, ends
    sizes = ends - starts
    begin = np.cumsum(sizes) - sizes
    power = np.full(sizes.max(), _B, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    place = np.arange(sizes.sum()) - np.repeat(begin, sizes)  # of each byte in its word
    h = mix(np.add.reduceat((b[~space].astype(np.uint64) + np.uint64(1)) * power[place], begin))
    return h, np.searchsorted(np.cumsum(lengths), starts, side="right"), joined, starts, ends


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each lower-cased word of all texts, and the text that it belongs to."""
    return word_spans([t.lower().encode("utf-8", "surrogatepass") for t in texts])[:2]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, hash and weight of each distinct shingle of each text, in order of text and hash; at most 1024 texts."""
    h, of = word_hashes(texts)
    n = len(h)
    counts = np.bincount(of, minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
    whole = np.zeros(max(0, n - SIZE + 1), np.uint64)
    for k in range(SIZE):
        whole += h[k : n - SIZE + 1 + k] * _MULTIPLIERS[k] if n >= SIZE else whole
    inside = of[: n - SIZE + 1] == of[SIZE - 1 :] if n >= SIZE else np.zeros(0, bool)
    t, s = of[: len(whole)][inside], mix(whole[inside])
    short = np.flatnonzero((counts > 0) & (counts < SIZE))
    if len(short):
        first = np.cumsum(counts) - counts
        more = []
        for i in short:
            w = h[first[i] : first[i] + counts[i]]
            more.append((w * _MULTIPLIERS[: len(w)]).sum(dtype=np.uint64) + np.uint64(counts[i]))
        t, s = np.concatenate([t, short]), np.concatenate([s, mix(np.array(more, np.uint64))])
    key = np.sort((t.astype(np.uint64) << np.uint64(BITS)) | (s >> np.uint64(64 - BITS)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    weight = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(BITS)).astype(np.int64), key & np.uint64((1 << BITS) - 1), weight


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted hashes, weights): the sum over shared shingles i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    (ha, wa), (hb, wb) = a, b
    common, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[i].astype(float), wb[j].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # max(x_j / x_i, y_j / y_i) is x_j / x_i where x_j / y_j >= x_i / y_i: sort by that ratio and use running sums
    ratio = x / y
    by = np.argsort(ratio, kind="stable")
    x, y, ratio = x[by], y[by], ratio[by]
    below = np.concatenate([[0], np.cumsum(y)])
    above = x.sum() - np.concatenate([[0], np.cumsum(x)])
    k = np.searchsorted(ratio, ratio, side="left")
    total = (only_a + above[k]) / x + (only_b + below[k]) / y
    return float((1 / total).sum())


def signatures(texts: list[str], m: int) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash: m registers of each text, and its number of distinct shingles (without any, its registers are 0).

    Each shingle is a Poisson process with its weight as rate; each arrival goes to a random register, and the first
    arrival in a register wins. A shingle ends as soon as its next arrival is later than the last of the registers.
    """
    t, e, w = shingles(texts)
    d = len(texts)
    first, winner = np.full(d * m, np.inf), np.zeros(d * m, np.uint64)
    number = np.bincount(t, minlength=d) if len(t) else np.zeros(d, np.int64)
    at, rate, seed = np.zeros(len(t)), 1.0 / w, e.copy()
    while len(t):
        seed = seed + np.uint64(0x9E3779B97F4A7C15)
        r = mix(seed)
        at = at - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) * rate
        slot = t * m + (mix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        winner[slot[won]] = e[won]
        last = first.reshape(d, m).max(axis=1)
        go = at < last[t]
        t, e, at, rate, seed = t[go], e[go], at[go], rate[go], seed[go]
    return winner.reshape(d, m), number
