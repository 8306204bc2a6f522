"""Hashes of words and word shingles of whole batches of texts, with numpy over the texts' bytes.

Words are runs of bytes other than ASCII white space. A word's hash is a polynomial of its bytes modulo
2**64, taken from prefix sums, so no word becomes a Python object; it is then mixed with its length.
"""

from __future__ import annotations

import numpy as np

from keylake.llm.common import WORDS_PER_SHINGLE

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes worked on at once; a longer text is cut at white space.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mixed(np.arange(1, 257, dtype=U) * U(BASE))
_known_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i up to n."""
    if not _known_powers or len(_known_powers[0]) <= n:
        size = max(n, PIECE) + 1
        _known_powers[:] = [np.multiply.accumulate(np.concatenate(([U(1)], np.full(size, x, U)))) for x in (BASE, INVERSE)]
    return _known_powers[0], _known_powers[1]


def _piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in some bytes."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return start, mixed((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD1342543DE82EF95))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, one text after the other, and how many each text has."""
    counts = np.zeros(len(texts), np.int64)
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        size, last = len(texts[at]) + 1, at + 1
        while last < len(texts) and size + len(texts[last]) + 1 <= PIECE:
            size += len(texts[last]) + 1
            last += 1
        if size > PIECE and last == at + 1:
            for piece in _cut(texts[at]):
                _, h = _piece(np.frombuffer(piece, np.uint8))
                out.append(h)
                counts[at] += len(h)
        else:
            start, h = _piece(np.frombuffer(b"\n".join(texts[at:last]), np.uint8))
            ends = np.cumsum([len(x) + 1 for x in texts[at:last]])
            counts[at:last] = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
            out.append(h)
        at = last
    return (np.concatenate(out) if out else np.zeros(0, U)), counts


def _cut(text: bytes):
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's windows of `width` words (none for shorter texts), and how many each text has."""
    n = np.maximum(counts - width + 1, 0)
    rows = max(0, len(words) - width + 1)
    left = np.repeat(np.cumsum(counts), counts)[:rows] - np.arange(rows)  # words from here to the text's end
    total = np.zeros(rows, U)
    factor = 0xA0761D6478BD642F
    for k in range(width):
        total += words[k : k + rows] * U(factor)
        factor = factor * 0xE7037ED1A0B428DB & (1 << 64) - 1 | 1
    return mixed(total[left >= width] + U(width)), n


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = WORDS_PER_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """As window_hashes, but a shorter text is one shingle of all its words, and a text without words one empty shingle."""
    long_ones, n = window_hashes(words, counts, width)
    rows = np.maximum(n, 1)
    out = np.empty(int(rows.sum()), U)
    short = np.flatnonzero(n == 0)
    is_short = np.zeros(len(out), bool)
    is_short[(np.cumsum(rows) - rows)[short]] = True
    out[~is_short] = long_ones
    start = np.cumsum(counts) - counts
    out[is_short] = [_of_few(words[start[i] : start[i] + counts[i]]) for i in short] if len(short) else []
    return out, rows


def _of_few(words: np.ndarray) -> np.uint64:
    total = 0x8EBC6AF09C88C6E3
    for w in words.tolist():
        total = (total ^ w) * BASE & (1 << 64) - 1
    return mixed(np.array([total], U))[0]


def per_text(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []


def shingles(texts: list[bytes], width: int = WORDS_PER_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(*word_hashes(texts), width)


def groups(texts: list, size: int = PIECE, most: int = 512):
    """Slices of a list of texts with about `size` bytes and at most `most` texts each."""
    at = total = 0
    for i, x in enumerate(texts):
        if i > at and (total + len(x) > size or i - at >= most):
            yield slice(at, i)
            at, total = i, 0
        total += len(x)
    if at < len(texts):
        yield slice(at, len(texts))
