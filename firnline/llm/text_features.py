"""Features of whole texts, worked out for an Arrow batch at once by NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

NAMES = (
    "log_bytes", "upper_share", "digit_share", "mark_share", "shout_share", "bar_share", "symbol_share", "space_share", "non_ascii_share", "word_bytes", "word_spread",
    "repeat_share", "distinct_share", "capital_words", "marked_words", "line_bytes", "stops_per_word", "commas_per_word",
)

_KIND = np.zeros((256, 12), np.int32)
_UPPER, _DIGIT, _MARK, _SHOUT, _BAR, _SYMBOL, _SPACE, _HIGH, _STOP, _COMMA, _LINE, _LOWER = range(12)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b, _UPPER] = "A" <= _c <= "Z"
    _KIND[_b, _LOWER] = "a" <= _c <= "z"
    _KIND[_b, _DIGIT] = "0" <= _c <= "9"
    _KIND[_b, _SPACE] = _b == 32 or 9 <= _b <= 13
    _KIND[_b, _HIGH] = _b >= 128
    _KIND[_b, _MARK] = 33 <= _b < 127 and not _c.isalnum()
    _KIND[_b, _SHOUT] = _c in "!?"
    _KIND[_b, _BAR] = _c in "|\\/<>{}[]=_~^"
    _KIND[_b, _SYMBOL] = _c in "#$%&*@+"
    _KIND[_b, _STOP] = _c in ".!?:;"
    _KIND[_b, _COMMA] = _c == ","
    _KIND[_b, _LINE] = _c == "\n"
_FLAGS = [np.ascontiguousarray(_KIND[:, k].astype(np.uint8)) for k in range(12)]
#: Two random numbers for each byte value at each of PLACES places of a word.
PLACES = 64
_NUMBERS = np.random.default_rng(7).integers(0, 1 << 64, (2, PLACES << 8), dtype=np.uint64)
_PER_BYTE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on each other (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the n + 1 places where its values begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values in each [offsets[i], offsets[i + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words (runs without white space, within one text) begin and end."""
    solid = _FLAGS[_SPACE][data] == 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


#: Bytes of words that are hashed at once.
BLOCK_BYTES = 1 << 22


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; `which` is 0 or 1, for two hashes that do not depend on each other."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    block = np.cumsum(lengths) // BLOCK_BYTES
    if block[-1] and len(starts) > 1 and block[0] != block[-1]:
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(starts)]
        return np.concatenate([_hashes(data, starts[a:b], lengths[a:b], which) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return _hashes(data, starts, lengths, which)


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: int) -> np.ndarray:
    """The sum of a random number for each byte and place, mixed with the length.

    Places beyond PLACES mix the number of their stretch into the byte's, so that what two words differ in there does
    not cancel out either.
    """
    at = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = _NUMBERS[which][(at & (PLACES - 1)) << 8 | data[at + np.repeat(starts, lengths)]]
    if int(lengths.max()) > PLACES:
        far = np.flatnonzero(at >= PLACES)
        terms[far] = mixed(terms[far] ^ mixed((at[far] // PLACES).astype(np.uint64)))
    return mixed(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64) * _PER_BYTE)


def features(column: pa.Array) -> np.ndarray:
    """One row of NAMES per text. An empty text has 0 everywhere."""
    data, offsets = string_bytes(column)
    n = np.diff(offsets)
    count = {k: sums(_FLAGS[k][data], offsets) for k in range(12)}
    per = lambda x, y: x / np.maximum(y, 1)
    starts, ends = words(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(owner, minlength=len(n)) if len(owner) else np.zeros(len(n), np.int64)
    lengths = (ends - starts).astype(float)
    tally = lambda values: np.bincount(owner, values, len(n)) if len(owner) else np.zeros(len(n))
    mean = per(tally(lengths), n_words)
    spread = np.sqrt(np.maximum(per(tally(lengths * lengths), n_words) - mean * mean, 0))
    hashes = word_hashes(data, starts, ends)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    first = np.ones(len(hashes))
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], first, len(n)) if len(owner) else np.zeros(len(n))
    flag = lambda k: _FLAGS[k][data]
    if len(starts):
        upper, lower = np.add.reduceat(flag(_UPPER), starts, dtype=np.int64), np.add.reduceat(flag(_LOWER), starts, dtype=np.int64)
        capital = ((upper > 1) & (lower == 0)).astype(float)
        marked = ((_FLAGS[_MARK][data[ends - 1]] == 1) & (lengths > 1) & (_FLAGS[_MARK][data[np.maximum(ends - 2, starts)]] == 1)).astype(float)
    else:
        capital = marked = np.empty(0)
    return np.column_stack(
        [
            np.log1p(n), per(count[_UPPER], n), per(count[_DIGIT], n), per(count[_MARK], n), per(count[_SHOUT], n), per(count[_BAR], n), per(count[_SYMBOL], n), per(count[_SPACE], n), per(count[_HIGH], n), mean, spread,
            per(tally(again), n_words), per(distinct, n_words), per(tally(capital), n_words), per(tally(marked), n_words), np.log1p(per(n, count[_LINE] + 1)), per(count[_STOP], n_words), per(count[_COMMA], n_words),
        ]
    )
