"""Document fingerprints from prefix polynomial hashes.

With P[i] = c_0 + c_1 B + ... + c_(i-1) B^(i-1) modulo a prime, any span's hash is (P[j] - P[i]) B^-i, so any two spans
can be compared, and how far two texts agree is found by binary search. A fingerprint keeps the length, the whole hash,
the hashes of prefixes and suffixes at multiples of a power of two, and the smallest hashes among all spans of SPAN code
points. Where both texts are at hand their likeness takes the longest common beginning and end from the prefix arrays,
else from the marks that the fingerprints keep.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.common import small_batches, text_of

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_111)
SPAN = 16
MARKS = 32
SKETCH = 64
#: Code points whose prefix hashes are held at once.
BLOCK = 1 << 20
#: Ranges of doc_id: rows in one, how many there can be, how many doc_ids decide where they end, bits of ranges without doc_id.
BUCKET_ROWS, MOST_RANGES, SAMPLED, NULL_BITS = 256, 1 << 14, 1 << 18, 10
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_P = np.uint64(PRIME)
_31 = np.uint64(31)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x < 2^63."""
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return np.minimum(x, x - _P)  # below PRIME the difference wraps round to a large number


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo PRIME."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = _reduced(out[:more] * np.uint64(pow(base, have, PRIME)))
        have += more
    return out


def _table(base: int, n: int) -> np.ndarray:
    size = 1 << max(12, (n - 1).bit_length())
    return _powers(base, size)[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def prefix_hashes(points: np.ndarray, base: int = BASES[0], at: int = 0) -> np.ndarray:
    """P[0..n] of points that stand at place `at` of their text, without what comes before them."""
    terms = _reduced((points.astype(np.uint64) + np.uint64(1)) * _table(base, len(points)))
    out = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(terms, out=out[1:])
    out = _reduced(out)
    return _reduced(out * np.uint64(pow(base, at, PRIME))) if at else out


class PrefixHashes:
    """Prefix arrays of one text under both bases: span equality and longest common extensions."""

    def __init__(self, text: str):
        points = code_points(text)
        self.n = len(points)
        self.prefix = [prefix_hashes(points, b) for b in BASES]

    def span(self, start: int, end: int) -> tuple[int, ...]:
        return tuple((int(p[end]) - int(p[start])) * pow(b, -start, PRIME) % PRIME for p, b in zip(self.prefix, BASES, strict=True))

    def extension(self, start: int, other: PrefixHashes, at: int) -> int:
        """How many code points agree from `start` here and `at` there."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start, start + mid) == other.span(at, at + mid):
                low = mid
            else:
                high = mid - 1
        return low


def common_start(a: np.ndarray, b: np.ndarray, least: int = 64, most: int = BLOCK) -> int:
    """How many code points two texts have in common from their start, by binary search over prefix arrays.

    The arrays are made a block at a time, each four times as long as the one before, so texts that soon differ cost little.
    """
    n, at, block = min(len(a), len(b)), 0, least
    while at < n:
        end = min(at + block, n)
        ours, theirs = ([prefix_hashes(x[at:end], base) for base in BASES] for x in (a, b))
        low, high = 0, end - at
        if any(p[high] != q[high] for p, q in zip(ours, theirs, strict=True)):
            while low < high:
                mid = (low + high + 1) // 2
                if all(p[mid] == q[mid] for p, q in zip(ours, theirs, strict=True)):
                    low = mid
                else:
                    high = mid - 1
            return at + low
        at, block = end, min(4 * block, most)
    return n


def common_ends(a: str, b: str) -> tuple[int, int]:
    """The lengths of the longest common beginning and end of two texts; together at most the shorter one's."""
    x, y = code_points(a), code_points(b)
    begin = common_start(x, y)
    rest = min(len(x), len(y)) - begin
    return begin, common_start(x[len(x) - rest :][::-1], y[len(y) - rest :][::-1])


def _folded(x: np.ndarray) -> np.ndarray:
    """Congruent to x modulo PRIME and under 2^32, for x < 2^62."""
    return (x & _P) + (x >> _31)


def _least(x: np.ndarray) -> np.ndarray:
    """The SKETCH smallest values, each once."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])][:SKETCH] if len(x) else x


def fingerprint(text: str) -> str:
    """length.hash.step:prefix hashes:suffix hashes:sketch, in hexadecimal; equal texts have equal fingerprints."""
    points = code_points(text)
    n = len(points)
    step = 1 << max(0, (n - 1) // MARKS).bit_length()
    marks = np.arange(step, n + 1, step)  # prefixes of step, 2 step, ... code points
    places = np.concatenate([marks, n - marks])  # their ends, and where suffixes of these lengths begin
    at_places = np.zeros(len(places), np.uint64)
    first, second, smallest = 0, 0, np.empty(0, np.uint32)
    back = pow(BASES[0], -1, PRIME)
    for at in range(0, n, BLOCK):
        block = points[at : at + BLOCK + SPAN - 1].astype(np.uint64) + np.uint64(1)  # spans may reach into the next block
        own, shift = min(BLOCK, n - at), np.uint64(pow(BASES[0], at, PRIME))
        sums = np.zeros(len(block) + 1, np.uint64)  # prefix sums of terms under 2^32: not reduced, so they never decrease
        np.cumsum(_folded(block * _table(BASES[0], len(block))), out=sums[1:])
        if len(block) >= SPAN:
            spans = _folded(sums[SPAN:] - sums[:-SPAN]) * _table(back, len(block) - SPAN + 1)
            spans = _folded(_folded(_folded(spans)) * np.uint64(0x5DEECE66))  # the last factor makes small ones a fair sample
            spans = _reduced(spans).astype(np.uint32)
            if len(spans) > 32 * SKETCH:  # few of many are so small, and almost always enough
                few = _least(spans[spans <= np.uint32(PRIME // (len(spans) // (4 * SKETCH)))])
                spans = few if len(few) == SKETCH else spans
            smallest = _least(np.concatenate([smallest, spans]))
        here = (places > at) & (places <= at + own)
        at_places[here] = _reduced(_reduced(sums[places[here] - at]) * shift + np.uint64(first))
        first = (first + int(sums[own]) * int(shift)) % PRIME
        second = (second + int(_folded(block[:own] * _table(BASES[1], own)).sum()) * pow(BASES[1], at, PRIME)) % PRIME
    prefixes, before = at_places[: len(marks)], at_places[len(marks) :]
    unshift = _table(back, BLOCK)[(n - marks) % BLOCK] if n else before
    if n > BLOCK:
        unshift = np.array([pow(back, int(e), PRIME) for e in n - marks], np.uint64)
    suffixes = _reduced(_folded(np.uint64(first) + (_P - before)) * unshift)
    listed = lambda xs: xs.astype(">u4").tobytes().hex()
    return f"{n:x}.{first:08x}{second:08x}.{step:x}:{listed(prefixes)}:{listed(suffixes)}:{listed(smallest)}"


def _parsed(x: str) -> tuple[int, int, str, str, str]:
    head, prefixes, suffixes, sketch = x.split(":")
    n, _, step = head.split(".")
    return int(n, 16), int(step, 16), prefixes, suffixes, sketch


def _agreed(a: str, b: str, every_a: int, every_b: int) -> int:
    """The number of common marks that agree; where one agrees all before it do."""
    low, high = 0, min(len(a) // 8 // every_a, len(b) // 8 // every_b)
    while low < high:
        mid = (low + high + 1) // 2
        i, j = 8 * (mid * every_a - 1), 8 * (mid * every_b - 1)
        if a[i : i + 8] == b[j : j + 8]:
            low = mid
        else:
            high = mid - 1
    return low


def likeness(a: str, b: str, ends: tuple[int, int] | None = None) -> float:
    """0 to 1 from two fingerprints: the larger of the share that common beginning and end cover, and of the common spans.

    ends: the lengths of common beginning and end where they are known; else those of the marks that agree.
    """
    if a == b:
        return 1.0
    n, step, prefixes, suffixes, sketch = _parsed(a)
    m, other, prefixes2, suffixes2, sketch2 = _parsed(b)
    if not n or not m:
        return 0.0
    unit = max(step, other)
    begin, end = ends or tuple(unit * _agreed(x, y, unit // step, unit // other) for x, y in ((prefixes, prefixes2), (suffixes, suffixes2)))
    covered = min(begin + end, n, m) / max(n, m)
    ours, theirs = np.frombuffer(bytes.fromhex(sketch), ">u4"), np.frombuffer(bytes.fromhex(sketch2), ">u4")
    both = np.sort(np.concatenate([ours, theirs]).astype(np.uint32))
    twice = both[1:] == both[:-1]
    union = min(SKETCH, len(both) - int(twice.sum()))
    common = float(twice[: np.searchsorted(np.cumsum(np.concatenate([[True], ~twice])), union, "right")].sum()) / union if union else 0.0
    return min(max(covered, common), 1 - 1e-9)


def _digests(held: tuple, text: str, own: str) -> tuple:
    """The row of the document in `held` (doc_id, text, fingerprint), whose next has this text and fingerprint."""
    doc_id, before, print_before = held
    half = len(before) // 2
    edited = before[: len(before) - half] + text[:half]
    print_edited = fingerprint(edited)
    near = [likeness(print_before, x, common_ends(before, t) if print_before != x else None) for x, t in ((print_edited, edited), (own, text))]
    return (doc_id, len(before), hashlib.sha256(edited.encode()).hexdigest(), print_before, print_edited, *near)


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = [f.split(" ")[0] for f in SCHEMA.split(", ")]


def range_bounds(ids: DataFrame, bucket_rows: int) -> np.ndarray:
    """Ascending doc_ids that cut ids into ranges of about bucket_rows rows, or more where there would be too many ranges.

    They come from a sample of doc_ids by a hash, of about SAMPLED rows, so the driver gets no more at any size. The
    sample only decides how even the ranges are.
    """
    n = ids.count()
    if not n:
        return np.empty(0, np.int64)
    sample = ids.where(F.pmod(F.xxhash64("doc_id", F.lit("ranges")), F.lit(max(1, n // SAMPLED))) == 0)
    found = np.unique(sample.toPandas()["doc_id"].to_numpy(np.int64))
    ranges = min(MOST_RANGES, -(-n // bucket_rows), len(found))
    return found[np.arange(1, ranges) * len(found) // ranges] if ranges > 1 else np.empty(0, np.int64)


def neighbourhoods(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text, range, guest: rows dealt by ranges of doc_id, each with the row that follows its last as guest.

    Ranges are in descending order, those of rows without doc_id, which a hash of the text deals, come last. Whole texts
    are moved once; the first rows of ranges are broadcast, at most twice MOST_RANGES short rows.
    """
    spark = docs.sparkSession
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    bounds = range_bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null"), bucket_rows)

    @F.pandas_udf("int")
    def of_id(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(np.int64), "right"), dtype="int32")

    without_id = len(bounds) + 1 + F.shiftrightunsigned("hash", 64 - NULL_BITS).cast("int")
    number = F.when(F.col("doc_id").isNull(), without_id).otherwise(of_id(F.coalesce("doc_id", F.lit(0))))
    rows = rows.withColumn("range", number)
    first = F.max(F.struct("doc_id", F.bitwise_not("hash").alias("not_hash"))).alias("first")  # the largest doc_id, the smallest hash
    ranges = rows.groupBy("range").agg(first)
    order = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(order), F.last("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = F.broadcast(ranges.select(F.col("first.doc_id").alias("first_id"), F.bitwise_not("first.not_hash").alias("first_hash"), before.alias("host")))
    visiting = rows.join(guests, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")))
    visiting = visiting.select("doc_id", "text", "hash", F.col("host").alias("range"), F.lit(True).alias("guest"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(visiting)
    dealt = both.repartition(parts, "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "hash", "text")
    return dealt.select("doc_id", "text", "range", "guest")


def fingerprints(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of its code points replaced by as many from the start of the next document, by
    descending doc_id and after the last the first. Null texts count as empty, null doc_ids come last; rows of one
    doc_id, or without one, follow each other by a hash of their texts. A single document is its own next. An empty
    table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose next has not come yet: doc_id, text, fingerprint
        last = None  # its range
        for batch in batches:
            out = []
            for doc_id, text, number, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest")), strict=True):
                if guest and (held is None or number != last):  # a guest that has been met
                    continue
                own = fingerprint(text)
                if held is not None and number == last:
                    out.append(_digests(held, text, own))
                held, last = (None if guest else (doc_id, text, own)), number
            columns = zip(*out, strict=True) if out else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return neighbourhoods(docs, bucket_rows).mapInArrow(run, SCHEMA)
