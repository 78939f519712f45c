"""Repeated byte strings of a threshold length, by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the threshold depth, most significant digit first, and a group that a pass leaves
with one member is not looked at again. So that not every byte's suffix has to be moved, suffixes go through the first
passes together: the first digit of a window of `depth` bytes is its anchor, the gram of GRAM bytes in it with the
least hash (the leftmost of these), which the window's own bytes decide. Neighbouring windows with one anchor are a
run. Pass 1 orders runs by the anchor's gram; pass 2 by all bytes that the run's windows span. Runs alone with their
gram are unique, equal runs are equal window by window. Only runs that share a gram but not all bytes go on: pass 3
orders them by the bytes that STEP neighbouring windows have in common, and pass 4 orders the single windows of what
is then not alone by all `depth` bytes. Equal groups are exactly the repeated windows; all but the first by
(doc_id, start) are removed.

Digits are compared as 64-bit polynomial hashes, two of them together at the depth that decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.common import materialise, small_batches, text_of
from firnline.llm.minhash import mixed, slices
from firnline.llm.text_features import string_bytes

DEPTH = 100
GRAM = 37
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_RANDOM = np.random.default_rng(11)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1 << 40, 1 << 62)) * 2 + 1
_GROUPED = "h long, c long, doc_id long, packed long"
#: packed: first window << 17 | offset of the anchor in it << 9 | (windows - 1) << 1 | whether it is known to be repeated.
FIRST_BITS, _OFFSET_BITS, _FLAG_BITS = 17, 9, 1
#: Windows that pass 3 orders together.
STEP = 16


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out, have = np.ones(size, np.uint64), 1
    while have < size:
        more = min(have, size - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class SpanHashes:
    """Hashes of any spans of a byte array: sums of byte values times powers of an odd number, modulo 2^64."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, len(data).bit_length())
        self.up = _powers(_BASE, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers(pow(_BASE, -1, 1 << 64), size)[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start])


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, where the least of values[i : i + width] stands, the leftmost of equals; len(values) - width + 1 of them."""
    best, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right, right_place = best[step:], place[step:]
        take = right < best[:-step]
        best, place = np.where(take, right, best[:-step]), np.where(take, right_place, place[:-step])
        have += step
    return place


def runs(column: pa.Array, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each run in the texts: text number, first window, anchor's offset in it, windows, hash of the gram, hash of all bytes."""
    data, offsets = string_bytes(column)
    if len(data) < depth:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    spans = SpanHashes(data)
    grams = spans(np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
    anchors = least_positions(grams, depth - gram + 1)  # of the windows that begin at 0, 1, ...
    ends = np.repeat(offsets[1:], np.diff(offsets))
    window = np.flatnonzero(np.arange(len(anchors)) + depth <= ends[: len(anchors)])
    anchor = anchors[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    start, anchor = window[first], anchor[first]
    text = np.searchsorted(offsets, start, "right") - 1
    content = spans(start, start + count - 1 + depth) + mixed(((anchor - start) * 1024 + count).astype(np.uint64))
    return text, start - offsets[text], anchor - start, count, grams[anchor], content


def combined(h: np.ndarray, c: np.ndarray, doc: np.ndarray, first: np.ndarray, offset: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Rows for the sort by (h, c). Of those equal in both, all but the first are known to be repeated at once.

    Those are marked and dealt by their own place, not by h, so that a string that very many documents share gives
    one row a batch to the task of its key.
    """
    order = np.lexsort((first, doc, c, h))
    h, c, doc, first, offset, count = (x[order] for x in (h, c, doc, first, offset, count))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    packed = first << FIRST_BITS | offset << _OFFSET_BITS | (count - 1) << _FLAG_BITS | again
    h = np.where(again, mixed(doc.astype(np.uint64) * np.uint64(31) + first.astype(np.uint64)), h)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(packed)], ["h", "c", "doc_id", "packed"])


#: Bytes of one text whose runs are found at once.
PIECE_BYTES = 1 << 22


def _bounded_runs(column: pa.Array, depth: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of the texts, a very long one's by pieces: a run that a piece's end cuts in two is judged as two."""
    data, _ = string_bytes(column)
    if len(column) > 1 or len(data) <= 2 * PIECE_BYTES:
        yield runs(column, depth, gram)
        return
    for start in range(0, len(data) - depth + 1, PIECE_BYTES):
        piece = pa.array([data[start : start + PIECE_BYTES + depth - 1].tobytes()], pa.binary())
        text, first, *rest = runs(piece, depth, gram)
        yield text, first + start, *rest


def _run_rows(depth: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, base, done, parts = batch.column("doc_id").to_numpy(), batch.column("base").to_numpy(), 0, []
            for piece in slices(batch.column("text")):
                for text, first, offset, count, h, c in _bounded_runs(piece, depth, gram):
                    parts.append((h, c, doc[done + text], base[done + text] + first, offset, count))
                done += len(piece)
            if parts:
                yield combined(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """repeated, h, doc_id, packed: runs that are repeated, and those whose gram others have with other bytes.

    Rows come sorted by h, c, doc_id, so each is judged by the one before: memory holds one row, whatever a group's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = pending = None  # the row before; the first of its group, while the group has one content
        for batch in batches:
            h, c, doc, packed = (batch.column(k).to_numpy() for k in ("h", "c", "doc_id", "packed"))
            known = (packed & 1).astype(bool)
            own = np.flatnonzero(~known)
            oh, oc = h[own], c[own]
            new_h, new_c = np.ones(len(own), bool), np.ones(len(own), bool)
            new_h[1:] = oh[1:] != oh[:-1]
            new_c[1:] = new_h[1:] | (oc[1:] != oc[:-1])
            if len(own) and last is not None:
                new_h[0] = oh[0] != last[0]
                new_c[0] = new_h[0] or oc[0] != last[1]
            first = np.flatnonzero(new_c)  # the first run of each content
            unsettled = ~new_h[first]
            if len(first):
                unsettled[:-1] |= ~new_h[first[1:]]
                if pending is not None and not new_h[first[0]]:
                    yield pa.RecordBatch.from_arrays([pa.array([False]), *(pa.array([x], pa.int64()) for x in pending)], ["repeated", "h", "doc_id", "packed"])
                at = own[first[-1]]
                pending = (h[at], doc[at], packed[at]) if not unsettled[-1] else None
            if len(own):
                last = (oh[-1], oc[-1])
            repeated = np.concatenate([np.flatnonzero(known), own[~new_c]])
            every = np.concatenate([repeated, own[first[unsettled]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every)) < len(repeated)), pa.array(h[every]), pa.array(doc[every]), pa.array(packed[every])], ["repeated", "h", "doc_id", "packed"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "h").sortWithinPartitions("h", "c", "doc_id", "packed")
    return dealt.mapInArrow(run, "repeated boolean, h long, doc_id long, packed long")


def unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, anchor's offset in it, windows."""
    return packed >> FIRST_BITS, packed >> _OFFSET_BITS & 255, (packed >> _FLAG_BITS & 255) + 1


def _core_rows(depth: int, gram: int):
    """Rows of `pending` runs for pass 3: for each STEP offsets of the anchor, the bytes that windows with these share.

    around has STEP - 1 bytes on either side of them, in which the windows differ.
    """
    free = depth - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i, (doc, before) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("base").to_pylist(), strict=True)):
                data = string_bytes(batch.column("text").slice(i, 1))[0]
                spans = SpanHashes(data)
                padded = np.concatenate([np.zeros(STEP - 1, np.uint8), data, np.zeros(STEP - 1, np.uint8)])
                h, packed = (x.values.to_numpy() for x in (batch.column("grams")[i], batch.column("pending")[i]))
                first, high, count = unpacked(packed)
                first, own = first - before, (first >= before) & (first < before + len(data))  # rows of one doc_id get all its runs
                h, first, high, count = h[own], first[own], high[own], count[own]
                anchor, low = first + high, high - count + 1
                for base in range(0, free + 1, STEP):
                    has = np.flatnonzero((low < base + STEP) & (high >= base))
                    most, least = np.minimum(high[has], base + STEP - 1), np.maximum(low[has], base)
                    begin, end = anchor[has] - base, anchor[has] + gram + free - base - STEP + 1
                    around = padded[np.concatenate([begin[:, None] + np.arange(STEP - 1), end[:, None] + np.arange(STEP - 1) + STEP - 1], 1)]
                    grams = h[has].view(np.uint64)
                    parts.append((mixed(spans(begin, end) ^ mixed(grams + np.uint64(base))), grams, np.full(len(has), doc), (before + anchor[has] - most) << FIRST_BITS | (most - base) << _OFFSET_BITS | (most - least) << _FLAG_BITS, around))
            if parts:
                h, c, doc, packed, around = (np.concatenate(x) for x in zip(*parts, strict=True))
                binary = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.arange(0, around.size + 1, 2 * STEP - 2, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(around))])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(packed), binary], ["h", "c", "doc_id", "packed", "around"])

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of single windows for pass 4, of those rows sorted by h and c that have an equal neighbour in both."""
    held = None  # the last row of the batch before, and whether it has gone out
    for batch in batches:
        if not len(batch):
            continue
        h, c, doc, packed = (batch.column(k).to_numpy() for k in ("h", "c", "doc_id", "packed"))
        around = string_bytes(batch.column("around"))[0].reshape(len(h), -1)
        same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        alive = np.zeros(len(h), bool)
        alive[1:] |= same
        alive[:-1] |= same
        if held is not None and (held[0][0], held[1][0]) == (h[0], c[0]):
            alive[0] = True
            if not held[5]:
                h, c, doc, packed, around = (np.concatenate(x) for x in zip(held[:5], (h, c, doc, packed, around), strict=True))
                alive = np.append(True, alive)
        held = (h[-1:], c[-1:], doc[-1:], packed[-1:], around[-1:], bool(alive[-1]))
        h, c, doc, packed, around = (x[alive] for x in (h, c, doc, packed, around))
        first, offset, count = unpacked(packed)
        row = np.repeat(np.arange(len(h)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place = STEP - 1 - (offset[row] - step)  # where the window's own bytes begin in around
        sums = np.zeros((len(h), 2 * STEP - 1), np.uint64)
        powers = _powers(_BASE, 1 << 16)
        np.cumsum(_BYTES[around] * _powers(pow(_BASE, -1, 1 << 64), 1 << 16)[: 2 * STEP - 2], axis=1, out=sums[:, 1:])
        own = mixed((sums[row, place + STEP - 1] - sums[row, place]) * powers[place])
        key = mixed(own ^ mixed(h[row].view(np.uint64) + place.astype(np.uint64)))
        yield _windows_or_runs(key, h, doc, first, row, step)


def _windows_or_runs(key: np.ndarray, h: np.ndarray, doc: np.ndarray, first: np.ndarray, row: np.ndarray, step: np.ndarray) -> pa.RecordBatch:
    """Windows `step` of rows as rows for the sort by key: the first of equal ones alone, the others, known to be repeated, as runs."""
    order = np.lexsort((first[row] + step, doc[row], key, h[row]))
    again = np.zeros(len(row), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (h[row[order[1:]]] == h[row[order[:-1]]])
    begins = again.copy()
    begins[1:] &= ~again[:-1] | (row[1:] != row[:-1])
    at, alone = np.flatnonzero(begins), np.flatnonzero(~again)
    ends = again.copy()
    ends[:-1] &= ~again[1:] | (row[1:] != row[:-1])
    count = np.flatnonzero(ends) - at + 1
    start = first[row] + step
    own = mixed(doc[row[at]].astype(np.uint64) * np.uint64(31) + start[at].astype(np.uint64)).view(np.int64)
    columns = (
        np.concatenate([key[alone].view(np.int64), own]), np.concatenate([h[row[alone]], own]), np.concatenate([doc[row[alone]], doc[row[at]]]),
        np.concatenate([start[alone] << FIRST_BITS, start[at] << FIRST_BITS | (count - 1) << _FLAG_BITS | 1]),
    )
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "c", "doc_id", "packed"])


def _texts(docs: DataFrame) -> DataFrame:
    """own_id, own_text, base, copies of rows with a doc_id: under new names, so that Spark sees that both joins below deal the same rows out and does it once.

    base is where the row's text begins in its document: 0, but for rows of one doc_id with different texts, which are
    parts of one document in the order of their texts; repeated rows are one part.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("own_id"), text_of().alias("own_text"))
    again = materialise(rows.groupBy("own_id").count().where("count > 1").select("own_id"), "suffix-repeated")
    if again.isEmpty():
        return rows.withColumns({"base": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    parts = rows.join(again, "own_id", "left_semi").groupBy("own_id", "own_text").agg(F.count(F.lit(1)).alias("copies"))
    before = Window.partitionBy("own_id").orderBy("own_text").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum(F.octet_length("own_text")).over(before), F.lit(0)).cast("long"))
    others = rows.join(again, "own_id", "left_anti").withColumns({"base": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    return others.unionByName(materialise(parts, "suffix-parts"))


def repeated_spans(texts: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """own_id, packed of the texts (own_id, own_text, base): the runs of repeated windows, from the document's start.

    Windows first .. first + count - 1 begin strings seen before.
    """
    if not 0 < gram <= depth <= 255 or (depth - gram + 1) % STEP:
        raise ValueError(f"depth - gram + 1 must be a multiple of {STEP}, and depth at most 255")
    settled = materialise(_sorted_groups(texts.select("own_id", "own_text", "base").toDF("doc_id", "text", "base").mapInArrow(_run_rows(depth, gram), _GROUPED)), "suffix-groups")
    pending = settled.where("not repeated").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("h").alias("grams"), F.collect_list("packed").alias("pending"))
    cores = texts.join(pending, F.col("own_id") == F.col("_id")).select(F.col("own_id").alias("doc_id"), F.col("own_text").alias("text"), "base", "grams", "pending").mapInArrow(_core_rows(depth, gram), _GROUPED + ", around binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = cores.repartition(parts, "h").sortWithinPartitions("h", "c").mapInArrow(_window_rows, _GROUPED)
    found = settled.where("repeated").select("doc_id", "packed").unionByName(_sorted_groups(windows).where("repeated").select("doc_id", "packed"))
    return found.withColumnRenamed("doc_id", "own_id")


def _kept_parts(text: bytes, packed: np.ndarray, depth: int, base: int = 0) -> tuple[list[tuple[int, int]], int]:
    """The spans of text that stay, and the number of maximal removed spans. base: where the text begins in its document."""
    start, _, count = unpacked(packed)
    own = (start >= base) & (start < base + len(text))
    start, count = start[own] - base, count[own]
    if not len(start):
        return [(0, len(text))], 0
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + count - 1 + depth)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    begins, ends = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    return list(zip([0, *ends.tolist()], [*begins.tolist(), len(text)], strict=True)), len(begins)


def deduplicated(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text: also kept, the remaining bytes.

    Each byte covered by a string of `depth` bytes that also starts earlier (smaller doc_id, or same document, earlier
    start) is removed; overlaps count, and the input decides, not what is left. Null texts are empty; texts shorter
    than depth are kept whole. Rows of one doc_id are parts of one document, in the order of their texts; matches don't
    cross parts, and repeated rows are one part, so they keep the same bytes. Rows without doc_id are kept whole and
    compared with nothing. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = _texts(docs)
    spans = repeated_spans(texts, depth, gram).groupBy(F.col("own_id").alias("_id")).agg(F.collect_list("packed").alias("packed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            data = data.tobytes()
            rows: list[list] = [[] for _ in range(5)]
            for i, (packed, base) in enumerate(zip(batch.column("packed"), batch.column("base").to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                removed = 0
                if packed.is_valid:
                    parts, removed = _kept_parts(text, packed.values.to_numpy(), depth, base)
                    kept = b"".join(text[a:b] for a, b in parts)
                else:
                    kept = text
                row = (len(text), len(text) - len(kept), removed, hashlib.sha256(kept).hexdigest(), kept)
                for column, x in zip(rows, row, strict=True):
                    column.append(x)
            arrays = [batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            done = pa.RecordBatch.from_arrays(arrays if with_text else arrays[:5], names if with_text else names[:5])
            copies = batch.column("copies").to_numpy()
            yield done if (copies == 1).all() else done.take(pa.array(np.repeat(np.arange(len(copies)), copies)))

    schema = SCHEMA + (", kept binary" if with_text else "")
    rows = texts.join(spans, F.col("own_id") == F.col("_id"), "left").select(F.col("own_id").alias("doc_id"), F.col("own_text").alias("text"), "base", "copies", "packed")
    without_id = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), text_of().alias("text"), F.lit(0).cast("long").alias("base"), F.lit(1).cast("long").alias("copies"), F.lit(None).cast("array<bigint>").alias("packed"))
    return rows.unionByName(without_id).mapInArrow(run, schema)
