"""Repeated windows of words, counted by super-k-mers.

A window is K consecutive words of one text. Its minimiser is the gram of GRAM words in it with the least hash, the
leftmost of these. Consecutive windows with one minimiser are a super-k-mer: it travels as one packed string, its words
joined by spaces, to the bucket of that gram, so that equal windows meet whatever stands around them. There super-k-mers
are sorted, equal ones become one, and the windows of what is left are sorted and counted, word by word.

Two counts of 8-byte keys go before: a minimiser that only one super-k-mer has can't hold a repeated window, so nothing of
it travels; and a bucket of more than HOT different super-k-mers (a phrase in very many contexts) is dealt out by whole
windows in its place, of which again only those that occur twice travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import bit_table, materialise, may_be_wanted, small_batches, tasks_for, text_of
from firnline.llm.minhash import slices
from firnline.llm.suffix_dedup import _powers, least_positions
from firnline.llm.text_features import mixed, string_bytes, word_hashes, words

WINDOW, GRAM = 35, 8
#: Super-k-mers of one bucket beyond which it is dealt out by whole windows.
HOT = 1 << 14
#: Bytes of texts, and words of one text, that are worked on at once.
PIECE_BYTES, PIECE_WORDS = 1 << 21, 1 << 19
#: Packed strings that a task remembers having sent.
REMEMBERED = 1 << 14
#: Rows of whole buckets that are counted at once.
COUNTED_ROWS = 4096
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"

_RANDOM = np.random.default_rng(29)
_PLACES = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1 << 40, 1 << 62)) * 2 + 1
_WHOLE = np.uint64(0x9E3779B97F4A7C15)
_PACKED = "key long, packed binary, id long, tag long, first long, n int"


class Spans:
    """Hashes of any spans of a sequence of 64-bit numbers: sums of numbers times powers of an odd one, modulo 2^64."""

    def __init__(self, numbers: np.ndarray):
        size = 1 << max(16, len(numbers).bit_length())
        self._up = _powers(_BASE, size)
        self._sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(numbers * _powers(pow(_BASE, -1, 1 << 64), size)[: len(numbers)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._up[start])


class Runs:
    """The super-k-mers of some texts: text, first window (in words from the text's start), n windows, key, content hash."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, window: int, gram: int, hot: np.ndarray | None):
        self._data, self._starts, self._ends, self.window = data, starts, ends, window
        n = len(starts)
        if n < window:
            self.at, self.n, self.key, self.content = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
            self.whole = np.empty(0, bool)
            return
        hashes = word_hashes(data, starts, ends)
        grams = np.zeros(n - gram + 1, np.uint64)
        for k in range(gram):
            grams += hashes[k : n - gram + 1 + k] * _PLACES[k]
        grams = mixed(grams)
        anchors = least_positions(grams, window - gram + 1)
        valid = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
        anchor = anchors[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        at, count, key = valid[first], np.diff(np.append(first, len(valid))), grams[anchor[first]]
        self.whole = np.zeros(len(at), bool)
        spans = Spans(hashes)
        if hot is not None:
            split = may_be_wanted(hot, key.view(np.int64))
            times = np.where(split, count, 1)
            row = np.repeat(np.arange(len(at)), times)
            step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            at, count, self.whole = at[row] + step, np.where(split, 1, count)[row], split[row]
            key = np.where(self.whole, mixed(spans(at, at + window) ^ _WHOLE), key[row])
        self.at, self.n, self.key = at, count, key
        self.content = spans(at, at + count - 1 + window)

    def packed(self, chosen: np.ndarray) -> list[bytes]:
        """The words of the chosen super-k-mers, joined by single spaces."""
        last = self.at[chosen] + self.n[chosen] + self.window - 2
        gaps = np.append(0, np.cumsum(self._starts[1:] - self._ends[:-1] != 1))
        begin, end, even = self._starts[self.at[chosen]], self._ends[last], gaps[last] == gaps[self.at[chosen]]
        spaced = np.where((self._data == 32) | ((self._data >= 9) & (self._data <= 13)), np.uint8(32), self._data).tobytes()
        return [spaced[a:b] if e else b" ".join(spaced[a:b].split()) for a, b, e in zip(begin.tolist(), end.tolist(), even.tolist(), strict=True)]


def _pieces(column: pa.Array, window: int, gram: int, hot: np.ndarray | None) -> Iterator[tuple[Runs, np.ndarray, np.ndarray]]:
    """Runs of the texts, and of each of its super-k-mers the text's number and the first window there."""
    done = 0
    for piece in slices(column, PIECE_BYTES):
        data, offsets = string_bytes(piece)
        starts, ends = words(data, offsets)
        owner = np.searchsorted(offsets, starts, "right") - 1
        begins = np.searchsorted(starts, offsets[:-1])
        for a in range(0, len(starts), PIECE_WORDS):  # a piece is longer than that only if it is one long text
            b = min(a + PIECE_WORDS + window - 1, len(starts))
            low, high = starts[a], ends[b - 1]
            runs = Runs(data[low:high], starts[a:b] - low, ends[a:b] - low, owner[a:b], window, gram, hot)
            text = owner[a + runs.at]
            yield runs, done + text, a + runs.at - begins[text]
        done += len(piece)


def _keys(window: int, gram: int, hot: np.ndarray | None):
    """key, contents, copies: of each bucket in a batch, how many different super-k-mers and how many in all; with `hot`, of its windows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for runs, *_ in _pieces(batch.column("text"), window, gram, hot):
                chosen = runs.whole if hot is not None else slice(None)
                parts.append((runs.key[chosen], runs.content[chosen]))
            key, content = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64),) * 2
            order = np.lexsort((content, key))
            key, content = key[order], content[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            other = new.copy()
            other[1:] |= content[1:] != content[:-1]
            first = np.flatnonzero(new)
            contents = np.add.reduceat(other, first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(contents), pa.array(np.diff(np.append(first, len(key))))], ["key", "contents", "copies"])

    return run


def _packed_rows(window: int, gram: int, shared: np.ndarray, hot: np.ndarray | None):
    """Rows of _PACKED. Of equal super-k-mers in a task two travel; the others, known to be repeated, go without their words, dealt by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for batch in batches:
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            for runs, text, first in _pieces(batch.column("text"), window, gram, hot):
                chosen = np.flatnonzero(may_be_wanted(shared, runs.key.view(np.int64)))
                packed: list[bytes | None] = runs.packed(chosen)
                if len(sent) > REMEMBERED:
                    sent = {}
                known = np.zeros(len(packed), bool)
                for i, x in enumerate(packed):
                    times = sent.get(x, 0)
                    if times < 2:
                        sent[x] = times + 1
                    else:
                        known[i], packed[i] = True, None
                text, first = text[chosen], first[chosen]
                own = mixed(tags[text].view(np.uint64) + first.astype(np.uint64) * _WHOLE)
                key = np.where(known, own, runs.key[chosen])
                columns = [pa.array(x) for x in (key.view(np.int64), ids[text], tags[text], first, runs.n[chosen].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array(packed, pa.binary()), *columns[1:]], ["key", "packed", "id", "tag", "first", "n"])

    return run


def _ones(n: np.ndarray) -> np.ndarray:
    return (np.int64(1) << n.astype(np.int64)) - 1


def _found(table: pa.Table, chosen: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(table.column(k).to_numpy()[chosen]) for k in ("id", "tag", "first")), pa.array(mask)], ["id", "tag", "first", "mask"])


def _merged(table: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
    """What is repeated as a whole, and the different super-k-mers: `done` marks those of the former."""
    key, packed = table.column("key").to_numpy(), table.column("packed").combine_chunks()
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & pc.fill_null(pc.equal(packed[1:], packed[:-1]), False).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(~same)
    done = table.column("done").to_numpy()
    known = packed.is_null().to_numpy(zero_copy_only=False)
    several = np.logical_or.reduceat(done, first) | (np.diff(np.append(first, len(key))) > 1) | known[first]
    out = np.flatnonzero(np.repeat(several, np.diff(np.append(first, len(key)))) & ~done)
    left = table.set_column(table.column_names.index("done"), "done", pa.array(np.repeat(several, np.diff(np.append(first, len(key))))))
    return _found(table, out, _ones(table.column("n").to_numpy()[out])), left.take(pa.array(first[~known[first]]))


def equal_windows(group: np.ndarray, ids: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Which windows ids[start : start + window] another one of their group equals, id by id."""
    hashed = Spans(mixed(ids.astype(np.uint64)))(start, start + window)
    order = np.lexsort((hashed, group))
    pair = np.flatnonzero((hashed[order][1:] == hashed[order][:-1]) & (group[order][1:] == group[order][:-1]))
    same = lambda x, y: (ids[start[x][:, None] + np.arange(window)] == ids[start[y][:, None] + np.arange(window)]).all(1)
    if not all(same(order[pair[k : k + 65536]], order[pair[k : k + 65536] + 1]).all() for k in range(0, len(pair), 65536)):
        rows = ids[start[:, None] + np.arange(window)]  # different windows of one hash: sort by all ids
        order = np.lexsort((*rows.T[::-1], group))
        pair = np.flatnonzero((rows[order][1:] == rows[order][:-1]).all(1) & (group[order][1:] == group[order][:-1]))
    out = np.zeros(len(start), bool)
    out[order[pair]] = out[order[pair + 1]] = True
    return out


def _windows(table: pa.Table, window: int) -> pa.RecordBatch | None:
    """The repeated windows of whole buckets of different super-k-mers, of those that are not repeated as a whole."""
    key = table.column("key").to_numpy()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    met = np.flatnonzero(np.repeat(size > 1, size))
    if not len(met):
        return None
    table = table.take(pa.array(met))
    split = pc.split_pattern(table.column("packed").combine_chunks(), b" ")
    ids = split.flatten().dictionary_encode().indices.to_numpy()
    n = table.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    again = equal_windows(table.column("key").to_numpy()[row], ids, offsets[row] + step, window)
    mask = np.add.reduceat(again.astype(np.int64) << step, np.cumsum(n) - n)
    out = np.flatnonzero((mask != 0) & ~table.column("done").to_numpy())
    return _found(table, out, mask[out])


def _counted(window: int):
    """id, tag, first, mask of super-k-mers with repeated windows, from rows sorted by key and packed string: bit i is window first + i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if len(batch):
                held.append(pa.Table.from_batches([batch]).append_column("done", pa.array(np.zeros(len(batch), bool))))
            if sum(map(len, held)) < COUNTED_ROWS:
                continue
            known, rows = _merged(pa.concat_tables(held))
            yield known
            key = rows.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # keys ascend; the last one's bucket may go on
            if whole and (found := _windows(rows.slice(0, whole), window)) is not None:
                yield found
            held = [rows.slice(whole).combine_chunks()]
        if held:
            known, rows = _merged(pa.concat_tables(held))
            yield known
            if (found := _windows(rows, window)) is not None:
                yield found

    return run


def repeated_windows(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """id, tag, first, mask of the texts (id, tag, text): window first + i of a text is repeated if bit i of mask is set."""
    if not 0 < gram <= window or window - gram >= 63 or gram > len(_PLACES):
        raise ValueError("a gram has at least one word and at most as many as a window, and at most 63 windows share one")
    spark, only = texts.sparkSession, texts.select("text")
    counted = lambda level: only.mapInArrow(_keys(window, gram, level), "key long, contents long, copies long").groupBy("key").agg(F.sum("contents").alias("contents"), F.sum("copies").alias("copies")).where("copies > 1")
    first = materialise(counted(None), "super-keys")
    shared, many = bit_table(first, "key"), first.where(F.col("contents") > hot)
    level = None
    if not many.isEmpty():
        level = bit_table(many, "key")
        shared = shared | bit_table(counted(level), "key")
    rows = texts.mapInArrow(_packed_rows(window, gram, shared, level), _PACKED)
    return rows.repartition(tasks_for(texts), "key").sortWithinPartitions("key", "packed").mapInArrow(_counted(window), "id long, tag long, first long, mask long")


def _covered(n: int, first: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    bits = np.flatnonzero(mask[:, None] >> np.arange(63) & 1)
    start = first[bits // 63] + bits % 63
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    return np.cumsum(edge[:-1]) > 0


def without_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; with_text: also kept, the words that stay, joined by one space.

    Words are what stands between white space. A word goes if a window of `window` words covers it whose words also stand
    anywhere else, in the same document or in another one; all occurrences go, and the input decides, not what is left.
    Null texts have no words; texts of fewer words than a window stay whole. Rows of one doc_id, repeated rows and rows
    without doc_id are texts of their own. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    text, doc_id = text_of(), F.col("doc_id").cast("long")
    # texts of one doc_id are told apart by a hash; equal ones have the same windows, so they may share what is found
    texts = docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text, doc_id.isNull()).alias("tag"), text.alias("text"), doc_id.alias("doc_id"))
    spans = repeated_windows(texts.select("id", "tag", "text"), window, gram, hot).groupBy("id", "tag").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))
    rows = texts.join(spans, ["id", "tag"], "left").select("doc_id", "text", "spans.first", "spans.mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, first, mask in zip(batch.column("text"), batch.column("first"), batch.column("mask"), strict=True):
                data, offsets = string_bytes(pa.array([text.as_py()]))
                starts, ends = words(data, offsets)
                covered = _covered(len(starts), first.values.to_numpy(), mask.values.to_numpy(), window) if first.is_valid else np.zeros(len(starts), bool)
                raw, keep = data.tobytes(), ~covered
                kept = b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                out.append((len(starts), int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            arrays = [batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 if with_text else 4], names[: 5 if with_text else 4])

    return rows.mapInArrow(run, SCHEMA + (", kept binary" if with_text else ""))
