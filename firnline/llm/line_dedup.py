"""Line dedup with a segment-partition edit join.

A line within `tau` edits of another agrees with it in at least one of tau + 1 segments, at a place that the lengths
bound. Each distinct line gives keys for its own segments (the index) and for those substrings that could match a
segment of a line up to tau shorter (the probes); a key is length, segment number and content. Lines that meet in a
key are compared in blocks of bounded size: by counts of characters first, then by a banded bit-parallel edit
distance. Equal lines are found by the hash of the whole line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import bit_table, discard, materialise, may_be_wanted, small_batches, text_of
from firnline.llm.minhash import groups, mixed, slices
from firnline.llm.suffix_dedup import FIRST_BITS, _BASE, _powers, _sorted_groups, combined

TAU = 2
#: Where the shorter of two lines has fewer characters, one edit at most makes them near ...
LEAST_CHARS = 24
#: ... and none where it has fewer than this: within an edit so short lines may say quite different things.
SHORT_CHARS = 12
SHORT_TAU = 1
BLOCK = 512
_HISTOGRAM = 64
_ROWS = "h long, c long, doc_id long, packed long"


def segments(length: np.ndarray, tau: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Where segment i of tau + 1 begins in lines of these lengths, and its length; the last ones are longer by one."""
    short, longer = length // (tau + 1), length % (tau + 1)
    before = np.maximum(i - (tau + 1 - longer), 0)
    return i * short + before, short + (i >= tau + 1 - longer)


def edit_distance_within(a: str, b: str, most: int) -> int:
    """The edit distance of a and b, or most + 1 if it is larger: bit vectors of the 2 * most + 1 diagonals about the main one."""
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if m <= most or n <= most or most == 0:  # the band holds the whole table
        if most == 0:
            return 0 if a == b else 1
        row = list(range(n + 1))
        for i, x in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        return min(row[n], most + 1)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << (i + most)  # so that column j's band begins at bit j - 1
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down = full & ~((1 << most) - 1), 0  # where the distance rises or falls from one row to the next
    distance = most  # in the band's lowest row, at first
    for j, y in enumerate(b):
        match = places.get(y, 0) >> j & full
        same = (((match & up) + up) ^ up | match | down) & full
        right_up = (down | ~(same | up)) & full
        right_down = same & up
        if j < m - most:
            distance += not same >> width - 1 & 1
        else:
            k = m - j - 1 + most
            distance += (right_up >> k & 1) - (right_down >> k & 1)
        up, down = (right_down | ~(same >> 1 | right_up)) & full, same >> 1 & right_up
        if distance > 3 * most:  # the lowest diagonal is at most 2 * most away from where a path within most ends
            return most + 1
    return min(distance, most + 1)


#: Values of the code points that most texts are made of.
_VALUES = [mixed(np.arange(0x3000, dtype=np.uint64) + np.uint64(salt)) for salt in (1, 0x9E3779B97F4A7C15)]


def _prefix_sums(points: np.ndarray, base: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of code points' values times powers of 1 / base modulo 2^64, and powers of base."""
    size = 1 << max(16, len(points).bit_length())
    terms = values[points] if not len(points) or points.max() < len(values) else np.where(points < len(values), values[np.minimum(points, len(values) - 1)], mixed(points.astype(np.uint64) ^ values[0]))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(terms * _powers(pow(base, -1, 1 << 64), size)[: len(points)], out=sums[1:])
    return sums, _powers(base, size)


class Lines:
    """The lines of some texts as one array of code points, with hashes of any of their spans."""

    def __init__(self, texts: list[str]):
        self.joined = "\n".join(texts)
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4")
        breaks = np.flatnonzero(points == 10) if texts else np.empty(0, np.int64)
        self.start = np.append(0, breaks + 1) if texts else breaks
        self.end = np.append(breaks, len(points)) if texts else breaks
        per_text = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.text = np.repeat(np.arange(len(texts)), per_text)
        self.number = np.arange(len(self.start)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        solid = np.append(0, np.cumsum(~((points == 32) | (points >= 9) & (points <= 13))))
        self.filled = solid[self.end] > solid[self.start]
        self._points = points
        self._sums, self._up = _prefix_sums(points, _BASE, _VALUES[0])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._up[start])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each line."""
        sums, up = _prefix_sums(self._points, _BASE + 2, _VALUES[1])
        return self.hashes(), mixed((sums[self.end] - sums[self.start]) * up[self.start])

    def hashes(self) -> np.ndarray:
        return self.span(self.start, self.end)


#: The sign of `line` in a key's rows: indexed lines come before probes when sorted.
_INDEXED = -(1 << 63)


def reference(h: np.ndarray) -> np.ndarray:
    """A line's hash without its sign."""
    return (h & np.uint64((1 << 63) - 1)).view(np.int64)


def _keyed(lines: Lines, chosen: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Keys of the chosen lines, which of them have each, and whether they are probes."""
    start, length = lines.start[chosen], lines.end[chosen] - lines.start[chosen]
    for shorter in range(tau + 1):
        other = length - shorter
        for i in range(tau + 1):
            at, size = segments(other, tau, i)
            tag = mixed(((other * 64 + i) * 64 + tau).astype(np.uint64))
            for shift in range(max(-i, shorter - (tau - i)), min(i, shorter + (tau - i)) + 1):
                fits = (at + shift >= 0) & (at + shift + size <= length) & (other > tau)
                begin = (start + at + shift)[fits]
                yield mixed(lines.span(begin, begin + size[fits]) ^ tag[fits]), np.flatnonzero(fits), bool(shorter or shift)


def _occurrences():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, done, parts = batch.column("doc_id").to_numpy(), 0, []
            for piece in slices(batch.column("text")):
                lines = Lines(piece.to_pylist())
                own = np.flatnonzero(lines.filled)
                h, c = lines.whole()
                parts.append((h[own], c[own], doc[done + lines.text[own]], lines.number[own], np.zeros(len(own), np.int64), np.ones(len(own), np.int64)))
                done += len(piece)
            if parts:
                yield combined(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _segment_keys(tau: int, least_chars: int, short_chars: int):
    """Keys of long lines, and, for fewer edits, of short ones with the long ones that such a line may be near."""
    low = min(SHORT_TAU, tau)
    classes = [(tau, least_chars, None)] + [(low, short_chars, least_chars + low)] * (short_chars < least_chars and low > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column("text")):
                lines = Lines(piece.to_pylist())
                h = lines.hashes()
                length = lines.end - lines.start
                for edits, least, end in classes:
                    chosen = np.flatnonzero(lines.filled & (length >= least) & (length < (end or np.inf)))
                    chosen = chosen[np.unique(h[chosen], return_index=True)[1]]  # each line once
                    ref = reference(h[chosen])
                    for key, which, probe in _keyed(lines, chosen, edits):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ref[which] | (0 if probe else _INDEXED))], ["key", "line"])

    return run


def _live_keys(rows: DataFrame) -> DataFrame:
    """The rows of those keys that an indexed line shares with another line.

    Rows come sorted by key, indexed lines first; what a key needs to remember is its first line and at most two rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "probe", "ref"]
        last: tuple | None = None  # of the key that the batch before ended with: key, first line, whether it is live
        held: list[tuple] = []  # its rows, while it is not live
        for batch in batches:
            key, line = batch.column("key").to_numpy(), batch.column("line").to_numpy()
            probe, ref = line >= 0, line & ~np.int64(_INDEXED)
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (probe[1:] != probe[:-1]) | (ref[1:] != ref[:-1])
            if held and held[-1] == (key[0], probe[0], ref[0]):
                fresh[0] = False
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            first_ref, indexed = ref[starts].copy(), ~probe[starts]
            goes_on = last is not None and last[0] == key[0]
            if goes_on:
                first_ref[0], indexed[0] = last[1], last[3]
            live = np.logical_or.reduceat(ref != first_ref[group], starts) & indexed
            if goes_on:
                if live[0] and not last[2]:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)] if held else [pa.array([], pa.int64()), pa.array([], pa.bool_()), pa.array([], pa.int64())], names)
                    held = []
                live[0] |= last[2]
            if len(starts) > 1 or not goes_on:
                held = []
            out = fresh & live[group]
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, probe, ref)], names)
            if not live[-1] and indexed[-1]:
                tail = np.flatnonzero(fresh & (group == group[-1]))
                held = held + [(int(key[i]), bool(probe[i]), int(ref[i])) for i in tail]
            else:
                held = []
            last = (key[-1], first_ref[-1], bool(live[-1]), bool(indexed[-1]))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "line").mapInArrow(run, "key long, probe boolean, ref long")


def _line_texts(documents_wanted: np.ndarray, lines_wanted: np.ndarray):
    """ref, c, doc_id, number, line of those lines whose bits are set, in those documents whose bits are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_be_wanted(documents_wanted, batch.column("doc_id").to_numpy())))
            doc, done = batch.column("doc_id").to_numpy(), 0
            for piece in slices(batch.column("text")):
                lines = Lines(piece.to_pylist())
                h, c = lines.whole()
                ref, c = reference(h), c.view(np.int64)
                chosen = np.flatnonzero(may_be_wanted(lines_wanted, ref))
                texts = [lines.joined[a:b] for a, b in zip(lines.start[chosen].tolist(), lines.end[chosen].tolist(), strict=True)]
                columns = [pa.array(ref[chosen]), pa.array(c[chosen]), pa.array(doc[done + lines.text[chosen]]), pa.array(lines.number[chosen]), pa.array(texts, pa.string())]
                done += len(piece)
                yield pa.RecordBatch.from_arrays(columns, ["ref", "c", "doc_id", "number", "line"])

    return run


def _histograms(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), _HISTOGRAM), np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % _HISTOGRAM, minlength=_HISTOGRAM)
    return out


def _later_lines(members: DataFrame, tau: int, least_chars: int, block: int = BLOCK) -> DataFrame:
    """ref, c of the lines that have a near earlier one in one of their keys: within tau edits, or fewer for short lines.

    A key of many lines is cut into blocks; each two blocks meet in a task of their own.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("ref"), "blocks").cast("int")
    dealt = members.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "probe", "ref", "c", "doc_id", "number", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "i", "j"]):
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            side, probe, ref, c, doc, number = (group.column(k).to_numpy() for k in ("own", "probe", "ref", "c", "doc_id", "number"))
            texts = group.column("line").to_pylist()
            counts, length = _histograms(texts), np.array([len(t) for t in texts])
            later: set[tuple[int, int]] = set()
            for x in np.flatnonzero(~probe.astype(bool)):
                most = np.where(np.minimum(length, length[x]) >= least_chars, tau, min(SHORT_TAU, tau))
                near = (np.abs(counts - counts[x]).sum(1) <= 2 * most) & (np.abs(length - length[x]) <= most) & ((ref != ref[x]) | (c != c[x]))
                if i != j:
                    near &= side != side[x]
                for y in np.flatnonzero(near):
                    second = y if (doc[x], number[x]) < (doc[y], number[y]) else x
                    line = int(ref[second]), int(c[second])
                    if line not in later and edit_distance_within(texts[x], texts[y], int(most[y])) <= most[y]:
                        later.add(line)
            if later:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sorted(later), strict=True)], ["ref", "c"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "probe", "ref")
    return dealt.mapInArrow(run, "ref long, c long").distinct()


def repeated_lines(docs: DataFrame, tau: int = TAU, least_chars: int = LEAST_CHARS, short_chars: int = SHORT_CHARS) -> DataFrame:
    """One row per document with lines to remove: doc_id, exact and near, the numbers (from 0) of lines, ascending.

    Lines are what stands between line feeds. A line is removed if an equal one comes earlier (smaller doc_id, or same
    document, smaller number), or a near one: within tau edits if both have at least least_chars characters, within one
    if both have at least short_chars; the input decides, not what is left, and a line that both hold for is in exact. Lines of white space only are never removed.
    """
    small_batches(docs.sparkSession)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text_of().alias("text"))
    occurrences = materialise(texts.mapInArrow(_occurrences(), _ROWS), "lines")
    exact = _sorted_groups(occurrences).where("repeated").select("doc_id", F.shiftright("packed", FIRST_BITS).alias("number"), F.lit(False).alias("near"))

    live = materialise(_live_keys(texts.mapInArrow(_segment_keys(tau, least_chars, short_chars), "key long, line long")), "line-keys")
    wanted = live.select("ref").distinct()
    once = occurrences.where("packed % 2 = 0").withColumn("ref", F.col("h").bitwiseAND((1 << 63) - 1))  # the others have an earlier one
    firsts = once.join(wanted, "ref", "left_semi").groupBy("ref", "c").agg(F.min(F.struct("doc_id", F.shiftright("packed", FIRST_BITS).alias("number"))).alias("at"))
    firsts = materialise(firsts.select("ref", "c", "at.doc_id", "at.number"), "line-firsts")
    found = texts.mapInArrow(_line_texts(bit_table(firsts, "doc_id"), bit_table(firsts, "ref")), "ref long, c long, doc_id long, number long, line string")
    lines = materialise(found.join(firsts, ["ref", "c", "doc_id", "number"], "left_semi"), "line-texts")
    members = live.join(lines, "ref").select("key", "probe", "ref", "c", "doc_id", "number", "line")
    later = materialise(_later_lines(members, tau, least_chars), "line-near")
    discard(firsts, lines, live)
    near = once.join(later, ["ref", "c"]).select("doc_id", F.shiftright("packed", FIRST_BITS).alias("number"), F.lit(True).alias("near"))
    removed = exact.unionByName(near).groupBy("doc_id", "number").agg(F.min("near").alias("near"))
    pick = lambda flag: F.array_sort(F.collect_list(F.when(F.col("near") == flag, F.col("number"))))
    return removed.groupBy("doc_id").agg(pick(False).alias("exact"), pick(True).alias("near"))


def line_report(docs: DataFrame, tau: int = TAU, least_chars: int = LEAST_CHARS, short_chars: int = SHORT_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_exact, n_near, removed (numbers of the removed lines).

    An empty or null text has no lines. doc_id is unique; a row without one loses no line.
    """
    text = text_of()
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    found = repeated_lines(docs, tau, least_chars, short_chars).select(F.col("doc_id").alias("_id"), "exact", "near")  # counted has no such column
    none = F.array().cast("array<bigint>")
    rows = counted.join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_lines", F.coalesce("exact", none).alias("exact"), F.coalesce("near", none).alias("near"))
    return rows.select("doc_id", "n_lines", F.size("exact").cast("long").alias("n_exact"), F.size("near").cast("long").alias("n_near"), F.array_sort(F.concat("exact", "near")).alias("removed"))


def without_repeated_lines(docs: DataFrame, tau: int = TAU, least_chars: int = LEAST_CHARS, short_chars: int = SHORT_CHARS) -> DataFrame:
    """The rows of docs, with their columns, whose texts have lost their repeated lines. No row goes, null texts stay null."""
    found = repeated_lines(docs, tau, least_chars, short_chars).select("doc_id", F.concat("exact", "near").alias("removed")).alias("f")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, removed in enumerate(batch.column(len(names))):
                if removed.is_valid and texts[i] is not None:
                    gone = set(removed.as_py())
                    texts[i] = "\n".join(line for k, line in enumerate(texts[i].split("\n")) if k not in gone)
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    left = docs.alias("d")
    rows = left.join(found, F.col("d.doc_id") == F.col("f.doc_id"), "left").select("d.*", F.col("f.removed").alias("lines removed by number"))
    return rows.mapInArrow(run, docs.schema)
