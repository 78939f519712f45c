"""Spelling variants: words one edit apart, by halves in Aho-Corasick automata.

One edit leaves one of a word's two halves as it was, at the word's beginning or at its end. Every word's two halves are
dealt by content to shards, and each shard builds automata of the halves that it holds; every word visits the shards of
those of its beginnings and ends that could be another word's half, and is scanned there once: a hit counts if it stands
at the half's place and the lengths differ by one at most, and the whole words are then compared. A half that more than
HOT rows have is split: words that share it must also share half of what is left, so that goes into the key, and so on.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import dealt_anew, discard, materialise, small_batches, tasks_for, text_of

LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: Rows of one key beyond which it is split over tasks, and words beyond which it is split within one.
HOT, FEW = 1 << 12, 8
#: Words of whole keys in one automaton.
AUTOMATON = 1 << 12
#: What is deleted: a code point of one occurrence in so many.
ONE_IN = 31
_ROWS = "key long, word string, n long, indexed boolean, lo int, tail int, segment string, place int, at_end boolean"


def occurrences(docs: DataFrame, one_in: int = ONE_IN) -> Column:
    """Column expression: the words of a text with doc_id, each as it counts; some lose a code point, by a checksum."""
    run = F.regexp_extract_all(F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))
    owner = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))

    def counted(word: Column) -> Column:
        h = F.crc32(F.concat(owner, word).cast("binary"))
        at = F.pmod(h, F.length(word)).cast("int")
        return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)

    return F.transform(run, counted)


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of at least so many code points that occur at least so often."""
    words = docs.select(F.explode(F.filter(occurrences(docs), lambda w: F.length(w) >= least_chars)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def halves(length: int, lo: int, tail: int) -> list[tuple[int, int]]:
    """The two states after (lo, tail), code points shared at the beginning and the end: the rest's first half shared too, or its last."""
    rest = length - lo - tail
    return [(lo + rest // 2, tail), (lo, tail + rest - rest // 2)]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _dealt(word: str, n: int, indexed: bool, lo: int, tail: int) -> Iterator[tuple]:
    """The rows that a row of this state is split into, without their keys: of the word's halves, or of those of words it may be near."""
    m = len(word)
    if indexed:
        states = halves(m, lo, tail)
    else:
        states = dict.fromkeys(s for other in (m - 1, m, m + 1) if other - lo - tail >= 2 for s in halves(other, lo, tail) if sum(s) <= m)
    for a, b in states:
        at_end = b > tail
        yield word, n, indexed, a, b, word[m - b : m - tail] if at_end else word[lo:a], tail if at_end else lo, at_end


def _split(rows: DataFrame) -> DataFrame:
    """Rows of _ROWS, each in the states that come after its own. A key tells what is shared: how much, and what."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for row in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "indexed", "lo", "tail")), strict=True) for x in _dealt(*row)]
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], _NAMES[1:])

    dealt = rows.select("word", "n", "indexed", "lo", "tail").mapInArrow(run, _ROWS.split(", ", 1)[1])
    shared = F.substring("word", F.lit(1), F.col("lo")), F.substring(F.col("word"), F.length("word") - F.col("tail") + 1, F.col("tail"))
    return dealt.select(F.xxhash64("lo", "tail", *shared).alias("key"), *_NAMES[1:])


_NAMES = [x.split(" ")[0] for x in _ROWS.split(", ")]


def _canonical(a: str, b: str, lo: int, tail: int) -> bool:
    """Whether a's rows meet b in this state first: where both halves are shared, the pair counts in that of the first half."""
    state = (0, 0)
    while state != (lo, tail):
        if len(a) - sum(state) < 2:
            return False
        left, right = halves(len(a), *state)
        state = left if left[0] + left[1] <= len(b) and a[: left[0]] == b[: left[0]] else right
        if state[0] > lo or state[1] > tail:
            return False
    return True


class Shard:
    """Whole keys: an automaton of their words' segments, and which words visit which.

    A key of more than FEW words is split in memory as `_split` does, until few words share all of a state, so that a
    hit leads to few words that have to be compared.
    """

    def __init__(self, rows: list[tuple]):
        keys: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for key, word, n, indexed, *state in rows:
            keys[key][not indexed].append((word, n, *state) if indexed else (word, *state))
        self.words: dict[str, dict[int, tuple]] = defaultdict(dict)
        self.visits: dict[str, list[int]] = defaultdict(list)
        self._groups = 0
        for indexed, probes in keys.values():
            if indexed:
                _, _, lo, tail, *place = indexed[0]
                self._settle([x[:2] for x in indexed], list(dict.fromkeys(x[0] for x in probes)), lo, tail, *place)
        self.automaton = ahocorasick.Automaton()
        for segment in self.words:
            self.automaton.add_word(segment, segment)
        if self.words:
            self.automaton.make_automaton()

    def _settle(self, indexed: list[tuple[str, int]], probes: list[str], lo: int, tail: int, segment: str, place: int, at_end: bool) -> None:
        if not probes or len(indexed) == 1 and probes == [indexed[0][0]]:
            return
        if len(indexed) <= FEW or max(len(w) for w, _ in indexed) - lo - tail < 4:
            self._register(indexed, probes, lo, tail, segment, place, at_end)
            return
        if whole := [x for x in indexed if len(x[0]) - lo - tail < 2]:  # nothing of these is left to split
            self._register(whole, probes, lo, tail, segment, place, at_end)
            indexed = [x for x in indexed if len(x[0]) - lo - tail >= 2]
        parts: dict[tuple, tuple[list, list]] = {}
        for word, n in indexed:
            for _, _, _, *state in _dealt(word, n, True, lo, tail):
                parts.setdefault(tuple(state), ([], []))[0].append((word, n))
        for word in probes:
            for _, _, _, *state in _dealt(word, 0, False, lo, tail):
                if (part := parts.get(tuple(state))) is not None:
                    part[1].append(word)
        for state, (own, visitors) in parts.items():
            self._settle(own, list(dict.fromkeys(visitors)), *state)  # a word may come to a state by two ways

    def _register(self, indexed: list[tuple[str, int]], probes: list[str], lo: int, tail: int, segment: str, place: int, at_end: bool) -> None:
        self._groups += 1
        self.words[segment][self._groups] = [(w, n, w[lo : len(w) - tail]) for w, n in indexed], lo, tail, place, at_end
        for word in probes:
            self.visits[word].append(self._groups)

    def near(self) -> Iterator[tuple[str, str, int]]:
        """Each visiting word with the words one edit away that share a state with it, and their counts."""
        for word, groups in self.visits.items():
            m = len(word)
            for end, segment in self.automaton.iter(word):
                here = self.words[segment]
                for group in groups:
                    if group not in here:
                        continue
                    indexed, lo, tail, place, at_end = here[group]
                    if (m - end - 1 if at_end else end + 1 - len(segment)) != place:
                        continue
                    rest = word[lo : m - tail]
                    size = len(rest)
                    for other, n, left in indexed:  # one edit leaves the first or the last of two code points and more
                        if -1 <= len(left) - size <= 1 and (size < 2 or len(left) < 2 or left[0] == rest[0] or left[-1] == rest[-1]) and one_edit(left, rest) and _canonical(other, word, lo, tail):
                            yield word, other, n


def _pairs(most: int):
    """word, near, near_n from rows sorted by key, by automata of at most about `most` words each."""

    def scanned(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*Shard(held).near(), strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        indexed, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                if row[0] != last and indexed >= most:
                    yield scanned(held)
                    held, indexed = [], 0
                last = row[0]
                held.append(row)
                indexed += row[3]
        if indexed:
            yield scanned(held)

    return run


def near_pairs(words: DataFrame, hot: int = HOT, automaton: int = AUTOMATON) -> DataFrame:
    """word, near, near_n of the words (word, n): each word with each word that is one edit away, both ways round, once."""
    small_batches(words.sparkSession)
    state = words.select("word", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("indexed"), F.lit(0).alias("lo"), F.lit(0).alias("tail"))
    settled, parts = [], []
    rows = materialise(_split(state), "spelling-halves")
    while True:
        parts.append(rows)
        live = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("word") - F.col("lo") - F.col("tail")).alias("rest"), F.max("indexed").alias("some"))
        live = dealt_anew(live.where("some and rows > 2").select("key", ((F.col("rows") > hot) & (F.col("rest") > 3)).alias("again")))  # two rows are one word with itself
        rows = materialise(rows.join(live, "key"), "spelling-keys")
        parts.append(rows)
        settled.append(rows.where("not again").drop("again"))
        many = rows.where("again").drop("again")
        if many.isEmpty():
            break
        whole = F.col("indexed") & (F.length("word") - F.col("lo") - F.col("tail") < 2)  # nothing of these is left to split
        kept = many.where(whole)
        settled += [kept, many.where("not indexed").join(kept.select("key").distinct(), "key", "left_semi").select(kept.columns)]
        rows = materialise(_split(many.where(~whole)), "spelling-halves")
    every = settled[0]
    for x in settled[1:]:
        every = every.unionByName(x)
    found = every.repartition(tasks_for(every), "key").sortWithinPartitions("key", "word").mapInArrow(_pairs(automaton), "word string, near string, near_n long")
    found = materialise(found, "spelling-pairs")
    discard(*parts)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows word, form: the last word that forms lead to. Each round doubles the length of what is followed."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = materialise(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = out.select("word", "root")
        now._stored_at = out._stored_at
        if out.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are runs of Latin letters, with A-Z as lower case, of at least least_chars code points, that occur at least
    least_count times. form is the near word (one edit away) that occurs most often, the first in code-point order of
    those, if it occurs at least `ratio` times as often as the word, else null; as counts grow by that, forms lead
    nowhere twice. root is where they end, the word itself without a form. Null and empty texts have no words; repeated
    rows count each; a null doc_id draws as an empty one. An empty table gives no rows; other columns are not read.
    """
    if least_chars < 2 or ratio < 2:
        raise ValueError("words need two code points at least, and forms twice the count")
    words = materialise(vocabulary(docs, least_chars, least_count), "spelling-words")
    pairs = near_pairs(words, hot)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    judged = words.join(best, "word", "left").withColumn("usual", -F.col("best.down") >= ratio * F.col("n"))
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("usual"), F.col("best.near")).alias("form"), F.when(F.col("usual"), -F.col("best.down")).alias("form_n"))
    judged = materialise(judged, "spelling-forms")
    discard(words, pairs)
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
