"""Fill-in-middle transformation on ropes.

A text is a rope: leaves of at most LEAF code points in a balanced tree whose nodes cache how many units end in them and
how many code points they have. Splitting at two unit ranks walks down two paths and shares all other subtrees; the
subtrees are then joined in another order, with sentinels between them. The output is inverted by splitting its own rope
at the code-point ranks where its sentinels stand. A unit is a line with its line feed, or what is left after the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from firnline.llm.common import small_batches, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
LEAF = 4096
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf with its text, or a node with two subtrees; units: how many units end in it, points: its code points."""

    units: int
    points: int
    height: int = 0
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0)


def leaf(text: str) -> Rope:
    return Rope(text.count("\n"), len(text), 0, text) if text else EMPTY


def joined(a: Rope, b: Rope) -> Rope:
    """The rope of a before b. Where one is higher by more than a level, the other goes down its near side, so that heights stay logarithmic."""
    if not a.points or not b.points:
        return a if a.points else b
    if a.height > b.height + 1:
        return _node(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return _node(joined(a, b.left), b.right)
    return _node(a, b)


def _node(a: Rope, b: Rope) -> Rope:
    """a before b, turned once where a join has made one of them two levels higher than the other."""
    if a.height > b.height + 1:
        x, y = (a.left, a.right) if a.left.height >= a.right.height else (_plain(a.left, a.right.left), a.right.right)
        return _plain(x, _plain(y, b))
    if b.height > a.height + 1:
        x, y = (b.left, b.right) if b.right.height >= b.left.height else (b.left.left, _plain(b.left.right, b.right))
        return _plain(_plain(a, x), y)
    return _plain(a, b)


def _plain(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.points + b.points, 1 + max(a.height, b.height), "", a, b)


def rope(text: str, size: int = LEAF) -> Rope:
    """A balanced rope of the text, built level by level."""
    level = [leaf(text[i : i + size]) for i in range(0, len(text), size)] or [EMPTY]
    while len(level) > 1:
        level = [_plain(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _split_leaf(node: Rope, at: int) -> tuple[Rope, Rope]:
    return leaf(node.text[:at]), leaf(node.text[at:])


def split_points(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` code points, and the rest."""
    if rank <= 0:
        return EMPTY, node
    if rank >= node.points:
        return node, EMPTY
    if node.left is None:
        return _split_leaf(node, rank)
    if rank <= node.left.points:
        a, b = split_points(node.left, rank)
        return a, joined(b, node.right)
    a, b = split_points(node.right, rank - node.left.points)
    return joined(node.left, a), b


def split_units(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest; all of it where fewer end within."""
    if rank <= 0:
        return EMPTY, node
    if rank > node.units:
        return node, EMPTY
    if node.left is None:
        at = -1
        for _ in range(rank):
            at = node.text.index("\n", at + 1)
        return _split_leaf(node, at + 1)
    if rank <= node.left.units:
        a, b = split_units(node.left, rank)
        return a, joined(b, node.right)
    a, b = split_units(node.right, rank - node.left.units)
    return joined(node.left, a), b


def written(node: Rope) -> str:
    """The text of a rope."""
    out, stack = [], [node]
    while stack:
        node = stack.pop()
        if node.left is None:
            out.append(node.text)
        else:
            stack += [node.right, node.left]
    return "".join(out)


def transformed(doc_id: int | None, text: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, size: int = LEAF) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one document."""
    whole = rope(text, size)
    n = whole.units + (text != "" and not text.endswith("\n"))
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = split_units(whole, first)
    middle, suffix = split_units(rest, second - first)
    form = "spm" if h4 % 100 < spm_percent else "psm"
    parts = {"psm": [leaf(PREFIX), prefix, leaf(SUFFIX), suffix, leaf(MIDDLE), middle], "spm": [leaf(SUFFIX), suffix, leaf(PREFIX), prefix, leaf(MIDDLE), middle]}[form]
    out = EMPTY
    for part in parts:
        out = joined(out, part)
    return n, form, prefix.points, middle.points, written(out)


def inverted(form: str, output: str, size: int = LEAF) -> str:
    """The text of which `transformed` made this output in this form."""
    if form == "plain":
        return output
    marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    parts, rest, before = {}, rope(output, size), 0
    places = [output.index(m) for m in marks]
    for mark, place, end in zip(marks, places, [*places[1:], len(output)], strict=True):
        _, rest = split_points(rest, place + len(mark) - before)
        parts[mark], rest = split_points(rest, end - place - len(mark))
        before = end
    return written(joined(joined(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars, output.

    Null and empty texts, texts that contain a sentinel, and those that the draw leaves out are plain: the output is the
    text, and both counts are null. A null doc_id draws as an empty one; repeated rows give equal rows. An empty table
    gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [transformed(i, t.as_py(), seed, fim_percent, spm_percent) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def restored(rows: DataFrame) -> DataFrame:
    """The rows of `fill_in_middle` with another column, restored: the text, rebuilt from output and form alone."""
    names = rows.columns
    at = names.index("form"), names.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [inverted(f.as_py(), o.as_py()) for f, o in zip(batch.column(at[0]), batch.column(at[1]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "restored"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("restored", StringType())]))


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    rows = restored(fill_in_middle(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))
