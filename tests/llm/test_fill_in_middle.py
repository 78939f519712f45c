"""Fill-in-middle: ropes against plain strings, the operator against a plain version, awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from firnline.llm import fill_in_middle as fim
from tests.llm.test_corpus_operators import TEXTS, empty, table


def plain_version(doc_id, text, seed=7, fim_percent=100, spm_percent=50):
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if h[3] % 100 < spm_percent:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def heights(node):
    if node.left is None:
        return 0
    a, b = heights(node.left), heights(node.right)
    assert node.height == 1 + max(a, b) and node.points == node.left.points + node.right.points and node.units == node.left.units + node.right.units
    return node.height


def test_ropes_split_and_join_like_strings():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab\n漢🎉 \r") for _ in range(rng.randint(0, 90)))
        size = rng.randint(1, 9)
        node = fim.rope(text, size)
        assert fim.written(node) == text
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        k, p = rng.randint(0, len(units)), rng.randint(0, len(text))
        a, b = fim.split_units(node, k)
        assert (fim.written(a), fim.written(b)) == ("".join(units[:k]), "".join(units[k:]))
        c, d = fim.split_points(node, p)
        assert (fim.written(c), fim.written(d)) == (text[:p], text[p:])
        for x in (a, b, c, d, fim.joined(d, fim.joined(a, c))):
            heights(x)


def test_joins_keep_ropes_flat():
    node = fim.EMPTY
    for k in range(2000):
        node = fim.joined(node, fim.leaf(f"{k}\n")) if k % 3 else fim.joined(fim.leaf(f"{k}\n"), node)
    assert heights(node) <= 2 * (2000).bit_length()


def test_transformed_equals_a_plain_version_and_comes_back():
    rng = random.Random(8)
    for i in range(600):
        text = "".join(rng.choice(["a", "\n", "漢", "word ", "<P", ">", "<S", "\r", "🎉"]) for _ in range(rng.randint(0, 40)))
        for percents in ((100, 50), (50, 0), (30, 100)):
            got = fim.transformed(i, text, 7, *percents, size=rng.randint(1, 12))
            assert got == plain_version(i, text, 7, *percents)
            assert fim.inverted(got[1], got[4], rng.randint(1, 12)) == text


def test_operator_on_awkward_rows(spark):
    texts = [*TEXTS, "has <M> in it\nx", "\n", "\n\n\n", "no end\nof line", "x\n" * 50_000, "<", "<P>"]
    rows = fim.restored(fim.fill_in_middle(table(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:6] == plain_version(r.doc_id, texts[r.doc_id] or "") and r.restored == (texts[r.doc_id] or "")
    assert fim.fill_in_middle_digests(empty(spark)).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a\nb"), (4, "a\nb"), (4, "a\nb"), (4, "c")], "doc_id long, text string")
    got = sorted((tuple(r)[0:6] for r in fim.fill_in_middle(docs).collect()), key=repr)
    assert got == sorted(((i, *plain_version(i, t)) for i, t in [(None, "a\nb"), (4, "a\nb"), (4, "a\nb"), (4, "c")]), key=repr)


@pytest.mark.parametrize("name", ["output_sha256", "restored_sha256"])
def test_whole_table(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r[name] for r in fim.fill_in_middle_digests(docs.withColumn("output", F.lit("clash"))).collect()}
    want = (lambda i, t: t) if name == "restored_sha256" else (lambda i, t: plain_version(i, t)[4])
    assert got == {i: hashlib.sha256(want(i, t).encode()).hexdigest() for i, t in texts.items()}
