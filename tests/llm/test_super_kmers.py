"""Repeated windows of words: the operator against brute force, hot buckets, awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from firnline.llm import super_kmers
from tests.llm.test_corpus_operators import TEXTS, empty, table


def brute(texts, window):
    """n_words, n_removed, digest and kept words of each text."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[s : s + window]) for w in split for s in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            gone[s : s + window] |= seen[tuple(w[s : s + window])] > 1
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept.encode()))
    return out


def made(rng, n=60):
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(9)]
    phrase = " ".join(rng.choice(words) for _ in range(14))
    texts = list(TEXTS)
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            text.insert(rng.randint(0, len(text)), phrase)
        texts.append(rng.choice([" ", "  ", "\n", " \t "]).join(text))
        texts.append(rng.choice(texts))
    return texts


@pytest.mark.parametrize("window,gram,hot", [(35, 8, 1 << 14), (6, 2, 1 << 14), (6, 2, 3), (5, 5, 2), (12, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, window, gram, hot):
    monkeypatch.setattr(super_kmers, "COUNTED_ROWS", 7)
    texts = made(random.Random(window * 100 + gram))
    got = {r.doc_id: tuple(r)[1:] for r in super_kmers.without_repeated_windows(table(spark, texts), window, gram, hot, with_text=True).collect()}
    want = brute(texts, window)
    assert {i: (*x[:3], bytes(x[3])) for i, x in got.items()} == dict(enumerate(want))


def test_one_phrase_in_many_contexts(spark):
    """Its buckets have thousands of different super-k-mers, and are dealt out by windows."""
    rng = random.Random(6)
    phrase = " ".join(f"p{k}" for k in range(40))
    texts = [" ".join([*(f"x{rng.randrange(10**9)}" for _ in range(30)), phrase, *(f"y{rng.randrange(10**9)}" for _ in range(30))]) for _ in range(1500)]
    got = {r.doc_id: tuple(r)[1:] for r in super_kmers.without_repeated_windows(table(spark, texts), hot=200).collect()}
    assert got == {i: x[:3] for i, x in enumerate(brute(texts, 35))}
    assert all(x[1] == 40 for x in got.values())


def test_different_windows_of_one_hash_are_told_apart(monkeypatch):
    class Alike(super_kmers.Spans):
        def __call__(self, start, end):
            return np.zeros(len(start), np.uint64)

    ids, group = np.array([1, 2, 3, 1, 2, 3, 4, 1, 2, 3]), np.array([0, 0, 0, 0, 0, 1, 1, 1])
    monkeypatch.setattr(super_kmers, "Spans", Alike)
    assert super_kmers.equal_windows(group, ids, np.arange(8), 3).tolist() == [True, False, False, True, False, False, False, False]


def test_pieces_of_one_long_text(spark, monkeypatch):
    monkeypatch.setattr(super_kmers, "PIECE_WORDS", 50)
    import pyarrow as pa

    text = " ".join(f"w{i % 977}" for i in range(400))
    parts = list(super_kmers._pieces(pa.array([text]), 35, 8, None))
    windows = sorted(w for runs, _, first in parts for a, n in zip(first.tolist(), runs.n.tolist(), strict=True) for w in range(a, a + n))
    assert windows == list(range(400 - 34))
    words = text.split()
    for runs, _, first in parts:
        for x, a, n in zip(runs.packed(np.arange(len(runs.at))), first.tolist(), runs.n.tolist(), strict=True):
            assert x.decode().split() == words[a : a + n + 34]


def test_awkward_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (None, long), (None, ""), (3, None), (3, "a b c"), (5, long + " tail"), (5, "own " * 3), (5, "own " * 3)]
    got = super_kmers.without_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 35), strict=True)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, bytes(r.kept)) for r in got), key=repr) == sorted(want, key=repr)
    assert super_kmers.without_repeated_windows(empty(spark)).count() == 0


def test_a_collision_of_windows_needs_whole_words(spark):
    a, b = " ".join(["ab", "c"] * 20), " ".join(["a", "bc"] * 20)
    got = super_kmers.without_repeated_windows(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {0: 40, 1: 40}  # each repeats within itself only
