"""Spelling variants: near words and forms against brute force, split halves, awkward rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from firnline.llm import spelling
from tests.llm.test_corpus_operators import LONG, TEXTS, empty, table


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, least_chars, least_count):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_count}


def brute(rows, least_chars=7, least_count=2, ratio=10):
    n = brute_words(rows, least_chars, least_count)
    near = {w: [x for x in n if distance_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def made(rng, count=120):
    base = ["".join(rng.choice("abcdeéßÿ×") for _ in range(rng.randint(5, 12))) for _ in range(12)] + ["aaaaaaaa", "abababab"]
    texts = []
    for _ in range(count):
        words = []
        for _ in range(30):
            w = list(base[min(int(rng.expovariate(0.4)), len(base) - 1)])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w)) if w else 0
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "É", "a"])
            words.append("".join(w) if rng.random() < 0.9 else "".join(w).upper())
        texts.append(rng.choice([" ", ", ", "-", "\n"]).join(words))
    return texts


def found(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@pytest.mark.parametrize("hot,least", [(2048, 7), (3, 7), (1, 4)])
def test_equals_brute_force(spark, hot, least):
    texts = [*TEXTS, *made(random.Random(hot))]
    got = found(spelling.spelling_variants(table(spark, texts), least, 2, 3, hot))
    want = brute(list(enumerate(texts)), least, 2, 3)
    assert got == want and any(x[0] for x in want.values()) and max(x[3] for x in want.values()) > 2


def test_forms_lead_on_to_roots(spark):
    counts = {"abcdefgh": 1500, "abcdefgx": 120, "abcdefyx": 11, "abcdezyx": 2}
    rows = [(i, (w + " ") * n) for i, (w, n) in enumerate(counts.items())]
    got, want = found(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), ratio=10)), brute(rows)
    assert got == want


def test_small_automata_and_hot_halves_lose_no_pair(spark):
    rng = random.Random(9)
    words = {"common" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(700)} | {"".join(rng.choice("abc") for _ in range(4)) + "common" for _ in range(60)}
    want = {(a, b) for a in words for b in words if distance_one(a, b)}
    frame = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    for hot, automaton in ((20, 5), (2048, 1 << 14)):
        got = [(r.word, r.near) for r in spelling.near_pairs(frame, hot, automaton).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_words_of_which_nothing_is_left_to_split(spark, monkeypatch):
    """Short and long words share all of a state; splitting goes on within tasks and over them."""
    words = sorted({p + "abcdefgh"[:k] + s for p in ("abcde", "abcd", "abcdef") for k in range(4) for s in ("", "x", "xy", "q", "zz", "xyz", "xyzw", "abc")} | {"abcdefg" + c for c in "abcdefghijkl"})
    want = {(a, b) for a in words for b in words if distance_one(a, b)}
    frame = spark.createDataFrame([(w, 2) for w in words if len(w) > 1], "word string, n long")
    for hot, few in ((1, 1), (5, 1), (2048, 1), (12, 3)):
        monkeypatch.setattr(spelling, "FEW", few)
        got = [(r.word, r.near) for r in spelling.near_pairs(frame, hot, 50).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_every_split_ends():
    rng = random.Random(4)
    for _ in range(40):
        words = list({"".join(rng.choice("ab") for _ in range(rng.randint(2, 9))) for _ in range(30)})
        rows = [(hash(x[3:5] + (w[: x[3]], w[len(w) - x[4] :])), *x) for w in words for own in (True, False) for x in spelling._dealt(w, 1, own, 0, 0)]
        got = [(w, other) for w, other, _ in spelling.Shard(rows).near()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if distance_one(a, b)}


def test_one_edit():
    rng = random.Random(2)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert spelling.one_edit(a, b) == distance_one(a, b)


def test_awkward_rows(spark):
    long = "verylongword" * 3000
    rows = [(None, "unusual unusual unusuol"), (None, "unusual unusual unusuol"), (3, None), (3, ""), (4, f"{long} {long} {long}x {long}x"), (5, "ÀÉÎõü÷× ÀÉÎõü÷× àÉÎõü÷×"), (6, LONG)]
    got = found(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert spelling.spelling_variants(empty(spark)).count() == 0
