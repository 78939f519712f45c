"""The corpus operators against brute force on small and awkward tables."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firnline.llm import bpe_codec, exact_index, fingerprints, html_extract, line_dedup, minhash, mixing, quality_gam, suffix_dedup, text_features, token_counts
from firnline.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [
    None, "", "a", "   \n\t ", "same text here", "same text here", "Étude à ça — 漢字かな交じり 🎉🎉", "it's they'll we've  I'm\n\n\n  x'd", "<|endoftext|> and <|endoftext|>", LONG, LONG, "z" * 5000, "one two three four five", "ONE two Three four FIVE",
    "The quick brown fox jumps over the lazy dog near the river bank today\nanother line that is long enough to be near", "The quick brown fox jumps over the lazy dog near the river bank todaY\nAnother line that is long enough to be near",
]


def table(spark, texts=TEXTS):
    """Documents with null sources and extra columns whose names clash with the operators'."""
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def tiktoken_codec():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for chunk, overlap in ((1 << 16, 512), (400, 32)):
        got = by_id(token_counts.count_tokens(table(spark), P.path("byte_bpe_50k.json"), 1024, chunk, overlap))
        for i, t in enumerate(TEXTS):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    assert token_counts.count_tokens(empty(spark), P.path("byte_bpe_50k.json")).count() == 0


def test_splices_widen_where_one_pre_token_fills_the_overlap():
    tokenizer, margin = token_counts._tokenizer(P.path("byte_bpe_50k.json"))
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False)
    rng = random.Random(1)
    for _ in range(30):
        text = "".join(rng.choice(["ab ", "'ll", "x" * rng.randint(1, 300), " " * rng.randint(1, 90), "<|endoftext|>", "é漢", "\n\n "]) for _ in range(60))
        assert token_counts.spliced_count(encode, text, margin, 200, 24) == len(encode(text).ids)


def test_codec_equals_tiktoken_and_comes_back(spark):
    library = tiktoken_codec()
    got = by_id(bpe_codec.encode_documents(table(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True))
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_codec_forgets_within_a_text(monkeypatch):
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 50)
    codec = bpe_codec.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in (LONG[:4000], LONG[2000:9000]):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == tiktoken_codec().encode_ordinary(text)


def brute_spans(texts, depth):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - depth + 1):
            w = b[s : s + depth]
            hit[s : s + depth] |= w in seen
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        out[i] = (len(b), int(hit.sum()), int((np.diff(np.append(0, hit.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 7))) for _ in range(12)]
    texts = list(TEXTS)
    for _ in range(40):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))))
        base = rng.choice([t for t in texts if t and len(t) > 40])
        a, b = sorted(rng.sample(range(len(base)), 2))
        texts.append(rng.choice(["", "qq ", "r"]) + base[a:b] + rng.choice(["", "!", " zz"]))
    for depth, gram in ((100, 37), (20, 5), (32, 17)):
        got = by_id(suffix_dedup.deduplicated(table(spark, texts), depth, gram))
        assert {i: tuple(r)[1:] for i, r in got.items()} == brute_spans(texts, depth)
    assert suffix_dedup.deduplicated(empty(spark)).count() == 0


def test_long_texts_by_pieces(monkeypatch):
    texts = [LONG[:3000], LONG[100:2500] + "?" + LONG[:900]]
    for t in texts:
        column = pa.array([t])
        whole = [set(range(f, f + n)) for f, n in zip(*(x.tolist() for x in suffix_dedup.runs(column, 100, 37)[1:4:2]), strict=True)]
        monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 250)
        cut = [set(range(f, f + n)) for part in suffix_dedup._bounded_runs(column, 100, 37) for f, n in zip(part[1].tolist(), part[3].tolist(), strict=True)]
        assert set().union(*cut) == set().union(*whole) == set(range(len(t) - 99)) and sum(map(len, cut)) == len(t) - 99
        monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1 << 22)
    data, offsets = text_features.string_bytes(pa.array([LONG]))
    starts, ends = text_features.words(data, offsets)
    at_once = text_features.word_hashes(data, starts, ends)
    monkeypatch.setattr(text_features, "BLOCK_BYTES", 1000)
    assert (text_features.word_hashes(data, starts, ends) == at_once).all()


def test_suffix_dedup_keeps_rows_without_id(spark):
    rows = spark.createDataFrame([(1, "x" * 300), (None, "x" * 300)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicated(rows).collect()}
    assert got == {1: 299, None: 0}


def test_suffix_dedup_of_rows_with_one_id(spark):
    """Repeated rows keep the same bytes; other rows of one doc_id are parts of one document, in the order of their texts."""
    rng = random.Random(17)
    one, two, three = ("".join(rng.choice("abcdef ") for _ in range(n)) for n in (400, 300, 350))
    rows = [(1, one), (1, one), (2, two), (2, two + one[:250]), (2, three + two[100:]), (3, three), (3, ""), (3, None), (None, one)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, base int").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.deduplicated(docs, with_text=True).collect())

    seen, expected = {}, Counter([(None, 400, 0, 0, one.encode())])
    for i in (1, 2, 3):
        for t in sorted({(t or "").encode() for k, t in rows if k == i}):
            hit = np.zeros(len(t), bool)
            for s in range(len(t) - 99):
                hit[s : s + 100] |= t[s : s + 100] in seen
                seen[t[s : s + 100]] = True
            kept = bytes(np.frombuffer(t, np.uint8)[~hit])
            copies = sum(k == i and (x or "").encode() == t for k, x in rows)
            expected[(i, len(t), int(hit.sum()), int((np.diff(np.append(0, hit.astype(int))) == 1).sum()), kept)] += copies
    assert got == expected


def test_fingerprints(spark):
    got = by_id(fingerprints.fingerprints(table(spark)))
    n = len(TEXTS)
    for i in range(n):
        own, following = TEXTS[i] or "", TEXTS[(i - 1) % n] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.fingerprint(own) and r.edited_fingerprint == fingerprints.fingerprint(edited)
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1) == (own == following)
    assert got[4].fingerprint == got[5].fingerprint
    one = fingerprints.fingerprints(table(spark, ["only one"])).first()
    assert one.near_next == 1.0
    assert fingerprints.fingerprints(empty(spark)).count() == 0


def brute_likeness(a, b):
    """The larger of the shares of common beginning and end, and of the spans, counted one by one."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    least = min(len(a), len(b))
    begin = next((k for k in range(least) if a[k] != b[k]), least)
    end = next((k for k in range(least - begin) if a[-1 - k] != b[-1 - k]), least - begin)
    return (begin + end) / max(len(a), len(b))


def test_fingerprints_over_many_ranges(spark):
    """Ids far apart, an id that lies far out, and texts whose common ends are known."""
    texts = [f"text number {i} " * (i % 7 + 1) for i in range(60)]
    ids = [*range(30), *(10**9 + i for i in range(29)), 2**62]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    found = fingerprints.fingerprints(rows, 3).collect()
    sizes = [r["count"] for r in fingerprints.neighbourhoods(rows, 3).where("not guest").groupBy("range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 6  # even ranges, though nearly all ids lie in a billionth of their span
    got = {r.doc_id: r for r in found}
    assert len(got) == len(found) == 60
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        half, following = len(t) // 2, texts[(k - 1) % 60]
        edited = t[: len(t) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited >= brute_likeness(t, edited) - 1e-8 and got[i].near_next >= brute_likeness(t, following) - 1e-8
        assert (got[i].near_next == 1) == (t == following)


def test_fingerprints_of_rows_without_or_with_one_id(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c"), (3, "c"), (3, None)], "doc_id long, text string")
    rows = fingerprints.fingerprints(docs, 1).collect()
    assert Counter((r.doc_id, r.n_chars) for r in rows) == Counter([(None, 1), (None, 1), (3, 1), (3, 1), (3, 0)])


def test_common_ends_by_blocks():
    rng = random.Random(6)
    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            if b:
                b[rng.randrange(len(b))] = rng.choice("abc漢")
        x, y = fingerprints.code_points(a), fingerprints.code_points("".join(b))
        expected = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert fingerprints.common_start(x, y, 3, 7) == fingerprints.common_start(x, y) == expected
        begin, end = fingerprints.common_ends(a, "".join(b))
        assert begin == expected and (a == "".join(b) or begin + end == round(brute_likeness(a, "".join(b)) * max(len(a), 1)))


def test_sketches_of_long_texts_are_full():
    rng = random.Random(2)
    for n in (100, 2_100, 30_000):
        text = "".join(chr(rng.randint(97, 122)) for _ in range(n))
        spans = {text[i : i + fingerprints.SPAN] for i in range(n - fingerprints.SPAN + 1)}
        assert len(fingerprints._parsed(fingerprints.fingerprint(text))[4]) == 8 * min(fingerprints.SKETCH, len(spans))


def test_prefix_hashes_find_extensions():
    rng = random.Random(8)
    for _ in range(50):
        a = "".join(rng.choice("ab漢") for _ in range(60))
        i, j = rng.randrange(60), rng.randrange(60)
        b = a[:j] + a[i:]
        A, B = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
        expected = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        assert A.extension(i, B, j) == expected
    assert fingerprints.fingerprint(LONG * 3) == fingerprints.fingerprint(LONG + LONG + LONG)
    near = fingerprints.likeness(fingerprints.fingerprint(LONG), fingerprints.fingerprint(LONG[:70_000] + "changed" + LONG[70_010:]))
    assert near > 0.8 > 0.1 > fingerprints.likeness(fingerprints.fingerprint(LONG), fingerprints.fingerprint("quite another text " * 50))


def brute_components(texts):
    sets = []
    for t in texts:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", lowered)]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    component = list(range(len(texts)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b)]
    for _ in texts:
        for i, j in links:
            component[i] = component[j] = min(component[i], component[j])
    return {i: (len(s), component[i], component[i] == i) for i, s in enumerate(sets)}


def chain(rng, n, words=60):
    """Copies of one text, each with its own changes: many are near the base, fewer near each other."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(words)] = f"v{rng.randrange(9999)}"
        out.append(" ".join(copy))
    return out


def test_minhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(11)
    texts = list(TEXTS) + chain(rng, 40) + chain(rng, 25, 30)
    rng.shuffle(texts)
    got = {i: tuple(r)[1:] for i, r in by_id(minhash.near_duplicates(table(spark, texts))).items()}
    assert got == brute_components(texts)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    kept = minhash.without_near_duplicates(table(spark, texts))
    assert kept.columns == table(spark).columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r[2]}


def test_long_words_that_differ_are_not_the_same(spark):
    """Words of more bytes than the hash has places: what differs in one stretch must not be made up for in another."""
    base = "m" * 80
    other = chr(ord("m") + 3) + "m" * 63 + chr(ord("m") - 1) + "m" * 15
    long = [base, other, "m" * 64, "m" * 128, "m" * 63 + "n" + "m" * 64, "m" * 127 + "n", "n" + "m" * 127]
    data, offsets = text_features.string_bytes(pa.array(long))
    starts, ends = text_features.words(data, offsets)
    for which in (0, 1):
        assert len(set(text_features.word_hashes(data, starts, ends, which).tolist())) == len(long)
    texts = [f"{w} q z" for w in long] * 2
    got = {i: tuple(r)[1:] for i, r in by_id(minhash.near_duplicates(table(spark, texts))).items()}
    assert got == brute_components(texts)


def test_minhash_rows_without_or_with_one_id(spark):
    rows = [(5, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "other words than those"), (9, "x y z"), (9, "x y z"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, minhash.near_duplicates(docs).collect()))
    assert got == Counter([(5, 2, 5, True), (7, 2, 5, False), (None, 2, 5, False), (None, 1, None, True), (9, 1, 9, True), (9, 1, 9, True), (None, 0, None, True)])
    assert Counter(r.doc_id for r in minhash.without_near_duplicates(docs).collect()) == Counter([5, 9, 9, None, None, None])


def test_a_bucket_of_several_components_is_compared_within(spark):
    """Two groups that share every bucket: links between them are found wherever they are, in blocks of any size."""
    rng = random.Random(21)
    sets = {i: sorted(rng.sample(range(40), rng.randint(18, 22))) for i in range(60)}
    component = {i: 0 if i < 40 else i for i in sets}
    members = spark.createDataFrame([(b, i, component[i], 0, 40, 20) for b in (1, 2) for i in sets], "bucket long, node long, component long, base long, n_base long, n_rest long")
    stored = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes())) for i, s in sets.items()], "doc_id long, shingles binary")

    def joined(links):
        root = dict(component)
        for a, b in links:
            ra, rb = root[a], root[b]
            root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
        return root

    near = [(a, b) for a in sets for b in sets if a < b and component[a] != component[b] and 100 * len({*sets[a]} & {*sets[b]}) >= 45 * len({*sets[a]} | {*sets[b]})]
    for block in (7, 512):
        found = [(r.a, r.b) for r in minhash.bucket_links(members, stored, 45, 100, block).collect()]
        assert {tuple(sorted(x)) for x in found} <= set(near) and joined(found) == joined(near)
    low = {i: bytes(rng.choice(b"abc") if k % 3 else k for k in range(128)) for i in sets}
    signed = spark.createDataFrame([(i, bytearray(x)) for i, x in low.items()], "node long, signature binary")
    agree = lambda a, b: sum(x == y for x, y in zip(low[a], low[b], strict=True)) / 128
    alike = {(k, a) for k in (1, 2) for a in sets if any(component[a] != component[b] and agree(a, b) >= 0.62 for b in sets)}
    for block in (7, 512):
        assert {tuple(r) for r in minhash.alike_members(members, signed, 0.62, block).collect()} == alike and 0 < len(alike) < 120
    placed = members.select("bucket", "node", "component")
    pair = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (8, 3, 3), (8, 4, 3)], "bucket long, node long, component long")
    assert [r.bucket for r in minhash.open_buckets(pair).collect()] == [7] and minhash.open_buckets(pair, 3).count() == 0
    assert [tuple(r)[1:] for r in minhash.open_buckets(placed).collect()] == [(0, 40, 20)]  # one of two buckets with the same members


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def duplicates_of(rows):
    """(doc_id, keep_id, group_size, kept, sha256) of (doc_id, text) rows."""
    same = defaultdict(list)
    for i, t in rows:
        same[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in same.items()}
    return Counter((i, keep[t or ""], len(same[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("capacity", [exact_index.CAPACITY, 2])
@pytest.mark.parametrize("cold_rows", [exact_index.COLD_ROWS, 1])
def test_exact_duplicates(spark, capacity, cold_rows, monkeypatch):
    monkeypatch.setattr(exact_index.build_index, "__defaults__", (*exact_index.build_index.__defaults__[:-1], cold_rows))
    rows = [*enumerate(TEXTS), (None, "same text here"), (None, "no id"), (None, "no id"), (5, "same text here"), *((i, "hot") for i in range(100, 300))]
    docs = spark.createDataFrame([(i, t, "h", 0) for i, t in rows], "doc_id long, text string, hash64 string, bucket int").repartition(3)
    assert Counter(map(tuple, exact_index.exact_duplicates(docs, capacity=capacity).collect())) == duplicates_of(rows)
    assert exact_index.exact_duplicates(empty(spark)).count() == 0


def test_buckets_hold_what_the_directory_says(spark):
    docs = spark.createDataFrame([(i, f"text {i % 700}") for i in range(1500)], "doc_id long, text string")
    index = exact_index.build_index(docs, capacity=10, max_depth=12)
    directory = {r.place: (r.bucket, r.depth) for r in index.directory(spark).collect()}
    entries = index.entries(spark).withColumn("place", exact_index.place_of("hash64", 12)).collect()
    assert len(entries) == 700 and {r.place for r in entries} == set(directory)
    held = Counter(r.bucket for r in entries)
    for r in entries:
        bucket, depth = directory[r.place]
        assert r.bucket == bucket == r.place >> (12 - depth) << (12 - depth)  # the bucket owns the places of its leading bits
        assert held[bucket] <= 10
        if depth:  # it was split off for a reason: what it was split from held too many
            up = 13 - depth
            assert sum(e.place >> up == r.place >> up for e in entries) > 10
    assert max(d for _, d in directory.values()) > 5


def test_lookups_go_through_the_directory(spark):
    """With a directory that names wrong buckets nothing is found, though the entries are all there."""
    docs = spark.createDataFrame([(i, f"text {i % 60}") for i in range(100)], "doc_id long, text string")
    index = exact_index.build_index(docs, capacity=5, max_depth=8)
    assert index.lookup(docs).where("keep_id is null").count() == 0
    others = spark.createDataFrame([(1, "not in it"), (2, "text 7")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in index.lookup(others).collect()} == {1: (None, None), 2: (67, 2)}
    wrong = [(r.place, 1 << 20, r.depth) for r in index.directory(spark).collect()]
    spark.createDataFrame(wrong, "place int, bucket int, depth int").write.mode("overwrite").parquet(f"{index.path}/directory")
    assert index.lookup(docs).where("keep_id is not null").count() == 0


def test_collisions_chain_and_are_told_apart_by_bytes(spark, monkeypatch):
    """All texts get one hash: a single chain, whose texts are still told apart."""
    keyed = exact_index.keyed
    monkeypatch.setattr(exact_index, "keyed", lambda *args: keyed(*args).withColumn("hash64", F.lit(7).cast("long")))
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, exact_index.exact_duplicates(docs, capacity=2).collect())) == duplicates_of(rows)
    chain = sorted(r.chain for r in exact_index.build_index(docs, capacity=2).entries(spark).collect())
    assert chain == list(range(len({t or "" for t in TEXTS})))


def test_exact_duplicates_stay_in_the_engine(spark):
    plan = exact_index.exact_duplicates(table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_edit_distance_within():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        return row[-1]

    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("ab漢") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        for most in range(4):
            assert line_dedup.edit_distance_within(a, b, most) == min(full(a, b), most + 1)


def brute_lines(texts, tau, least, short=line_dedup.SHORT_CHARS):
    first = {}
    for i, t in enumerate(texts):
        for n, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\v\f\r"):
                first.setdefault(x, (i, n))
    long = sorted((x for x in first if len(x) >= min(least, short)), key=len)
    near = set()
    for k, x in enumerate(long):
        most = tau if len(x) >= least else min(1, tau)
        for y in long[k + 1 :]:
            if len(y) - len(x) > most:
                break
            if line_dedup.edit_distance_within(x, y, most) <= most:
                near.add(max(x, y, key=first.get))
    out = {}
    for i, t in enumerate(texts):
        lines = t.split("\n") if t else []
        exact = [n for n, x in enumerate(lines) if x in first and first[x] != (i, n)]
        close = [n for n, x in enumerate(lines) if x in near and first[x] == (i, n)]
        out[i] = (len(lines), len(exact), len(close), sorted(exact + close))
    return out


def edited_lines(rng):
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(20, 60))) for _ in range(12)]
    out = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "Y"])
            lines.append("".join(x))
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_line_dedup_equals_brute_force(spark, monkeypatch, tau):
    monkeypatch.setattr(line_dedup, "BLOCK", 5)
    texts = list(TEXTS) + edited_lines(random.Random(tau))
    got = by_id(line_dedup.line_report(table(spark, texts), tau, 16))
    assert {i: tuple(r)[1:] for i, r in got.items()} == brute_lines(texts, tau, 16)


def test_line_dedup_rebuilds_texts(spark):
    texts = ["a\nb\na", "b\nc\n\n  ", None, "", "a\n\nd"]
    rows = line_dedup.without_repeated_lines(table(spark, texts))
    assert rows.columns == table(spark).columns
    assert {i: r.text for i, r in by_id(rows).items()} == {0: "a\nb", 1: "c\n\n  ", 2: None, 3: "", 4: "\nd"}
    assert line_dedup.line_report(empty(spark)).count() == 0


def test_mix(spark):
    rng = random.Random(3)
    texts = ["w " * rng.randint(0, 900) for _ in range(200)]
    rows = [(i, t, None if i % 7 == 0 else f"s{(i * i) % 4}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(mixing.mix(docs, shard_tokens=4000))
    again = by_id(mixing.mix(docs.repartition(7), shard_tokens=4000))
    assert got == again
    sizes = defaultdict(int)
    for i, t, s in rows:
        assert got[i].size == len(t.split())
        sizes[s] += got[i].size
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, pool, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = (pool - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in got.values():
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 64 for s in order)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(table(spark, [None, "", " "])).collect())
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs, shard_tokens=4000).collect())
    assert all(copies[i] == (int(r.taken / r.size + 0.5) if r.size else 0) for i, r in got.items())


def test_sainte_lague_by_highest_quotients(spark):
    rng = random.Random(9)
    for _ in range(6):
        votes, seats = [rng.choice([0, 1, 5, 40, 1000]) * rng.random() for _ in range(9)], rng.randint(0, 60)
        won = [0] * 9
        if sum(votes):
            for _ in range(seats):
                won[max((k for k in range(9) if votes[k]), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))] += 1
        frame = spark.createDataFrame([(k, v) for k, v in enumerate(votes)], "k int, v double")
        got = {r.k: r.quota for r in mixing.sainte_lague(frame, [], "v", F.lit(seats), ["k"]).collect()}
        assert got == dict(enumerate(won))


PROSE = "This is a long paragraph of prose, with commas, and enough characters to be taken as the text of an article, I think."


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("<article></article>", ""),
        (f'<nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>{PROSE}<br>b  &lt;c&gt;\n d<p>e</article><footer>f</footer>', f"T & U {PROSE} b <c> d e"),
        (f'<div id="siteHeader"><a>n</a></div><div class="has-sidebar"><main><p>{PROSE}</p><div class="cookie-notice">We use cookies</div><ul><li>x<li>y</ul></main></div><div id="comments"><p>{PROSE}</p></div>', f"{PROSE} x y"),
        (f'<div class="menu"><a>aa</a></div><div class="post"><h2>T</h2><p>{PROSE}</p><p>short.</p><form>Mail</form><div class="comments"><p>{PROSE}</p></div></div>', f"T {PROSE} short."),
        (f"<script>var a='</p>';</script><style>p{{}}</style><body><p>{PROSE}</p><!-- c --><p>{PROSE}</p>", f"{PROSE} {PROSE}"),
    ],
)
def test_main_text(html, text):
    assert (html_extract.main_text(html) if html else "") == text


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", f"<article><p>{PROSE}</p></article>", "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(rows).collect()}
    assert got == {1: (PROSE, len(PROSE)), 2: ("", 0)}
    assert html_extract.extract_pages(rows.limit(0)).count() == 0


def test_features_of_awkward_texts():
    x = text_features.features(pa.array([t or "" for t in TEXTS]))
    assert x.shape == (len(TEXTS), len(text_features.NAMES)) and np.isfinite(x).all() and not x[1].any()
    for i, t in enumerate(TEXTS):
        assert np.allclose(text_features.features(pa.array([t or ""]))[0], x[i])


def test_quality_model_learns_held_out_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_gam.classify(docs, labels).join(labels, "doc_id")
    held = scored.where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() >= 0.9
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored.collect())
    none = quality_gam.classify(table(spark), labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5} and none.count() == len(TEXTS)
    assert quality_gam.good_documents(docs, labels).columns == docs.columns


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_pipeline_stages_and_names(spark, sf_dir):
    import __spark_entry__
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing sources", "byte-level BPE"]
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in __spark_entry__.queries() if k.startswith("op") and "_" in k}
