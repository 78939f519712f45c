"""Near-duplicate documents by MinHash: banded minima, signature verification, exact confirmation, components.

A document's set holds its distinct shingles of five words. Documents with equal sets are one class, told by its
smallest doc_id. Classes that share a band of their minima are candidates. Each bucket first links its members to its
smallest one. Where that leaves several components in a bucket, all members outside its largest component are compared
with all others in it, in blocks of bounded size: by signatures first, and those that these leave by full sets. So groups
of thousands of near copies give a few links a document, and no pair of classes in a bucket goes unjudged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import bit_table, dealt_anew, discard, materialise, may_be_wanted, small_batches, text_of
from firnline.llm.components import connected_components
from firnline.llm.text_features import mixed, string_bytes, word_hashes, words

SHINGLE = 5
#: Similarity of three quarters, as a fraction of whole numbers.
LIKE, OF = 75, 100
BANDS, ROWS = 32, 4
#: Pairs whose signatures agree in less than this share are not confirmed: four standard deviations below 0.75.
LEAST_AGREEMENT = 0.60
#: Members of a bucket that are compared with each other at once.
BLOCK = 512
#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 22

_RANDOM = np.random.default_rng(42)
_A = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_BAND = _RANDOM.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The column in pieces of at most `most` bytes, or of one value."""
    _, offsets = string_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield column.slice(at, end - at)
        at = end


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, all in one array, a second hash of each, and the n + 1 places where texts begin."""
    data, offsets = string_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends = words(data, offsets)
    first = np.searchsorted(starts, offsets)  # where each text's words begin, and the end
    n = np.diff(first)
    shingles = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), shingles)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[owner]
    length = np.minimum(n, SHINGLE)[owner]

    def hashed(which: int) -> np.ndarray:
        whole = np.append(word_hashes(data, starts, ends, which), np.zeros(SHINGLE, np.uint64))
        total = np.zeros(len(owner), np.uint64)
        for k in range(SHINGLE):
            total += np.where(k < length, whole[np.minimum(at + k, len(whole) - 1)], np.uint64(0)) * _PLACES[k]
        return mixed(total + length.astype(np.uint64))

    total, second = hashed(0), hashed(1)
    order = np.lexsort((total, owner))
    total, second, owner = total[order], second[order], owner[order]
    keep = np.ones(len(total), bool)
    keep[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[keep], second[keep], np.searchsorted(owner[keep], np.arange(len(n) + 1))


def signatures(total: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The minima of BANDS x ROWS universal hashes over each set, as 32-bit integers; all ones for an empty set."""
    out = np.full((len(places) - 1, len(_A)), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(places))
    if len(some):
        for k, (a, b) in enumerate(zip(_A, _B, strict=True)):
            out[some, k] = np.minimum.reduceat((total * a + b) >> np.uint64(32), places[some])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, key1, key2 (two hashes of the set, 128 bits), signature (a byte of each minimum), bands of each document."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n long, key1 long, key2 long, signature binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for piece in slices(batch.column("text")):
                total, second, places = shingle_sets(piece)
                summed = lambda x, p=places: np.diff(np.append(np.uint64(0), np.cumsum(x))[p])
                minima = signatures(total, places)
                bands = np.zeros((len(piece), BANDS), np.uint64)
                for k in range(BANDS):
                    own = minima[:, k * ROWS : (k + 1) * ROWS].astype(np.uint64)
                    bands[:, k] = mixed((own * _IN_BAND).sum(1, dtype=np.uint64) + np.uint64(k))
                parts.append((np.diff(places), summed(total), summed(second), minima.astype(np.uint8), bands))
            n, key1, key2, low, bands = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, int), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty((0, BANDS * ROWS), np.uint8), np.empty((0, BANDS), np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel().view(np.int64)))
            binary = pa.array([x.tobytes() for x in low], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), binary, lists], ["doc_id", "n", "key1", "key2", "signature", "bands"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)


def agreement_filter(pairs: DataFrame, least: float = LEAST_AGREEMENT) -> DataFrame:
    """Signature verification: the rows of a, b, signature_a, signature_b that agree in at least this share; a and b only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_matrix(batch.column(c)) for c in ("signature_a", "signature_b"))
            yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(1) >= least)) if len(batch) else batch.select(["a", "b"])

    return pairs.select("a", "b", "signature_a", "signature_b").mapInArrow(run, "a long, b long")


def _matrix(column: pa.Array) -> np.ndarray:
    return string_bytes(column)[0].reshape(len(column), -1)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, shingles (their hashes, ascending, 8 bytes each) of the documents whose doc_id is in ids.id.

    A table of bits lets most other documents be passed over where they are read, so that only wanted sets are moved.
    """
    maybe = bit_table(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_be_wanted(maybe, batch.column("doc_id").to_numpy())))
            out = []
            for piece in slices(batch.column("text")):
                total, _, places = shingle_sets(piece)
                out += [total[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "shingles"])

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(run, "doc_id long, shingles binary").join(ids, F.col("doc_id") == F.col("id"), "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame, like: int = LIKE, of: int = OF) -> DataFrame:
    """The pairs a, b whose full sets have of * intersection >= like * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good[i] = of * common >= like * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of one group each from batches that are sorted by integer keys; one group is held at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        values = np.column_stack([table.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(table)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and tuple(values[start]) != last:
                yield pa.concat_tables(held)
                held = []
            last = tuple(values[start])
            held.append(table.slice(start, end - start))
    if held:
        yield pa.concat_tables(held)


def common_counts(sets: list[np.ndarray], chosen: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the chosen sets in turn, how many elements it shares with each of the sets."""
    lengths = np.array([len(x) for x in sets])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(lengths) - lengths
    marked = np.zeros(int(number.max()) + 1, np.int32)
    for k in chosen.tolist():
        own = number[starts[k] : starts[k] + lengths[k]]
        marked[own] = 1
        yield k, np.add.reduceat(marked[number], starts)
        marked[own] = 0


def open_buckets(placed: DataFrame, least: int = 2) -> DataFrame:
    """bucket, base, n_base, n_rest of the buckets of placed (bucket, node, component) that hold several components.

    base is the component with most members in the bucket. Of buckets with the same members one is enough. Buckets of
    fewer than `least` members are left out.
    """
    own = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(x).alias(f"x{k}") for k, x in enumerate(own)])
    most = F.max(F.struct("n", "component"))
    whole = parts.groupBy("bucket").agg(most.alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("components"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"))
    whole = whole.where((F.col("components") > 1) & (F.col("n") >= least)).groupBy("n", "x0", "x1").agg(F.min(F.struct("bucket", "most")).alias("one"))
    return whole.select("one.bucket", F.col("one.most.component").alias("base"), F.col("one.most.n").alias("n_base"), (F.col("n") - F.col("one.most.n")).alias("n_rest"))


def dealt_blocks(members: DataFrame, block: int) -> DataFrame:
    """bucket, i, j, own, node, component: the members of bucket, node, component, base, n_base, n_rest dealt out by blocks.

    Members outside a bucket's largest component are cut into blocks of about `block`, and so is that one; each of the
    former (i) meets each block (j) in a task of its own. No two blocks of the largest component meet.
    """
    count = lambda n: F.ceil(F.col(n) / block).cast("int")
    rest, base, based = count("n_rest"), count("n_base"), F.col("component") == F.col("base")
    dealt = members.withColumn("rest", rest).withColumn("blocks", rest + base)
    spread = lambda size: F.pmod(F.xxhash64("node"), size).cast("int")
    dealt = dealt.withColumn("own", F.when(based, F.col("rest") + spread(F.col("blocks") - F.col("rest"))).otherwise(spread(F.col("rest"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(based, F.col("rest")).otherwise(F.col("blocks")) - 1)))
    return dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")


def _met(dealt: DataFrame) -> DataFrame:
    """The rows of each two blocks in one task, one after the other."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")


def alike_members(members: DataFrame, signed: DataFrame, least: float = LEAST_AGREEMENT, block: int = BLOCK) -> DataFrame:
    """bucket, node of the members whose signature agrees with that of a member of another component in the bucket.

    Signature verification within buckets: most members of a bucket meet there by chance, and their sets need not move.
    """
    dealt = dealt_blocks(members, block).join(signed, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bucket", "i", "j"]):
            component = group.column("component").to_numpy()
            if (component == component[0]).all():
                continue
            side, i, j = group.column("own").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
            low = _matrix(group.column("signature").combine_chunks())
            alike = np.zeros(len(low), bool)
            for x in np.flatnonzero(side == i):
                near = (component != component[x]) & ((i == j) | (side == j)) & ((low == low[x]).mean(1) >= least)
                alike |= near
                alike[x] |= near.any()
            yield pa.RecordBatch.from_arrays([group.column(c).combine_chunks().filter(pa.array(alike)) for c in ("bucket", "node")], ["bucket", "node"])

    return _met(dealt).mapInArrow(run, "bucket long, node long").distinct()


def bucket_links(members: DataFrame, sets: DataFrame, like: int = LIKE, of: int = OF, block: int = BLOCK) -> DataFrame:
    """Links a, b between different components in one bucket, for members of bucket, node, component, base, n_base, n_rest.

    Every two members of a bucket that are of different components are compared by their full sets, in blocks. A task
    holds the members of two blocks only and gives no more links than it takes to join what is linked: fewer than it
    has members.
    """
    dealt = dealt_blocks(members, block).join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bucket", "i", "j"]):
            node, root = group.column("node").to_numpy(), group.column("component").to_numpy().copy()
            if (root == root[0]).all():
                continue
            side, i, j = group.column("own").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
            shingles = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in group.column("shingles").chunks for x in chunk]
            size = np.array([len(x) for x in shingles])
            a, b = [], []
            for x, common in common_counts(shingles, np.flatnonzero(side == i)):
                linked = of * common >= like * (size + size[x] - common)
                for y in np.flatnonzero(linked & (root != root[x]) & ((i == j) | (side == j))):
                    if root[y] != root[x]:
                        a.append(node[x])
                        b.append(node[y])
                        root[root == root[y]] = root[x]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _met(dealt).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are what stands between white space, with A-Z as lower case. A text of fewer than five words has one shingle
    of all of them; one without words, empty or null, has none, is linked with nothing and is kept. Documents are
    linked when their sets share three quarters of their union; component_id is the smallest doc_id that links reach,
    and that document is kept. Rows of one doc_id have all their texts' links together. A row without doc_id is linked
    by an equal set only, and kept if that has no doc_id at all (component_id is null then). An empty table gives no
    rows; other columns are not read.
    """
    sketched = materialise(sketches(docs), "minhash-sketches")
    some = sketched.where("n > 0")
    classes = dealt_anew(some.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")))
    first = F.col("doc_id") == F.col("rep")
    known = some.join(classes, ["key1", "key2"]).unionByName(sketched.where("n = 0").withColumn("rep", F.lit(None).cast("long")))
    members = materialise(known.select("doc_id", "n", "rep", F.when(first, F.col("signature")).alias("signature"), F.when(first, F.col("bands")).alias("bands")), "minhash-members")
    discard(sketched)
    reps = members.where(first)
    banded = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node"))
    smallest = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("bucket", "low")
    buckets = materialise(banded.join(dealt_anew(smallest), "bucket"), "minhash-buckets")
    signed = reps.select(F.col("doc_id").alias("node"), "signature").join(buckets.select("node").distinct(), "node", "left_semi")
    signed = materialise(signed, "minhash-signed")
    sets = materialise(full_sets(docs, signed.select(F.col("node").alias("id"))), "minhash-sets")

    stars = buckets.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("signature_a")), "a").join(signed.select(F.col("node").alias("b"), F.col("signature").alias("signature_b")), "b")
    tried = materialise(agreement_filter(stars), "minhash-tried")
    links = materialise(confirmed(tried, sets), "minhash-links")
    components = materialise(connected_components(links), "minhash-components")
    placed = buckets.join(components, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    several = materialise(placed.join(dealt_anew(open_buckets(placed, 3)), "bucket"), "minhash-open")  # the smallest of a bucket has met each of its members
    alike = several.select("bucket", "node", "component").join(alike_members(several, signed), ["bucket", "node"], "left_semi")
    alike = materialise(alike, "minhash-alike")
    left = materialise(alike.join(dealt_anew(open_buckets(alike)), "bucket"), "minhash-open")
    more = materialise(bucket_links(left, sets), "minhash-links")
    if not more.isEmpty():
        components = materialise(connected_components(links.unionByName(more)), "minhash-components")
    discard(buckets, signed, sets, tried, links, several, alike, left, more)
    component = F.coalesce("component", "rep", "doc_id")
    return members.select("doc_id", "n", "rep").join(components, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, of which one stays for each group of near duplicates. Rows without doc_id stay."""
    kept = near_duplicates(docs.where(F.col("doc_id").isNotNull())).where("kept").select("doc_id").alias("k")
    left = docs.alias("d")
    return left.where(F.col("d.doc_id").isNotNull()).join(kept, F.col("d.doc_id") == F.col("k.doc_id"), "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
