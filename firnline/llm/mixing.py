"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, all in DataFrame functions.

Each source gets a target number of words, and blocks of `block_tokens` words go to sources by the highest quotients
target / (2 s + 1). A source is cut into shards of bounded size by a seeded draw, and its blocks go to the shards in the
same way, so each shard has an integer quota. The words of a shard's documents, in seeded order, are cut into blocks;
the quota takes all of them as often as it can and the rest in the order of a seeded draw of their own. No window over
documents or blocks spans more than one shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.common import WORD, discard, materialise, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
BLOCK_TOKENS = 64
SHARD_TOKENS = 1 << 20
SEED = 20250


def draw(*parts: Column | int | str) -> Column:
    """A number of 60 bits from the parts' digest, the same in any engine that has MD5."""
    shown = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *shown).cast("binary")), 1, 15), 16, 10).cast("long")


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of each whole text, 0 for null."""
    return docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, position, source_size, target: a share of all words by weight, none above `most` times its source.

    Sources take the weights in code point order, null last. Excess over a source's limit goes to the others by weight
    until none is above; with sources in the order of limit / weight that is one pass of running sums. There is one row
    per source, and the windows below span these rows only.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = totals.withColumn("position", F.row_number().over(order)).withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "position")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.col("pool") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = placed.withColumn("pool", F.sum("source_size").over(everything) * float(share)).withColumn("level", level)
    full = F.col("level") * F.col("weight") >= F.col("limit")  # this source and all before it are at their limit
    leveled = leveled.withColumn("full", full).withColumn("water", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "position", "level"))).over(everything)["level"])
    target = F.when(F.col("full") | F.col("water").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("water") * F.col("weight")))
    return leveled.select("source", "position", "source_size", target.alias("target"))


def sainte_lague(parties: DataFrame, group: Sequence[str], votes: str, seats: Column, order: Sequence[str]) -> DataFrame:
    """parties with a column quota: the seats that each gets by the highest quotients votes / (2 s + 1) in its group.

    Rounding votes / (sum / seats) is at most half a seat a party off the house size; only the seats about that are
    ranked, a number of rows in proportion to the parties. Ties go by `order`. No votes: no seats.
    """
    own = Window.partitionBy(*group)
    x = parties.withColumn("_seats", seats.cast("long")).withColumn("_all", F.sum(votes).over(own))
    x = x.withColumn("_ideal", F.when(F.col("_all") > 0, F.col(votes) * F.col("_seats") / F.col("_all")).otherwise(F.lit(0.0)))
    x = x.withColumn("_round", F.floor(F.col("_ideal") + 0.5))
    x = x.withColumn("_off", F.abs(F.col("_seats") - F.sum("_round").over(own)))
    x = x.withColumn("_reach", F.ceil(F.col("_off") * F.col("_ideal") / F.greatest(F.col("_seats"), F.lit(1))) + 2)
    x = x.withColumn("_least", F.greatest(F.col("_round") - F.col("_reach"), F.lit(0)))
    x = x.withColumn("_left", F.col("_seats") - F.sum("_least").over(own))
    tried = x.where(F.col(votes) > 0).select(*group, *[c for c in order if c not in group], "_left", "_least", (F.col(votes) * 1.0).alias("_votes"), F.explode(F.sequence(F.col("_least"), F.col("_round") + F.col("_reach"))).alias("_s"))
    ranked = tried.withColumn("_rank", F.row_number().over(own.orderBy((F.col("_votes") / (2 * F.col("_s") + 1)).desc(), *order, "_s")))
    keys = [*group, *[c for c in order if c not in group]]
    won = ranked.where(F.col("_rank") <= F.col("_left")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    left, right = x.alias("p"), won.alias("w")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}"))
    return left.join(right, same, "left").select(*[F.col(f"p.{c}") for c in parties.columns], F.when(F.col(votes) > 0, F.col("_least") + F.coalesce("_won", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("quota"))


def block_quotas(shards: DataFrame, block_tokens: int, most: int, seed: int) -> DataFrame:
    """shards (position, shard, shard_size, quota) with passes, how often each of its blocks is taken, and cut: blocks
    whose draw is at most cut are taken once more, none where it is null."""
    blocks = F.ceil(F.col("shard_size") / block_tokens).cast("long")
    seats = F.least(F.col("quota"), F.col("blocks") * most)
    shards = shards.withColumn("blocks", blocks).withColumn("passes", F.when(F.col("blocks") > 0, F.floor(seats / F.greatest("blocks", F.lit(1)))).otherwise(F.lit(0)))
    shards = shards.withColumn("rest", seats - F.col("passes") * F.col("blocks"))
    each = shards.where("rest > 0").select("position", "shard", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    each = each.withColumn("draw", draw(seed, F.lit("block"), F.col("position"), F.col("shard"), F.col("block")))
    chosen = each.withColumn("rank", F.row_number().over(Window.partitionBy("position", "shard").orderBy("draw", "block"))).where("rank = rest")
    return shards.join(chosen.select("position", "shard", F.col("draw").alias("cut")), ["position", "shard"], "left").select("position", "shard", "passes", "cut")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    taken is the number of words the mix takes from the document, repeats counted, at most `most` times its size. A
    null source is a source of its own. Texts without words have size 0 and are never taken; an empty table gives no
    rows. The same rows, seed and parameters give the same mix, in whatever order or partitions they come; rows of one
    doc_id, or without one, are told apart by their size only.
    """
    sizes = materialise(word_sizes(docs), "mix-sizes")
    targets = materialise(source_targets(sizes, weights, share, most), "mix-targets")
    house = F.round(F.sum("target").over(Window.partitionBy()) / block_tokens)
    sources = sainte_lague(targets, [], "target", house, ["position"])
    sources = materialise(sources.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1)).cast("int")), "mix-sources").alias("t")
    discard(targets)
    own = draw(seed, F.col("doc_id"))
    dealt = sizes.alias("s").join(sources, F.col("s.source").eqNullSafe(F.col("t.source"))).select("doc_id", "s.source", "size", "source_size", "target", "position", "t.quota", own.alias("draw"), F.pmod(own, F.col("shards")).cast("int").alias("shard"))
    shards = dealt.groupBy("position", "shard").agg(F.first("quota").alias("source_quota"), F.sum("size").alias("shard_size"))
    shards = sainte_lague(shards, ["position"], "shard_size", F.col("source_quota"), ["shard"])
    seeded = Window.partitionBy("position", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("before", F.coalesce(F.sum("size").over(seeded), F.lit(0))).join(block_quotas(shards, block_tokens, most, seed), ["position", "shard"])
    end = F.col("before") + F.col("size")
    touched = F.sequence(F.floor(F.col("before") / block_tokens), F.floor((end - 1) / block_tokens))

    def more(words: Column, block: Column) -> Column:
        inside = F.least(end, (block + 1) * block_tokens) - F.greatest(F.col("before"), block * block_tokens)
        return words + F.when(draw(seed, F.lit("block"), F.col("position"), F.col("shard"), block) <= F.col("cut"), inside).otherwise(F.lit(0))

    once_more = F.when((F.col("size") > 0) & F.col("cut").isNotNull(), F.aggregate(touched, F.lit(0).cast("long"), more)).otherwise(F.lit(0))
    taken = F.col("passes") * F.col("size") + once_more
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix, with the columns of docs: each document as often as the mix takes it, rounded to whole copies.

    A document of which the mix takes less than half goes; one that it takes twice comes twice. Rows of one doc_id, or
    without one, come as often as the mix takes of all of them together.
    """
    plan = mix(docs, **how).groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    plan = plan.select(F.struct("doc_id").alias("key"), F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int").alias("copies")).where("copies > 0").alias("p")
    row = docs.select(F.struct(*docs.columns).alias("row")).alias("d")
    repeated = row.join(plan, F.col("d.row.doc_id").eqNullSafe(F.col("p.key.doc_id"))).select("d.row", F.explode(F.sequence(F.lit(1), F.col("p.copies"))))
    return repeated.select("row.*")
