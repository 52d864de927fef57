"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are laid on a line of words in a keyed random order, and the line is cut into
blocks of equal length. The target says how many blocks the mix takes of a source: all of them for every whole
epoch, and in the last epoch the first ones of a random permutation, the last of them in part, so the quota is exact to the
word. The tree halves the output shards again and again; at each node one multivariate-hypergeometric
draw says how many blocks of each source go left, so the leaves are what dealing all blocks at random
would give and every quota stays exact. The blocks of a source are permuted once more and handed out to its
leaves in disjoint ranges; a shard then shuffles its own pieces.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certamap.llm.common import blocked_prefix, cut, table, word_count

WEIGHTS, BUDGET, MOST_EPOCHS, SHARDS, BLOCK_WORDS, SEED = (5.0, 2.0, 1.0), 1.5, 2, 8, 1024, 17


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float = BUDGET, most_epochs: float = MOST_EPOCHS) -> list[float]:
    """Share `budget` times all sizes by weight; a source stops at `most_epochs` times its size, the excess is reshared until none is above."""
    caps = [most_epochs * s for s in sizes]
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), budget * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > caps[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(caps[i])
        left -= sum(caps[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` blocks are good ones, by inversion of the distribution function.

    The probabilities are followed out from the mode as far as they count in double precision, 12 deviations: a
    window that grows with the square root of the numbers, the same rule at every size.
    """
    total, low, high = good + bad, max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = (drawn + 1) * (good + 1) // (total + 2)
    dev = math.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / max(1, total - 1)))
    a, b = max(low, mode - int(12 * dev) - 12), min(high, mode + int(12 * dev) + 12)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    total_p = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(total_p, rng.random() * total_p[-1], side="right"))


def splitting_tree(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """[shard, source]: how many blocks of each source each shard gets. Columns add up to the quotas."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(quotas)), np.int64)

    def split(q: list[int], lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        rest, due, left = sum(q), sum(q) * (mid - lo) // (hi - lo), []
        for n in q:  # source by source, each given those before it
            rest -= n
            left.append(hypergeometric(rng, n, rest, due))
            due -= left[-1]
        split(left, lo, mid)
        split([n - k for n, k in zip(q, left, strict=True)], mid, hi)

    split([int(q) for q in quotas], 0, shards)
    return out


def measured(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """(row, id, source, size, place): the whole row, its words, and where it comes on its source's line; rows that differ in id or text have places of their own."""
    source = F.col(source_col).cast("string")
    place = F.xxhash64(F.lit(seed), F.col(id_col), source, F.col(text_col))
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), source.alias("source"), word_count(F.col(text_col)).alias("size"), place.alias("place"))


@dataclass(frozen=True)
class Quota:
    """What the mix takes of a source: the first `blocks` of the sequence of its blocks, epoch after epoch, the last one up to `last` words."""

    source: str | None
    size: int
    target: float
    full: int  # blocks of `block_words` words in an epoch; `a_epoch` counts what is left over, too
    a_epoch: int
    blocks: int
    last: int


def quota(source: str | None, size: int, target: float, most_epochs: int, block_words: int) -> Quota:
    taken, full = min(round(target), most_epochs * size), size // block_words
    a_epoch = full + (size % block_words > 0)
    epochs, rest = divmod(taken, size) if size else (0, 0)
    blocks, last = epochs * a_epoch + rest // block_words, rest % block_words
    return Quota(source, size, target, full, a_epoch, blocks + (last > 0), last or block_words)


def _permutation(rng: np.random.Generator, n: int) -> tuple[int, int]:
    """(step, shift): k -> (k * step + shift) % n is a permutation; the product stays within a long."""
    step = int(rng.integers(1, max(1, min(n, (1 << 62) // max(1, n))) + 1))
    while math.gcd(step, max(1, n)) != 1:
        step -= 1
    return step, int(rng.integers(0, max(1, n)))


def _mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    most_epochs: int = MOST_EPOCHS,
    shards: int = SHARDS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    whole: bool = False,
) -> DataFrame:
    """`mix` with the column place, and where `whole`, the row."""
    spark = docs.sparkSession
    wide = measured(docs, id_col, source_col, text_col, seed)
    rows = cut(wide.drop("row"))
    summed = sorted(((r[0], int(r[1]), int(r[2])) for r in rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    each = [weights[i % len(weights)] for i in range(len(summed))]
    goals = targets([s for _, s, _ in summed], each, budget, most_epochs)
    quotas = [quota(name, size, float(goal), most_epochs, block_words) for (name, size, _), goal in zip(summed, goals, strict=True)]
    leaves = splitting_tree([q.blocks for q in quotas], shards, seed)
    rng = np.random.default_rng([seed, 1])
    spec = [(q.source, q.size, q.target, q.full, q.a_epoch, q.blocks, q.last, *_permutation(rng, q.full), *_permutation(rng, q.blocks), np.cumsum(leaves[:, k]).tolist()) for k, q in enumerate(quotas)]
    recipe = spark.createDataFrame(spec, "s string, source_size long, target double, full long, a_epoch long, blocks long, last long, step long, shift long, deal long, cut long, ends array<long>")
    placed = blocked_prefix(wide if whole else rows, "source", "place", ["id", "size"], "size", "starts", sum(n for *_, n in summed), rows)
    joined = placed.join(recipe, placed.source.eqNullSafe(recipe.s), "left")
    w = F.lit(block_words)

    def in_epoch(e: Column) -> Column:  # the runs of one epoch, one for each block
        lo, hi = F.col("starts"), F.col("starts") + F.col("size")
        blocks = F.when(hi > lo, F.sequence(F.floor(lo / w), F.floor((hi - 1) / w))).otherwise(F.array().cast("array<long>"))

        def piece(b: Column) -> Column:
            rank = F.when(b < F.col("full"), F.pmod(b * F.col("step") + F.col("shift"), F.col("full"))).otherwise(b)
            at = e * F.col("a_epoch") + rank
            dealt = F.pmod(at * F.col("deal") + F.col("cut"), F.col("blocks"))
            end = b * w + F.when(at == F.col("blocks") - 1, F.col("last")).otherwise(w)
            end = F.when(at < F.col("blocks"), end).otherwise(lo)
            return F.struct(e.alias("epoch"), F.size(F.filter("ends", lambda x: x <= dealt)).alias("shard"), dealt.alias("block"), (F.greatest(lo, b * w) - lo).alias("from_word"), (F.least(hi, end) - lo).alias("to_word"))

        return F.filter(F.transform(blocks, piece), lambda p: p["to_word"] > p["from_word"])

    epochs = F.sequence(F.lit(0), F.lit(most_epochs - 1))
    pieces = F.flatten(F.transform(epochs, in_epoch)).alias("pieces")
    return joined.select(*(["row"] if whole else []), "id", "source", "size", "source_size", "target", "starts", "place", pieces)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: (id, source, size, source_size, target, starts, pieces).

    pieces: array of (epoch, shard, block, from_word, to_word), the runs of the document's words that the mix
    takes, one for each epoch and block they fall in; a document taken twice is there twice. `block` counts the blocks of the
    source in the order in which they are dealt, `starts` is the document's place on its source's line. Sources in code point
    order, null last, get the weights in turn. Options: id_col, source_col, text_col, weights, budget, most_epochs, shards, block_words, seed.

    The source table (one row per source, with its size) comes to the driver; it is the mixing recipe itself, and is broadcast only
    if Spark finds it small enough.
    Nulls: a null source is a source of its own, a null text has size 0 and no pieces, a null id is carried.
    Ties and repeated rows: each row has its own stretch of the line. Empty table: empty result. Other columns are ignored.
    """
    return _mixed(docs, **options).drop("place")


def shard_order(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, position, id, from_word, to_word): what each shard holds, shuffled locally; positions are gapless from 0."""
    pieces = cut(mixed.select("id", "source", "starts", F.inline("pieces")))
    pieces = pieces.withColumn("_place", F.xxhash64(F.lit(seed), F.lit(2), "source", "block", "starts", "from_word")).withColumn("_one", F.lit(1))
    out = blocked_prefix(pieces, "shard", "_place", ["source", "block", "starts", "from_word", "id"], "_one", "position", pieces.count())
    return out.select("shard", "position", "id", "from_word", "to_word")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken sums the document's pieces; the pieces themselves follow as epoch:shard:block:from:to, joined by commas."""
    mixed = mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["to_word"] - p["from_word"])
    dealt = F.array_join(F.transform("pieces", lambda p: F.concat_ws(":", *(p[c].cast("string") for c in ("epoch", "shard", "block", "from_word", "to_word")))), ",")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), dealt.alias("pieces"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once for each epoch of which it takes at least half of their words.

    They come shard after shard, shuffled within each: a copy belongs to the shard that has most of its words, the first of equals. A document
    without words costs nothing, stays once and goes to a shard by its place. Nulls, ties, repeated rows and empty tables as in `mix`; columns may have any names.
    """
    e = lambda k: F.filter("pieces", lambda p: p["epoch"] == k)
    length = lambda ps: F.aggregate(ps, F.lit(0).cast("long"), lambda a, p: a + p["to_word"] - p["from_word"])

    def home(ps: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(SHARDS - 1)), lambda k: F.struct((-length(F.filter(ps, lambda p: p["shard"] == k))).alias("n"), k.alias("shard")))
        return F.array_min(each)["shard"]

    none = F.when(F.col("size") == 0, F.array(F.pmod(F.xxhash64("place"), F.lit(SHARDS)).cast("int")))
    copies = F.transform(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1)), lambda k: F.when(2 * length(e(k)) >= F.col("size"), home(e(k))))
    homes = F.posexplode(F.coalesce(none, F.array_compact(copies))).alias("copy", "shard")
    out = _mixed(docs, whole=True).select("row", "place", homes).withColumn("place", F.xxhash64(F.lit(SEED), F.lit(3), "place", "copy"))
    return out.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").select("row.*")
