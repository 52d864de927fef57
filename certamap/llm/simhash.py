"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in 3 bits or fewer differ in at most 3 of their 8 bytes, so they
share at least 5 positional bytes. A posting list for each single (position, byte) would hold a 256th
of all fingerprints, so the lists of the distributed index are keyed by four positions at once: the 14 blocks of the Steiner
system S(3,4,8) are such that, whichever 3 positions differ, one block lies within the other 5. Inside a
list the other four positions have posting lists by (position, byte): the hits of a pair are tallied, only pairs that
reach the guaranteed minimum of 5 shared bytes are kept, and only those are verified by their differing bits.
A list emits a spanning forest of its links, never its pairs; a long list is dealt to its inner posting lists instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certamap.llm.common import cut, fresh, table
from certamap.operators.components import components

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: Fingerprints of one posting list that one task compares with each other; longer lists are compared block by block.
LIST_BLOCK = 2048

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text; 0 for a text without words, null included."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text takes no more memory than one of these
        stop = min(n, at + (1 << 16))
        spans = zip(starts[at:stop].tolist(), ends[at + shingle - 1 : stop + shingle - 1].tolist(), strict=True)
        h = np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long. Repeated rows stay repeated."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text")).mapInArrow(run, schema)


def steiner_blocks() -> list[tuple[int, ...]]:
    """The 14 blocks of S(3,4,8): the four-element subsets of {0..7} whose binary XOR is 0."""
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def tally(front: np.ndarray, left: np.ndarray, positions: Sequence[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (into front, into left) of the pairs that share at least `least` of the bytes at `positions`, by counting their hits in posting lists."""
    codes = []
    for p in positions:
        shift = np.uint64(8 * p)
        own, theirs = (front >> shift).astype(np.uint8), (left >> shift).astype(np.uint8)
        order = np.argsort(theirs, kind="stable")
        ends = np.cumsum(np.bincount(theirs, minlength=256))
        starts = ends - np.diff(ends, prepend=0)
        size = (ends - starts)[own]
        row = np.repeat(np.arange(len(front)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[own], size)
        codes.append(row * len(left) + order[at])
    code, hits = np.unique(np.concatenate(codes), return_counts=True)
    code = code[hits >= least]
    return code // len(left), code % len(left)


def forest(fps: np.ndarray, positions: Sequence[int], most_bits: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among `fps`, which share the bytes that are not at `positions`; breadth first, with one tally of each pair at most."""
    left = fps.view(np.uint64)  # numpy counts the bits of a signed number's absolute value
    least = len(positions) - most_bits  # of the bytes at the positions, when the others are shared
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root], np.uint64)
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(front), 256):
                part = front[at : at + 256]
                if least > 0:
                    a, b = tally(part, left, positions, least)
                    hit[b[np.bitwise_count(part[a] ^ left[b]) <= most_bits]] = True
                else:  # the list itself has the guaranteed minimum
                    hit |= (np.bitwise_count(part[:, None] ^ left[None, :]) <= most_bits).any(axis=0)
            front, left = left[hit], left[~hit]
            for x in front.view(np.int64).tolist():
                yield int(root.astype(np.int64)), x


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _postings(fps: DataFrame, list_block: int) -> DataFrame:
    """(q, p, v, i, j, fp): q, p, v name a posting list, of the block q of positions or (p >= 0) of that and position p; i, j the pair of blocks of it that meet (0, 0 if it is one block).

    A list of more than `list_block` fingerprints is dealt to its inner lists: a link in it shares a byte at one of the other
    four positions, too. Inner lists that are still too long meet block by block.
    """
    blocks = steiner_blocks()
    mask = lambda positions: F.lit(_signed(sum(255 << (8 * p) for p in positions)))
    lists = F.array(*[F.struct(F.lit(q).alias("q"), F.col("fp").bitwiseAND(mask(block)).alias("v")) for q, block in enumerate(blocks)])
    index = fps.select("fp", F.inline(lists))
    long = cut(index.groupBy("q", "v").count().where(F.col("count") > list_block).select(F.col("q").alias("lq"), F.col("v").alias("lv")))
    if long.isEmpty():
        return index.select("q", F.lit(-1).alias("p"), "v", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    same = (F.col("q") == F.col("lq")) & (F.col("v") == F.col("lv"))
    inner = F.lit(None).cast("array<struct<p:int,v:bigint>>")
    for q, block in enumerate(blocks):
        each = [F.struct(F.lit(p).alias("p"), F.col("fp").bitwiseAND(mask((*block, p))).alias("v")) for p in range(8) if p not in block]
        inner = F.when(F.col("q") == q, F.array(*each)).otherwise(inner)
    short = index.join(long, same, "left_anti").select("q", F.lit(-1).alias("p"), "v", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    deep = cut(index.join(long, same, "left_semi").select("q", "fp", F.inline(inner)))
    longer = cut(deep.groupBy("q", "p", "v").count().where(F.col("count") > list_block).select(F.col("q").alias("lq"), F.col("p").alias("lp"), F.col("v").alias("lv"), F.ceil(F.col("count") / list_block).cast("int").alias("nb")))
    deep = deep.join(longer, same & (F.col("p") == F.col("lp")), "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    own, other = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    met = deep.select("q", "p", "v", own.alias("own"), other.alias("other"), "fp").select("q", "p", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    return short.union(met)


def links(fps: DataFrame, most_bits: int = MOST_BITS, list_block: int = LIST_BLOCK) -> DataFrame:
    """(a, b): links that join every two of the distinct `fp` values that are connected at `most_bits` differing bits (3 at most). No value is null; without values, or with one, there are no links."""
    blocks = steiner_blocks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: np.ndarray | None = None  # the rows of the list that the next batch may continue

        def lists(rows: np.ndarray) -> pa.RecordBatch | None:
            ends = np.flatnonzero(np.concatenate([(rows[1:, :5] != rows[:-1, :5]).any(axis=1), [True]])) + 1
            starts = np.concatenate([[0], ends[:-1]])
            found: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                shared = (*blocks[rows[s, 0]], rows[s, 1])
                found += forest(np.ascontiguousarray(rows[s:e, 5]), [p for p in range(8) if p not in shared], most_bits)
            if not found:
                return None
            a, b = np.array(found, np.int64).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if keep is not None:
                rows = np.concatenate([keep, rows])
            last = int(np.flatnonzero((rows[:, :5] == rows[-1, :5]).all(axis=1))[0])
            keep = rows[last:]
            if last and (out := lists(rows[:last])) is not None:
                yield out
        if keep is not None and (out := lists(keep)) is not None:
            yield out

    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _postings(fps, list_block).repartition(n, "q", "p", "v", "i", "j").sortWithinPartitions("q", "p", "v", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS, list_block: int = LIST_BLOCK) -> DataFrame:
    """One row per input row: (id, fp, component_id), component_id the smallest id reachable through links, itself included.

    Nulls: a null text counts as empty and has fingerprint 0, which links like any other; a null id
    gets the smallest id of its component, null if it has none. Ties and repeated rows: rows with equal fingerprints are one
    node of the graph, and every one of them gets its component. An empty table gives an empty result. Further columns of `docs` are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fp"), most_bits, list_block), "a", "b")
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = cut(placed.join(firsts, placed.root == firsts.r).select(F.col("fp").alias("f"), "component_id"))
    return fps.join(named, fps.fp == named.f).select("id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id; of rows that repeat id and text, one.

    Documents without words are one group, null texts among them; of a group without any id one row for each text stays. An empty table stays empty; columns may have any names.
    """
    key, none, text = fresh(docs, "_id"), fresh(docs, "_none"), fresh(docs, "_text")
    at = lambda c: (F.coalesce(F.col(c), F.lit(0)).alias(key), F.col(c).isNull().alias(none))
    named = cut(near_duplicates(docs).where("id <=> component_id").select(*at("id")).distinct())
    # the kept ids have no bound, so they are never broadcast; one exchange of the texts serves the join and the repeated rows
    kept = docs.select("*", *at("doc_id")).join(named.hint("shuffle_merge"), [key, none], "left_semi")
    return kept.withColumn(text, F.xxhash64("text")).dropDuplicates([key, none, text]).select(*docs.columns)
