"""Sharding by k-d tree: split at distributed weighted medians along the widest metadata dimension.

The dimensions are metadata of the text: its bytes, words and lines on a log scale and the share of its bytes beyond
ASCII, each brought to the range that the corpus has. A coordinate is such a value, then bits of the text's hash, then bits of
the row's own: the hashes only say how rows of one value lie about the median, so any dimension can be cut anywhere,
and equal texts lie together. A node is cut between two texts, where its bytes divide as its leaves do.
Where a heavy group of equal texts lies across that place, the next widest dimension is tried; if
each has one there, the widest is cut within the group, the only case that spreads a group over shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certamap.llm.common import blocked_prefix, cut, table, word_count

SHARDS, SEED = 8, 29
#: A cut between texts is taken if it misses its share of the node by at most this part of a shard's bytes.
TOLERANCE = 0.01
#: Bits of a coordinate: the value, the text's hash, the row's hash. Bins of a histogram pass, over all its nodes, as a power of 2.
VALUE_BITS, TEXT_BITS, ROW_BITS, BIN_BITS = 20, 21, 21, 16
DIMENSIONS = ("bytes", "words", "lines", "wide")


def metadata(id_col: str, text_col: str) -> dict[str, Column]:
    """size: UTF-8 bytes plus 1; crc; the dimensions as doubles; and tail: the hash bits below a coordinate's value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = F.octet_length(text).cast("long") + 1, F.crc32(F.encode(text, "UTF-8"))
    log = lambda x: F.log2(x.cast("double") + 1)
    high = lambda x, bits: F.shiftrightunsigned(x, 64 - bits)
    own = high(F.xxhash64(F.lit(SEED), F.col(id_col), text), ROW_BITS)
    return {
        "size": size,
        "crc": crc,
        "bytes": log(size),
        "words": log(word_count(text)),
        "lines": log(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))),
        "wide": 1 - F.char_length(text) / size,
        "tail": F.shiftleft(high(F.xxhash64(text), TEXT_BITS), ROW_BITS).bitwiseOR(own),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in metadata(id_col, text_col).items()))


def ranges(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """{dimension: (least, most)} of the measured rows."""
    got = rows.agg(*[f(d) for d in DIMENSIONS for f in (F.min, F.max)]).first()
    return {d: (got[2 * k] or 0.0, got[2 * k + 1] or 0.0) for k, d in enumerate(DIMENSIONS)}


def value(dim: str, span: tuple[float, float], of: Column | None = None) -> Column:
    """The dimension in 0 ... 2**VALUE_BITS - 1 over its range; 0 where the corpus has one value only."""
    low, high = span
    x = F.col(dim) if of is None else of
    if high <= low:
        return F.lit(0).cast("long")
    return F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(2**VALUE_BITS - 1)).cast("long")


def coordinate(of: Column, tail: Column) -> Column:
    return F.shiftleft(of, TEXT_BITS + ROW_BITS).bitwiseOR(tail)


def _place(splits: dict[int, tuple[str, int]], node: int, leaf) -> Column:
    """The leaf of a row, as nested conditions over the coordinates."""
    if node not in splits:
        return F.lit(leaf(node))
    dim, cut_at = splits[node]
    return F.when(F.col(dim) < cut_at, _place(splits, 2 * node, leaf)).otherwise(_place(splits, 2 * node + 1, leaf))


def _medians(rows: DataFrame, node: Column, wanted: dict[int, tuple[str, float]], within: bool) -> dict[int, tuple[int, int]]:
    """{node: (cut, bytes below it)}: the cut between two texts, or `within` one, whose bytes below come nearest to the wanted ones.

    Histograms, each pass inside the bin that the last one chose; what comes to the driver is bounded by 2**BIN_BITS bins a pass.
    """
    shift, stop = VALUE_BITS + TEXT_BITS + ROW_BITS, 0 if within else ROW_BITS
    most = max(1, BIN_BITS - max(0, math.ceil(math.log2(len(wanted)))))
    low, below = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0)
    best: dict[int, tuple[int, int]] = {}
    while shift > stop:
        step = min(most, shift - stop)
        shift -= step
        tried = F.lit(None).cast("long")
        for n, (dim, _) in wanted.items():
            inside = (F.col("_node") == n) & (F.shiftright(F.col(dim), shift + step) == (low[n] >> (shift + step)))
            tried = F.when(inside, F.shiftright(F.col(dim), shift)).otherwise(tried)
        bins = rows.withColumn("_node", node).withColumn("_bin", tried).where("_bin is not null").groupBy("_node", "_bin").agg(F.sum("size")).collect()
        found: dict[int, list[tuple[int, int]]] = {n: [] for n in wanted}
        for n, b, s in bins:
            found[n].append((b, int(s)))
        for n, (_, goal) in wanted.items():
            total, s = below[n], 0
            for b, s in sorted(found[n]):
                low[n], below[n] = b << shift, total
                if total + s >= goal:
                    break
                total += s
            if shift == stop:
                under, over = below[n], below[n] + s
                best[n] = (low[n], under) if goal - under <= over - goal else (low[n] + (1 << shift), over)
    return best


def grow(rows: DataFrame, shards: int = SHARDS) -> dict[int, tuple[str, int]]:
    """The splits {node: (dimension, cut)} of the tree over placed rows (size, and a coordinate and a value v_* for each dimension); the root is 1, children of n are 2n and 2n + 1."""
    splits: dict[int, tuple[str, int]] = {}
    leaves = {1: shards}
    while open_nodes := [n for n, k in leaves.items() if k > 1 and n not in splits]:
        node = _place(splits, 1, lambda n: n)
        stats = [F.sum("size").alias("bytes")]
        for d in DIMENSIONS:  # the byte-weighted spread of a dimension
            x = F.col(f"v_{d}") / 2.0**VALUE_BITS
            stats += [F.sum(x * F.col("size")), F.sum(x * x * F.col("size"))]
        seen = {r[0]: r for r in rows.withColumn("_node", node).groupBy("_node").agg(*stats).collect()}
        order, goal, share = {}, {}, {}
        for n in open_nodes:
            r, half = seen.get(n), leaves[n] // 2
            total = int(r["bytes"]) if r else 0
            spread = {d: r[3 + 2 * i] / total - (r[2 + 2 * i] / total) ** 2 if r else 0.0 for i, d in enumerate(DIMENSIONS)}
            order[n] = sorted(DIMENSIONS, key=lambda d: -round(spread[d], 12))  # noqa: B023
            goal[n], share[n] = total * half / leaves[n], total / leaves[n]
            leaves[2 * n], leaves[2 * n + 1] = half, leaves[n] - half
        left = list(open_nodes)
        for k in range(len(DIMENSIONS)):
            got = _medians(rows, node, {n: (order[n][k], goal[n]) for n in left}, False) if left else {}
            splits |= {n: (order[n][k], at) for n, (at, under) in got.items() if abs(under - goal[n]) <= TOLERANCE * share[n]}
            left = [n for n in left if n not in splits]
        got = _medians(rows, node, {n: (order[n][0], goal[n]) for n in left}, True) if left else {}
        splits |= {n: (order[n][0], at) for n, (at, _) in got.items()}
    return splits


def _placed(rows: DataFrame, spans: dict[str, tuple[float, float]]) -> DataFrame:
    """Measured rows with the coordinate of each dimension in its place, and its value as v_*."""
    valued = rows.withColumns({f"v_{d}": value(d, spans[d]) for d in DIMENSIONS})
    return valued.withColumns({d: coordinate(F.col(f"v_{d}"), F.col("tail")) for d in DIMENSIONS})


def leaf_numbers(shards: int) -> dict[int, int]:
    """{leaf node: shard}, from left to right."""
    out: dict[int, int] = {}

    def walk(n: int, k: int) -> None:
        if k == 1:
            out[n] = len(out)
            return
        walk(2 * n, k // 2)
        walk(2 * n + 1, k - k // 2)

    walk(1, shards)
    return out


def count_for(rows: DataFrame, target_bytes: int) -> int:
    """Shards that measured rows need for leaves of `target_bytes` at the most, about."""
    return max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """One row per input row: (id, size, crc, shard, slot). Sizes of shards are near equal; slots are gapless from 0. `target_bytes` decides the number of shards where it is given.

    Nulls: a null text weighs 1, a null id is placed like any other. Ties: equal texts share a shard unless
    their group is too heavy to balance. Repeated rows each get a slot. Empty table: empty result. Other columns are ignored.
    """
    rows = cut(measured(docs, id_col, text_col))
    shards = count_for(rows, target_bytes) if target_bytes else shards
    numbers, placed = leaf_numbers(shards), _placed(rows, ranges(rows))
    placed = placed.withColumn("shard", _place(grow(placed, shards), 1, numbers.__getitem__).cast("int"))
    placed = placed.select("id", "size", "crc", "shard", F.xxhash64(F.lit(SEED), "id", "tail", "size").alias("_key"), F.lit(1).alias("_one"))
    out = blocked_prefix(placed, "shard", "_key", ["id", "size"], "_one", "slot", rows.count())
    return out.select("id", "size", "crc", "shard", "slot")


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> None:
    """Write `docs` under `path`, one folder shard=K for each shard; the tree is grown from one pass over the texts' sizes and hashes.

    Nulls, ties, repeated rows and empty tables as in `shard`; columns may have any names but shard, which is the folders'.
    """
    rows = cut(measured(docs, id_col, text_col))
    spans, numbers = ranges(rows), leaf_numbers(shards)
    splits = grow(_placed(rows, spans), shards)
    own = metadata(id_col, text_col)
    names = {d: f"_kd_{d}" for d in DIMENSIONS}
    taken = {c.lower() for c in docs.columns}
    while any(x in taken for x in names.values()):
        names = {d: f"{x}_" for d, x in names.items()}
    named = {n: (names[d], at) for n, (d, at) in splits.items()}
    out = docs.withColumns({names[d]: coordinate(value(d, spans[d], own[d]), own["tail"]) for d in DIMENSIONS})
    out.withColumn("shard", _place(named, 1, numbers.__getitem__).cast("int")).drop(*names.values()).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
