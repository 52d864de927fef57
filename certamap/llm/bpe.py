"""Byte-level BPE, encoding and decoding.

A word is a row of bytes; folding the ranked merges over it replaces, again and again, the adjacent pair of the lowest
rank by its merged token. Every distinct word that a task meets is folded once; documents are put
together from their words. Decoding concatenates the tokens' binary pieces.

Two forms give the same ids. `encode` runs in Arrow batches and is what the query and the pipeline use.
`encode_native` folds with Spark's higher-order functions over a literal rank map, hashed
into buckets; the README has its figures, which are beyond the limits for a whole corpus.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import pickle
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certamap.llm.common import cut, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct words that a task keeps ready; beyond it starts anew. From this many bytes a word is folded over a heap.
READY_WORDS, LONG = 200_000, 64
BUCKETS = 1 << 17
_A = 40_503  # spreads pairs over buckets


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def ranks_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def pieces(text: Column) -> Column:
    """The matches of the tokenizer's pattern. (?U): \\s is Unicode white space, as in the tokenizer's own engine."""
    return F.regexp_extract_all(text, F.lit("(?U)" + public_tokenizers.PATTERN), F.lit(0))


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(x), f)[0]


@functools.cache
def _merge_json(path: str) -> str:
    ranks = load_ranks(path)
    out: dict[int, list[int]] = {}
    for piece, new in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                out.setdefault((a * _A + b) % BUCKETS, []).append((a << 32) + (b << 16) + new)
    return json.dumps([out.get(i, []) for i in range(BUCKETS)], separators=(",", ":"))


def merged(rank_map: Column) -> Callable[[Column, Column], Column]:
    """(left id, right id) -> the id of their concatenation, which is its rank; null if the rank map has none."""

    def look_up(a: Column, b: Column) -> Column:
        a = a.cast("long")
        hit = F.filter(rank_map[F.pmod(a * _A + b, F.lit(BUCKETS)).cast("int")], lambda x: F.shiftright(x, 16) == a * 65536 + b)
        return F.get(hit, F.lit(0)).bitwiseAND(F.lit(65535)).cast("int")

    return look_up


def fold(word: Column, path: str) -> Column:
    """array<int>: the token ids of one word, by folding ranked merges over its bytes."""
    ranks = load_ranks(path)
    single = F.lit([ranks[bytes([i])] for i in range(256)])
    rank_map = F.from_json(F.lit(_merge_json(path)), "array<array<bigint>>")  # a constant: the optimizer parses it once
    return _with(rank_map, lambda m: _fold(word, single, merged(m)))


def _fold(word: Column, single: Column, look_up: Callable[[Column, Column], Column]) -> Column:
    byte = lambda b, i: single[F.conv(F.hex(F.substr(b, i, F.lit(1))), 16, 10).cast("int")]

    def start(b: Column) -> Column:
        ids = F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: byte(b, i))
        return _with(ids, lambda x: F.struct(x.alias("ids"), F.transform(F.sequence(F.lit(0), F.size(x) - 2), lambda i: look_up(x[i], x[i + 1])).alias("ranks")))

    def step(s: Column, _: Column) -> Column:
        def merge(new: Column) -> Column:
            def at(p: Column) -> Column:  # 1-based: the pair of ids p and p + 1
                ids, rk = s["ids"], s["ranks"]
                n = F.size(ids)
                left = F.when(p > 1, F.concat(F.slice(rk, F.lit(1), p - 2), F.array(look_up(F.get(ids, p - 2), new)))).otherwise(F.array().cast("array<int>"))
                right = F.when(p < n - 1, F.concat(F.array(look_up(new, F.get(ids, p + 1))), F.slice(rk, p + 2, n))).otherwise(F.array().cast("array<int>"))
                joined = F.concat(F.slice(ids, F.lit(1), p - 1), F.array(new), F.slice(ids, p + 2, n))
                return F.struct(joined.alias("ids"), F.concat(left, right).alias("ranks"))

            return F.when(new.isNull(), s).otherwise(_with(F.array_position(s["ranks"], new).cast("int"), at))

        return _with(F.array_min(s["ranks"]), merge)

    def several(b: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(2), F.octet_length(b)), start(b), step)["ids"]

    return _with(F.encode(word, "UTF-8"), lambda b: F.when(F.octet_length(b) == 1, F.array(byte(b, F.lit(1)))).otherwise(several(b)))


def encode_native(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) by higher-order functions alone: the distinct words of the table are folded, and joined back to their places."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")))
    places = cut(rows.select("row", "id", F.posexplode_outer(pieces(F.col("t"))).alias("at", "w")))
    ranks = load_ranks(path)
    words = places.where("w is not null").select("w").distinct()
    known = docs.sparkSession.createDataFrame([(b, i) for b, i in ranks.items()], "b binary, token int")  # bounded: the vocabulary
    folded = words.join(F.broadcast(known), F.encode("w", "UTF-8") == F.col("b"), "left").select("w", F.when(F.col("token").isNotNull(), F.array("token")).otherwise(fold(F.col("w"), path)).alias("t"))
    joined = places.join(folded.withColumnRenamed("w", "v"), F.col("w") == F.col("v"), "left")
    put = F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("at", "t")))), lambda x: x["t"])
    return joined.groupBy("row", "id").agg(F.flatten(put).alias("ids")).select("id", "ids")


#: The rank of a pair that merges into nothing.
_NONE = 1 << 62


def fold_bytes(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The token ids of one word."""
    if word in ranks:
        return (ranks[word],)
    if len(word) >= LONG:
        return _fold_long(word, ranks)
    parts, look = [word[i : i + 1] for i in range(len(word))], ranks.get
    open_ranks = [look(word[i : i + 2], _NONE) for i in range(len(word) - 1)]  # of every pair of neighbours
    while open_ranks and (best := min(open_ranks)) != _NONE:
        at = open_ranks.index(best)
        parts[at] += parts.pop(at + 1)
        open_ranks.pop(at)
        if at < len(open_ranks):
            open_ranks[at] = look(parts[at] + parts[at + 1], _NONE)
        if at:
            open_ranks[at - 1] = look(parts[at - 1] + parts[at], _NONE)
    return tuple(ranks[p] for p in parts)


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same merges over a heap of (rank, position), for words whose square is too large."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i; end[i] = 0: no part starts there
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(word[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return tuple(out)


#: The tokenizer's pattern for texts of ASCII characters only: the same matches, with its classes written out.
_ASCII = re.compile(r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")


class Coder:
    """Encodes and decodes texts by one rank map, keeping the words it has met."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.known = ranks, {}
        self.any = regex.compile(public_tokenizers.PATTERN)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece
        self.names = [str(i) for i in range(len(self.bytes))]

    def encode(self, text: str) -> list[int]:
        words = (_ASCII if text.isascii() else self.any).findall(text)
        if len(self.known) > READY_WORDS:
            self.known.clear()
        known, ranks = self.known, self.ranks
        for w in set(words).difference(known):
            known[w] = fold_bytes(w.encode(), ranks)
        return list(chain.from_iterable(map(known.__getitem__, words)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def line(self, ids: Iterable[int]) -> str:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))


def _coder(compressed: bytes) -> Coder:
    """A task's coder; the ranks come with the task, so no file has to be on the executors."""
    return Coder(pickle.loads(zlib.decompress(compressed)))


def _packed(path: str) -> bytes:
    return zlib.compress(pickle.dumps(load_ranks(path)))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids (array<int>) of every text, without special tokens.

    Nulls: a null text counts as empty and has no ids, a null id is carried. Repeated rows are treated
    alike; an empty table gives an empty result; other columns are ignored.
    """
    packed = _packed(path or ranks_path())
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(packed)
        for b in batches:
            ids = [coder.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the concatenated pieces of every row's ids; null for null ids."""
    packed = _packed(path or ranks_path())
    schema = T.StructType([T.StructField("id", tokens.schema[id_col].dataType), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(packed)
        for b in batches:
            got = [None if x is None else coder.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["id", "bytes"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): `encode` and `decode` of every text in one pass, of which only digests leave the task."""
    packed = _packed(path or ranks_path())
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(packed)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids = coder.encode(t or "")
                rows.append((len(ids), hashlib.sha256(coder.line(ids).encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            n, coded, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids_sha256, decoded_sha256) of every document. Null and empty texts have no tokens, null ids and sources are carried, repeated rows stay repeated, an empty table gives an empty result; other columns are ignored."""
    return round_trip(docs.select(F.struct("doc_id", "source").alias("key"), "text"), id_col="key").select("id.*", "n_tokens", "ids_sha256", "decoded_sha256")
