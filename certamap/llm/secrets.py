"""Secret scan: patterns find the base kinds, a character convolutional network judges every candidate.

Candidates are the base spans (of an assignment, the value), every run of 12 or more characters that keys are made of which is
not a plain word, and every value of 8 or more that is assigned to any name. The network sees a candidate
with its surroundings, a long one in overlapping windows of which the highest counts. Base spans stay whatever it
says and carry its score; another candidate is added as kind `net` if it scores at or above the
calibrated, recall-constrained threshold.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certamap.llm.common import table
from certamap.llm.secret_net import Net, trained

KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: What a candidate has and a plain word has not: a digit, an inner capital, an inner symbol, or 20 letters on end.
UNLIKE_WORD = re.compile(r"[0-9]|[a-z][A-Z]|[A-Za-z][+/_=-]+[A-Za-z]|[A-Za-z]{20}")
VALUE = re.compile(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""")
#: Words one of which an assignment has; a text without them is not searched.
ASKED = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[int, int, int, float]  # start, index of the kind, end, score


def base_matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, index of the kind, end, start of what is secret in it), by start, then kind."""
    low = text.lower()
    out = []
    if any(x in low for x in ASKED):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The further candidates by start, without those that overlap what is `taken`; of two that overlap, the run."""
    runs = []
    for m in CANDIDATE.finditer(text):
        body = m[0].rstrip(".-_")
        if len(body) >= 12 and UNLIKE_WORD.search(body):
            runs.append((m.start(), m.start() + len(body)))
    values = []
    if "=" in text or ":" in text:
        for m in VALUE.finditer(text):
            body = m[1].rstrip(".-_")
            before = text[max(0, m.start() - 3) : m.start()].rstrip(" ").rstrip("\"'")
            if len(body) >= 8 and before and (before[-1].isalnum() or before[-1] == "_"):
                values.append((m.start(1), m.start(1) + len(body)))
    out: list[tuple[int, int]] = []
    for more in (runs, values):
        held = sorted(taken + out)
        ends = list(accumulate((e for _, e in held), max))
        for s, e in more:
            k = bisect_left(held, (e, 0))  # the spans that start before this one ends
            if not k or ends[k - 1] <= s:
                out.append((s, e))
    return sorted(out)


def scan(texts: list[str | None], net: Net) -> list[list[Span]]:
    """The spans of every text, by start, then kind."""
    base = [base_matches(t or "") for t in texts]
    jobs = [(i, k, s, e, body) for i, x in enumerate(base) for s, k, e, body in x]
    jobs += [(i, 3, s, e, s) for i, t in enumerate(texts) if t for s, e in candidates(t, [(s, e) for s, _, e, _ in base[i]])]
    out: list[list[Span]] = [[] for _ in texts]
    for (i, k, s, e, _), p in zip(jobs, net.best([(texts[i], body, e) for i, _, _, e, body in jobs]).tolist(), strict=True):
        if k < 3 or p >= net.threshold:
            out[i].append((s, k, e, p))
    return [sorted(x) for x in out]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Net | None = None) -> DataFrame:
    """(id, spans): array of (kind, start, end, score, base) by start, then kind; offsets are code points, ends exclusive; the score is the network's.

    Nulls: a null text counts as empty, a null id is carried. Repeated rows are treated alike;
    an empty table gives an empty result; other columns are ignored.
    """
    net = net or trained()
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = scan(b.column(1).to_pylist(), net)
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "score": p, "base": k < 3} for s, k, e, p in x] for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _ARROW)], names=["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """`text` with every span replaced by <secret>; spans that overlap become one."""
    out, at = [], 0
    for s, _, e, _ in spans:
        if s >= at:
            out += [text[at:s], "<secret>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", net: Net | None = None) -> DataFrame:
    """`docs` with the secrets of the text replaced; null and empty texts and other columns, whatever their names, pass through, repeated rows are treated alike, an empty table stays empty."""
    net = net or trained()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [redacted(t, s) if s else t for t, s in zip(texts, scan(texts, net), strict=True)]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(table(spark, sf_dir, "documents"))
    of = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter("spans", lambda s: s["base"])
    return got.select(F.col("id").alias("doc_id"), *(of(k) for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), of("net"), F.transform(base, lambda s: F.round(s["score"], 3)).alias("base_scores"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced and `n_chars` counted anew where the table has it.

    Null texts stay null and keep their `n_chars`, empty ones stay empty; repeated rows are treated alike, an empty table stays empty, and other columns pass through, whatever their names.
    """
    out = redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
