"""Toxicity: Levenshtein automata run through a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned from labelled rows: words, and stems that stand for every word they begin, whose documents are
toxic far more often than chance has it. Its trie is walked with a word's Levenshtein automaton, which accepts entries that are
the word, and stems that are a prefix of it, with up to a given number of typing errors. Every match is weighed by
its window: quotation marks around it or a reporting word before it make it count for less. A logistic
regression over a document's matches gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certamap.llm.common import cut, table

#: Labelled rows that are learned from, about: the bound on what the fit reads.
TRAIN_ROWS = 8000
THRESHOLD = 0.7
#: A lexicon entry: least log-odds, G statistic and number of its toxic documents; shortest and longest stem.
LOG_ODDS, LEAST_G, LEAST_ROWS, LEAST_STEM, LONGEST_STEM = 1.5, 20.0, 8, 4, 12
#: Weights of a match of a word, and of a stem, with typing errors, and of one that is quoted.
TYPO, TYPO_STEM, QUOTED = 0.5, 0.1, 0.3
WINDOW = 4
#: Distinct words that a task keeps the verdict on.
KNOWN = 400_000

WORDS = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
QUOTES = frozenset("\"'“”„‟‘’‚«»‹›")
#: Fixed words that report speech, in the languages of the corpus.
REPORTING = frozenset("said says wrote writes called calls quote quoted quoting term word slur insult dit écrit mot insulte sagte schrieb nannte wort dijo escribió llamó palabra".split())


def errors_allowed(n: int) -> int:
    return 0 if n < 4 else 1 if n < 9 else 2


class Trie:
    """A lexicon of whole words and of stems (entries that end in *)."""

    def __init__(self, entries: Iterable[str]) -> None:
        root: dict = {}
        self.longest = 0
        for e in entries:
            node, bare = root, e.rstrip("*")
            self.longest = max(self.longest, len(bare))
            for c in bare:
                node = node.setdefault(c, {})
            node["*" if e.endswith("*") else "$"] = e
        self.steps = self._steps(root, 0)

    def _steps(self, node: dict, depth: int) -> tuple[str | None, str | None, int, list[tuple[str, tuple]]]:
        """(word that ends here, stem that ends here, most errors of the entries from here on, children)."""
        children = [(c, self._steps(x, depth + 1)) for c, x in node.items() if c not in "*$"]
        own = errors_allowed(depth) if "$" in node or "*" in node else 0
        return node.get("$"), node.get("*"), max([own, *(x[2] for _, x in children)]), children

    def near(self, word: str) -> tuple[str, int] | None:
        """The nearest entry and its distance, within the errors that the entry's length allows; of equally near ones a whole word, then the first in order.

        The word's Levenshtein automaton has a state for every position and number of errors, a bit each: an integer
        for no error, one and two. It reads what the trie spells; a branch ends where no state is left. A whole word is
        accepted in the last position, a stem in any. What lies further in the word than the longest entry and two errors
        can decide nothing, but that the word is too long for a whole entry.
        """
        goal = 1 << len(word) if len(word) <= self.longest + 2 else 0
        at: dict[str, int] = {}
        for i, c in enumerate(word[: self.longest + 2]):
            at[c] = at.get(c, 0) | 1 << i
        best: tuple[int, bool, str] | None = None
        stack = [(self.steps, 0, 1, 3, 7)]
        while stack:
            (whole, stem, _, children), depth, a, b, c = stack.pop()
            for entry, mask in ((whole, goal), (stem, -1)):
                if entry:
                    errors = 0 if a & mask else 1 if b & mask else 2 if c & mask else 3
                    found = (errors, entry is stem, entry)
                    if errors <= errors_allowed(depth) and (best is None or found < best):
                        best = found
            for char, child in children:
                hit = at.get(char, 0)
                x = (a & hit) << 1
                y = (b & hit) << 1 | a | a << 1 | x << 1
                z = (c & hit) << 1 | b | b << 1 | y << 1
                if x or child[2] > 0 and y or child[2] > 1 and z:
                    stack.append((child, depth + 1, x, y, z))
        return best and (best[2], best[0])


@dataclass
class Model:
    entries: list[str]
    clean: frozenset[str] = frozenset()  # misspellings that clean labelled rows have
    weights: list[float] = field(default_factory=lambda: [2.0, 2.0, 0.5, 0.5, -3.0])

    def __post_init__(self) -> None:
        self.trie, self.known = Trie(self.entries), {}

    def __getstate__(self) -> dict:
        return {"entries": self.entries, "clean": self.clean, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def match(self, word: str) -> tuple[str, int] | None:
        """(entry, errors) for a word that the lexicon has or nearly has. What clean rows have is no misspelling."""
        hit = self.trie.near(word)
        return None if hit and hit[1] and word in self.clean else hit

    def matches(self, text: str) -> tuple[int, list[tuple[str, str, int, bool]]]:
        """The number of words, and (word, entry, errors, quoted) of every match, in the order of the text."""
        low = text.lower()
        words = WORDS.findall(low)
        if len(self.known) > KNOWN:
            self.known.clear()
        known, distinct = self.known, set(words)
        for w in distinct.difference(known):
            known[w] = self.match(w)
        if not any(map(known.__getitem__, distinct)):
            return len(words), []
        out, spans = [], list(WORDS.finditer(low))
        for i, m in enumerate(spans):
            if hit := known[m[0]]:
                before, after = low[max(0, m.start() - 2) : m.start()], low[m.end() : m.end() + 2]
                quoted = any(c in QUOTES for c in before) and any(c in QUOTES for c in after)
                quoted = quoted or any(spans[j][0] in REPORTING for j in range(max(0, i - WINDOW), i))
                out.append((m[0], *hit, quoted))
        return len(words), out

    def features(self, n: int, found: list[tuple[str, str, int, bool]]) -> list[float]:
        word = sum((TYPO if e else 1.0) * (QUOTED if q else 1.0) for _, x, e, q in found if not x.endswith("*"))
        stem = sum({w: (TYPO_STEM if e else 1.0) * (QUOTED if q else 1.0) for w, x, e, q in found if x.endswith("*")}.values())  # a word counts once
        return [min(word, 1.0), math.log1p(word), math.log1p(stem), min(10.0, 100 * stem / max(n, 50))]

    def score(self, n: int, found: list[tuple[str, str, int, bool]]) -> float:
        z = sum(w * x for w, x in zip(self.weights, [*self.features(n, found), 1.0], strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str) -> Column:
    """Whether a row is held out; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _g(n_pos: int, n_neg: int) -> Column:
    """The G statistic of a term (pos, neg) against `n_pos` toxic and `n_neg` other rows."""
    pos, neg, total = F.col("pos"), F.col("neg"), n_pos + n_neg
    cells = [(pos, pos + neg, n_pos), (neg, pos + neg, n_neg), (n_pos - pos, total - pos - neg, n_pos), (n_neg - neg, total - pos - neg, n_neg)]
    return sum(F.when(a > 0, 2 * a * F.log(a * total / (row * col))).otherwise(0.0) for a, row, col in cells)


def _terms(text: str) -> Iterable[str]:
    """The words of a text, and the stems that two or more of its words share."""
    words = set(WORDS.findall(text.lower()))
    stems = Counter(w[:k] + "*" for w in words for k in range(LEAST_STEM, min(len(w), LONGEST_STEM) + 1))
    return [*words, *(s for s, n in stems.items() if n > 1)]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit lexicon and regression on about `train_rows` labelled rows outside the held-out third. Rows with a null label or text teach nothing."""
    marked = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    share = min(1.0, train_rows / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = cut(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(marked.withColumnRenamed(id_col, "_m"), F.col("_id") == F.col("_m")).select("_y", "_text").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            terms = list(pos.keys() | neg.keys())
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], names=["term", "pos", "neg"])
            pos.clear()
            neg.clear()
            return out

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (pos if y else neg).update(_terms(t))
                if len(pos) + len(neg) > KNOWN:
                    yield flush()
        yield flush()

    total = {int(r[0] > 0): r[1] for r in rows.groupBy("_y").count().collect()}
    n_pos, n_neg = total.get(1, 0), total.get(0, 0)
    if not n_pos or not n_neg:
        return Model([])
    terms = rows.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    strong = terms.where((F.col("pos") >= LEAST_ROWS) & (odds >= LOG_ODDS)).withColumn("g", F.round(_g(n_pos, n_neg), 6)).where(F.col("g") >= LEAST_G)
    # terms of LEAST_ROWS training rows each: the bound on those rows is the bound here
    ranked = sorted((-g, t.endswith("*"), -len(t), t) for t, g in strong.select("term", "g").collect())
    entries: list[str] = []
    for _, _, _, t in ranked:
        bare = t.rstrip("*")
        if not any(bare.startswith(e.rstrip("*")) or e.rstrip("*").startswith(bare) for e in entries):
            entries.append(t)
    draft = Model(entries)

    def typos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = {w for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if not y for w in set(WORDS.findall(t.lower())) if (m := draft.match(w)) and m[1]}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(got), pa.string())], names=["w"])

    clean = frozenset(r[0] for r in rows.mapInArrow(typos, "w string").distinct().collect())  # words of the training rows
    model = Model(entries, clean)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.features(*model.matches(t)) for t in b.column(1).to_pylist()]
            y = pa.array([float(v > 0) for v in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([y, *(pa.array([r[k] for r in x], pa.float64()) for k in range(4))], names=["y", "a", "b", "c", "d"])

    got = np.array(sorted(map(tuple, rows.mapInArrow(measure, "y double, a double, b double, c double, d double").collect())))
    x, y = np.column_stack([got[:, 1:], np.ones(len(got))]), got[:, 0]
    w, ridge = np.zeros(5), np.array([0.3, 0.3, 0.3, 0.3, 1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(5)
        w = w - np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
    model.weights = [float(v) for v in w]
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, matches): score in [0, 1]; matches are (word, entry, errors, quoted).

    Nulls: a null text counts as empty, a null id is carried. Repeated rows score alike; an empty table gives an empty result; other columns are ignored.
    """
    match = T.StructType([T.StructField("word", T.StringType()), T.StructField("entry", T.StringType()), T.StructField("errors", T.IntegerType()), T.StructField("quoted", T.BooleanType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("matches", T.ArrayType(match))])
    kind = pa.list_(pa.struct([("word", pa.string()), ("entry", pa.string()), ("errors", pa.int32()), ("quoted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.matches(t or "") for t in b.column(1).to_pylist()]
            found = [[dict(zip(match.names, m, strict=True)) for m in x] for _, x in got]
            scores = pa.array([model.score(n, x) for n, x in got], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), scores, pa.array(found, kind)], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
