"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Every rule is a condition over the text. On a bounded sample of rows each rule is timed and its
rejections counted; the rules are then tried in the order of rejection per cost, and a text that one
rule rejects is not looked at by the next. The order changes what the verdict costs, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certamap.llm.common import table

LEAST_WORDS, MOST_REPEATED = 50, 50
#: Per 100 words: symbols, exclamation marks. Percent of lines that repeat. Mean characters a word.
MOST_SYMBOLS, MOST_MARKS, MOST_DUP_LINES, WORD_CHARS = 10, 30, 60, (2, 14)
SYMBOLS = "#*$%&|<>"
#: Rows that costs and selectivities are estimated on, about, and how often each is looked at to time a rule.
SAMPLE_ROWS, REPEATS = 1000, 2


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once a row."""
    return F.transform(F.array(x), f)[0]


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeat_words(w: Column) -> Column:
    """Words that lie in a window of 3 words which the text has twice or more. Windows are compared by 64-bit hashes."""

    def covered(h: Column) -> Column:
        def marked(s: Column) -> Column:
            own = lambda e, k: F.when((e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["p"])
            at = F.array_compact(F.transform(s, own))
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_with(F.sort_array(pairs), marked))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    return _with(w, lambda w: F.when(F.size(w) < 4, 0).otherwise(_with(windows(w), covered)))


def stats(text: Column) -> dict[str, Column]:
    """What the rules look at, each from the text alone."""
    text = F.coalesce(text, F.lit(""))
    w = words(text)
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(_without(text, SYMBOLS))).cast("long"),
        "n_marks": (F.char_length(text) - F.char_length(_without(text, "!"))).cast("long"),
        "n_lines": F.size(lines(text)).cast("long"),
        "n_dup_lines": _with(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(w).cast("long"),
    }


def rules(s: dict[str, Column]) -> dict[str, Column]:
    """{rule: the condition on which it rejects}, over the columns of `stats`."""
    n = s["n_words"]
    return {
        "few_words": n < LEAST_WORDS,
        "repetition": 100 * s["n_repeat_words"] > MOST_REPEATED * n,
        "symbols": 100 * s["n_symbols"] > MOST_SYMBOLS * n,
        "marks": 100 * s["n_marks"] > MOST_MARKS * n,
        "dup_lines": 100 * s["n_dup_lines"] > MOST_DUP_LINES * s["n_lines"],
        "word_length": (s["word_chars"] < WORD_CHARS[0] * n) | (s["word_chars"] > WORD_CHARS[1] * n),
    }


def order(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, repeats: int = REPEATS) -> list[str]:
    """The rules by rejection per cost on a sample: the best next rule is the one that rejects most of what is left per second.

    A rule's time is that of looking at the sample `repeats` times, after a first look that compiles it, less the time of a rule that looks at nothing.
    """
    picked = docs.select(F.col(text_col).alias("t")).sample(min(1.0, sample_rows / max(1, docs.count())), seed=11).coalesce(8).persist()
    reject = rules(stats(F.col("t")))
    again = picked.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def seconds(bad: Column) -> float:
        looked = again.select(F.count_if(bad))
        looked.first()
        began = time.perf_counter()
        looked.first()
        return time.perf_counter() - began

    try:
        idle = seconds(F.col("_again") < 0)
        cost = {name: max(1e-3, seconds(bad) - idle) for name, bad in reject.items()}
        each = [F.coalesce(bad, F.lit(False)).alias(name) for name, bad in reject.items()]
        hits = [(r[:-1], r[-1]) for r in picked.select(*each).groupBy(*reject).count().collect()]  # at most 2**6 rows
    finally:
        picked.unpersist()
    names, out = list(reject), []
    while len(out) < len(names):
        gain = lambda k: sum(c for r, c in hits if r[k] and not any(r[names.index(x)] for x in out)) / cost[names[k]]  # noqa: E731, B023
        out.append(names[max((k for k in range(len(names)) if names[k] not in out), key=lambda k: (gain(k), -cost[names[k]]))])
    return out


def cascade(s: dict[str, Column], by: list[str]) -> Column:
    """The first rule of `by` that rejects, null if none does; later rules are not evaluated then."""
    reject = rules(s)
    out = F.when(reject[by[0]], F.lit(by[0]))
    for name in by[1:]:
        out = out.when(reject[name], F.lit(name))
    return out


def judge(docs: DataFrame, text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    """`docs` with one more column `rejected_by` (string, null: kept), for reading off a filter.

    Nulls and empty texts have no words and are rejected; other columns pass through, whatever their names,
    except an existing `rejected_by`, which is replaced. Repeated rows are judged alike; an empty table stays empty.
    """
    return docs.withColumn("rejected_by", cascade(stats(F.col(text_col)), by or order(docs, text_col)))


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    """Every row's statistics and verdict: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    The verdict comes from the cascade: what only rules look at (exclamation marks) is not counted where a rule before has rejected, nor where
    the base rules have. Nulls: a null text has no words, a null id is carried. Repeated rows are judged alike; an
    empty table gives an empty result; other columns are ignored.
    """
    by = by or order(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # one pass: words and lines are materialised once, the statistics are read off them
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), words(text).alias("w"), lines(text).alias("l"))
    got = rows.select(
        "id",
        "t",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    s = {c: F.col(c) for c in got.columns[2:]} | {"n_marks": stats(F.col("t"))["n_marks"]}
    reject = rules(s)
    failed = reject["few_words"] | reject["repetition"]
    kept = F.when(failed, F.lit(False)).otherwise(cascade(s, [k for k in by if k not in ("few_words", "repetition")]).isNull())
    return got.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM win, (SELECT unnest(range(0, 3)) AS k) WHERE c > 1 GROUP BY rid),
s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_marks, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 100 * n_symbols > {MOST_SYMBOLS} * n_words AND NOT 100 * n_marks > {MOST_MARKS} * n_words
  AND NOT 100 * n_dup_lines > {MOST_DUP_LINES} * n_lines
  AND NOT word_chars < {WORD_CHARS[0]} * n_words AND NOT word_chars > {WORD_CHARS[1]} * n_words AS kept
FROM b"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts are rejected, rows that are repeated are judged alike, an empty table stays empty; columns may have any names."""
    return docs.where(cascade(stats(F.col("text")), order(docs)).isNull())
