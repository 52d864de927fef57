"""Certainty scores and labels as columns. All stay in generated code but the text similarity of long strings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certamap.functions import dictionaries as D


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column; Spark's comparisons and averages tell the two apart."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def look_up(code: Column, values: Mapping, default) -> Column:
    """The dictionary's value for a code; `default` for null and unknown codes."""
    entries = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), code.cast("int")), F.lit(default))


def lci(method: Column, weights: Mapping[int, float] | None = None) -> Column:
    """Locating certainty from the coordinate method."""
    return look_up(method, weights or D.METHOD_WEIGHTS, 0.1)


def present(c: Column) -> Column:
    return c.isNotNull() & ~F.coalesce(c.cast("string").rlike(r"(?U)^\s*$"), F.lit(False))


def completeness(df: DataFrame, weights: Mapping[str, float] | None = None) -> Column:
    """Weighted share of the fields that are filled in. A field that `df` lacks counts as empty and keeps its weight."""
    weights = weights or D.FIELD_WEIGHTS
    have = {c.lower(): c for c in df.columns}
    got = [F.when(present(F.col(have[f.lower()])), w).otherwise(0.0) for f, w in weights.items() if f.lower() in have]
    return sum(got, F.lit(0.0)) / F.lit(float(sum(weights.values())))


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """`x` within [lo, hi]; null stays null, which greatest and least alone would not see to."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def mci(distance: Column, similarity: Column, most: float = D.SEARCH_RADIUS, alpha: float = D.ALPHA) -> Column:
    """Matching certainty from distance and text similarity (0 to 100)."""
    return alpha * clip(similarity.cast("double") / 100) + (1 - alpha) * clip(1 - distance / most)


def vertical(df: DataFrame, kind: str = "cod_tipo_especi", complement: str = "complemento") -> Column:
    out = F.lit(False)
    if kind in df.columns:
        out = out | F.coalesce(F.col(kind) == 103, F.lit(False))
    if complement in df.columns:
        out = out | F.coalesce(F.col(complement).rlike(f"(?iu){D.VERTICAL_WORDS}"), F.lit(False))
    return out


def pci(df: DataFrame, kind: str = "cod_tipo_especi", complement: str = "complemento", stacked: float = 0.5, flat: float = 1.0) -> Column:
    """Positional certainty: lower where several addresses share a building."""
    return F.when(vertical(df, kind, complement), F.lit(stacked)).otherwise(F.lit(flat))


def gci(a: Column, b: Column, c: Column) -> Column:
    """Overall certainty: the product; null if any is."""
    return a * b * c


def score(df: DataFrame) -> DataFrame:
    """`df` with completude, lci, mci, pci and gci."""
    df = df.withColumns({"completude": completeness(df), "lci": lci(F.col("nv_geo_coord")), "mci": mci(F.col("match_distance"), F.col("textual_sim")), "pci": pci(df)})
    return df.withColumn("gci", gci(F.col("lci"), F.col("mci"), F.col("pci")))


def labels(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "especie_label": look_up(F.col("cod_especie"), D.KIND_LABELS, "Desconhecido"),
            "tipo_resid_label": look_up(F.col("cod_tipo_especi"), D.RESIDENCE_LABELS, "N/A"),
            "nv_geo_label": look_up(F.col("nv_geo_coord"), D.METHOD_LABELS, "Desconhecido"),
        }
    )


def category(kind: Column) -> Column:
    return look_up(kind, D.CATEGORY_OF_KIND, "Outros")


def land_use_class(use: Column) -> Column:
    """Class of a land-use text; the first rule wins, no text or no keyword is 'Outros'."""
    out = F.when(F.lit(False), F.lit(""))
    for name, words in D.LAND_USE_RULES:
        out = out.when(F.upper(use).rlike(words), F.lit(name))
    return out.otherwise(F.lit("Outros"))


def token_sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")), " ")


def text_similarity(a: Column, b: Column) -> Column:
    """Token-sort ratio, 0 to 100: twice the longest common subsequence over both lengths. Null on either side gives 0, two empty texts 100."""
    pair = F.struct(token_sorted(a).alias("a"), token_sorted(b).alias("b"))

    def ratio(p: Column) -> Column:
        x, y = p["a"], p["b"]
        n, m = F.char_length(x), F.char_length(y)
        zeros = F.array_repeat(F.lit(0), m + 1)

        def row(before: Column, i: Column) -> Column:  # one row of the table, as [.., last] grown over y
            def cell(now: Column, j: Column) -> Column:
                same = F.substr(x, i, F.lit(1)) == F.substr(y, j, F.lit(1))
                return F.array_append(now, F.when(same, before[j - 1] + 1).otherwise(F.greatest(before[j], F.element_at(now, -1))))

            return F.aggregate(F.sequence(F.lit(1), m), F.array(F.lit(0)), cell)

        lcs = F.when((n == 0) | (m == 0), 0).otherwise(F.element_at(F.aggregate(F.sequence(F.lit(1), n), zeros, row), -1))
        return F.when(n + m == 0, 100.0).otherwise(200.0 * lcs / (n + m))

    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.transform(F.array(pair), ratio)[0])
