"""Personal data with DataFrame functions only.

Regular expressions propose spans, checksum validators (Luhn, mod-97) confirm them, and words
nearby, before a span or behind it, raise or lower the score. Four base kinds are kept whatever their score; the other kinds are
added where their score reaches the threshold.

Every pattern uses possessive loops and starts only where a run starts (or where the last match
ended), so a scan is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certamap.llm.common import table

THRESHOLD = 0.6
#: Characters before a span, and after it, in which context words count; what a word of the kind adds to the score, and what one that speaks against personal data takes off.
NEAR, AFTER = 48, 24
CONTEXT_GAIN, CONTEXT_LOSS = 0.35, 0.25
AGAINST = "order|invoice|version|serial|part|item|sku|isbn|model|build"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of `x` pass the Luhn check."""
    d = F.reverse(_digits(x))

    def weighed(i: Column) -> Column:
        n = F.substr(d, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), lambda a, i: a + weighed(i)) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number passes the mod-97 check: its first four characters go to the end, letters count from 10."""
    bare = F.regexp_replace(x, " ", "")
    moved = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(moved)), F.lit(0), step) == 1


def _octets(x: Column) -> Column:
    one = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return x.rlike(rf"^{one}(?:\.{one}){{3}}$")


def _phone_digits(x: Column) -> Column:
    return F.char_length(_digits(x)).between(9, 15)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    score: float
    context: str
    base: bool = False
    needs: str | None = None  # a character without which the text has no such span


#: Characters of an account number by country, as the registry fixes them or, for some, as banks write them; country code and check digits count.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """An account number takes its country's length, so that words and numbers after it are not taken with it; other codes take what they can."""
    known = [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}+" for n, codes in IBAN_LENGTHS.items()]
    other = f"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}+"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.9, "mail|contact|write", True, "@"),
    Kind("ip", r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.6, "ip|address|host|server", True, "."),
    Kind("card", r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", luhn, 0.7, "card|visa|credit|payment", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _phone_digits, 0.7, "phone|tel|call|mobile|fax", True, "+"),
    Kind("iban", _iban(), mod97, 0.7, "iban|bank|account|transfer"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", None, 0.4, "ssn|social|security|insurance", needs="-"),
    Kind("local_phone", r"(?<![0-9+])(?<![0-9] )\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])", None, 0.4, "phone|tel|call|mobile|fax", needs="("),
)


def spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score, base>> of one kind, by start. Offsets are code points, ends exclusive."""
    rx = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, rx, F.lit(0))

    def located(m: Column) -> Column:
        def walk(gaps: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("got"))

            def step(a: Column, i: Column) -> Column:
                start = a["at"] + F.char_length(gaps[i])
                end = start + F.char_length(m[i])
                return F.struct(end.alias("at"), F.array_append(a["got"], F.struct(start.alias("start"), end.alias("end"), m[i].alias("m"))).alias("got"))

            return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), zero, step)["got"]

        return F.transform(F.array(F.split(text, kind.pattern, -1)), walk)[0]

    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    got = F.transform(F.array(matches), lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none))[0]
    if kind.needs:
        got = F.when(F.contains(text, F.lit(kind.needs)), got).otherwise(none)
    if kind.valid:
        got = F.filter(got, lambda x: kind.valid(x["m"]))

    def scored(x: Column) -> Column:
        lo = F.greatest(F.lit(0), x["start"] - NEAR)
        around = F.array(F.concat_ws("\n", F.substr(text, lo + 1, x["start"] - lo), F.substr(text, x["end"] + 1, F.lit(AFTER))))
        gain = lambda c: F.when(c.rlike(rf"(?i)\b(?:{kind.context})"), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        loss = lambda c: F.when(c.rlike(rf"(?i)\b(?:{AGAINST})"), F.lit(CONTEXT_LOSS)).otherwise(F.lit(0.0))
        score = F.transform(around, lambda c: F.round(F.least(F.lit(1.0), F.lit(kind.score) + gain(c) - loss(c)), 6))[0]
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"), F.lit(kind.base).alias("base"))

    out = F.transform(got, scored)
    return out if kind.base else F.filter(out, lambda x: x["score"] >= THRESHOLD)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): the personal data of every text, by kind as KINDS lists them, then start.

    Nulls: a null text counts as empty, a null id is carried. Repeated rows are treated alike;
    an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.select("id", F.concat(*[spans(F.col("t"), k) for k in KINDS]).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every confirmed span of the text replaced by <kind>; overlapping spans are replaced by the first of them.

    A null text stays null, an empty one empty; repeated rows are treated alike, an empty table stays empty, and other columns pass through, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    all_spans = F.sort_array(F.transform(F.concat(*[spans(text, k) for k in KINDS]), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        put = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), put.alias("out")))

    masked = F.aggregate(all_spans, zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), masked))


def joined(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    count = [of(k.name).alias(f"n_{k.name}") for k in KINDS if k.base]
    return got.select(F.col("id").alias("doc_id"), *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
