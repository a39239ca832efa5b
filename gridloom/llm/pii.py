"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their scores.

DataFrame functions only. The patterns of the four base kinds are written so that they find the same matches without
trying a run of characters again from each of its own: a local part or a number starts where its run starts or where the
last match ended, and repeats are possessive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import spans
from gridloom.llm.scratch import unused

#: Patterns by kind, the base kinds first, in the order of results.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+()-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: Words that raise a span's score when one stands shortly before it, and the score without.
CONTEXT = {
    "email": ("mail|contact|write to|reach", 0.8),
    "ip": (r"\bip\b|host|server|address|login", 0.6),
    "card": ("card|visa|credit|payment|debit", 0.7),
    "phone": ("phone|tel|call|mobile|fax", 0.7),
    "iban": ("iban|bank|account|transfer", 0.6),
    "local_phone": ("phone|tel|call|mobile|fax", 0.3),
}
NEAR = 40
BONUS = 0.25
#: Spans of the kinds beyond the base are reported from this score on; base spans always are.
REPORT = 0.5
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "array<struct<kind:string,start:bigint,end:bigint,match:string,score:double>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn check digit."""
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weighed), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (no blanks) leaves 1 when divided by 97, its first four characters moved to the end."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, (a * 10 + v - 48) % 97).otherwise((a * 100 + v - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


def find(docs: DataFrame) -> DataFrame:
    """docs with _spans (with more underscores, if docs has such a column): array of kind, start, end, match, score, by kind
    in the order of PATTERNS and then by start.

    Offsets are code points of the whole text, end exclusive; a null or empty text has no spans. Rows that repeat get
    equal spans; other columns stay as they are; an empty table gives no rows.
    """
    t = F.col("_t")
    digit = t.rlike("[0-9]")
    guards = {"email": t.contains("@"), "phone": t.contains("+"), "iban": t.rlike("[A-Z][A-Z][0-9][0-9]")}
    out = docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("_t"))
    out = out.withColumns({f"_m_{k}": spans.found(t, p, guards.get(k, digit)) for k, p in PATTERNS.items()})
    out = out.withColumns({f"_g_{k}": spans.gaps(t, F.col(f"_m_{k}"), p) for k, p in PATTERNS.items()})
    out = out.withColumns({f"_s_{k}": spans.located(F.col(f"_m_{k}"), F.col(f"_g_{k}")) for k in PATTERNS})

    def scored(kind: str) -> Column:
        words, base = CONTEXT[kind]

        def one(s: Column) -> Column:
            before = F.substring(t, F.greatest(s["start"] - NEAR + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(NEAR)).cast("int"))
            score = F.lit(base) + F.when(F.lower(before).rlike(words), BONUS).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), score.alias("score"))

        kept = F.transform(F.filter(F.col(f"_s_{kind}"), lambda s: _valid(kind, s["match"])), one)
        return (kept if kind in BASE else F.filter(kept, lambda s: s["score"] >= REPORT)).cast(SPAN)

    none = F.array().cast(SPAN)
    every = F.concat(*[F.when(F.size(f"_m_{k}") > 0, scored(k)).otherwise(none) for k in PATTERNS])
    return out.select("_row.*", every.alias(unused(docs, "_spans")[0]))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    made = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "_spans")
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("_spans", spans.of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return made.select("doc_id", *counts, F.sha2(spans.listed(base), 256).alias("base_sha256"), spans.listed(F.col("_spans")).alias("spans"))
