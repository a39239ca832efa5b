"""Secret scans: patterns for known forms, and a battery of randomness tests for the unknown ones.

DataFrame functions only. A candidate is an unbroken run of 20 or more letters, digits and +/_- that has a letter and mixes
digits with letters or has capitals inside; runs of small letters alone, which words are, are none. Its characters say which encoding it would be in (hexadecimal, base 32, base 64), and under
"these are random symbols of that encoding" three tests give p-values: chi-squared uniformity of the whole alphabet, whose
statistic is scaled to its exact mean and variance for the run's length, as most symbols of a large alphabet are expected
less than once; runs above and below the middle; and serial correlation of neighbours. The least of three is turned into one
p-value, uniform for random runs. Structured text has small ones. What is reported is what has a p-value over a bound, which
is the least one at which at most ALARM of what is reported is expected to be structured: random runs are counted by those
with p-values near 1, spread evenly, and what is beyond their number are false alarms. Each class of lengths has a bound of
its own, as short runs give the tests little power. The rule reads a histogram of p-values over the whole corpus, of fixed
size for each class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import spans
from gridloom.llm.scratch import Scratch

#: The base patterns in the order of results.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*(?:[0-9]|[a-z][A-Z]))(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}+"
LEAST_VALUE = 6
#: Expected share of structured candidates among those reported, and the classes of lengths: below 24, 32, 48, 64, and longer.
ALARM = 0.05
#: Candidates with p-values over 10^(-EVEN / 10) count as random.
EVEN = 4
LENGTHS = (24, 32, 48, 64)
#: Steps of a histogram, in tenths of -log10 p.
STEPS = 300
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _tail(z: Column) -> Column:
    """Two-sided normal tail of |z|, by a rational approximation whose error is below 1.2e-7 relative."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.5 * x)
    #: Chebyshev coefficients of the complementary error function.
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x - 1.26551223 + t * poly)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _cells(values: Column, n: Column, size: int) -> Column:
    """Chi-squared of the counts of equal shares."""
    share = n / F.lit(float(size))
    count = lambda v: F.size(F.filter(values, lambda x: x == v)).cast("double")
    return _total(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda v: F.pow(count(v) - share, F.lit(2.0)) / share))


def _least_of_three(p: Column) -> Column:
    """The chance that the least of three p-values is at most p; 3 p where that is exact enough."""
    return F.when(p < 1e-6, 3 * p).otherwise(1 - F.pow(1 - F.least(p, F.lit(1.0)), F.lit(3.0)))


def battery(tokens: Column) -> Column:
    """array<struct<start,end,n,p>> of an array of spans with start, end, match."""
    #: The alphabets in order.
    hexa, b32, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def read(s: Column) -> Column:
        size = F.when(s["match"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16).when(s["match"].rlike("^[A-Z2-7]+$"), 32).otherwise(64)
        alphabet = F.when(size == 16, hexa).when(size == 32, b32).otherwise(b64)
        plain = F.when(size == 16, F.lower(s["match"])).otherwise(F.translate(s["match"], "-_", "+/"))
        values = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), size.alias("size"), F.size(values).cast("double").alias("n"), values.alias("values"))

    def measure(s: Column) -> Column:
        v, n, half = s["values"], s["n"], s["size"] / 2
        # the statistic's mean is size - 1 and its variance 2 (size - 1) (n - 1) / n: a scaled chi-squared of these degrees of freedom
        chi = F.when(s["size"] == 16, _cells(v, n, 16)).when(s["size"] == 32, _cells(v, n, 32)).otherwise(_cells(v, n, 64)) * n / (n - 1)
        free = (s["size"] - 1) * n / (n - 1)
        pairs = F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("a"), F.slice(v, F.lit(2), F.size(v) - 1).alias("b"))
        mean = _total(v) / n
        high = F.size(F.filter(v, lambda x: x >= half)).cast("double")
        runs = F.size(F.filter(pairs, lambda q: (q["a"] >= half) != (q["b"] >= half))) + 1.0
        spread = _total(F.transform(v, lambda x: F.pow(x - mean, F.lit(2.0))))
        lag = _total(F.transform(pairs, lambda q: (q["a"] - mean) * (q["b"] - mean)))
        return F.struct(s["start"], s["end"], n.alias("n"), chi.alias("chi"), free.alias("free"), high.alias("high"), runs.alias("runs"), F.try_divide(lag, spread).alias("lag"))

    def judge(s: Column) -> Column:
        n, v = s["n"], 2.0 / (9.0 * s["free"])
        chi = (F.pow(s["chi"] / s["free"], F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)
        mean = 2 * s["high"] * (n - s["high"]) / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.try_divide(s["runs"] - mean, F.sqrt(F.greatest(variance, F.lit(0.0))))
        lag = s["lag"] * F.sqrt(n)
        worst = F.greatest(F.abs(F.coalesce(runs, F.lit(40.0))), F.abs(F.coalesce(lag, F.lit(40.0))), F.abs(chi))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), n.alias("n"), _least_of_three(_tail(F.least(worst, F.lit(30.0)))).alias("p"))

    return F.transform(F.transform(F.transform(tokens, read), measure), judge)


def _step(p: Column) -> Column:
    return F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(STEPS)).cast("int")


def _length_class(n: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for k in reversed(range(len(LENGTHS))):
        out = F.when(n < LENGTHS[k], k).otherwise(out)
    return out


def acceptance(candidates: DataFrame) -> DataFrame:
    """One row, steps: map of length class to the greatest histogram step (the least p-values) that is reported.

    candidates: length, step. Up to a step of p-value t there are as many random candidates as EVEN steps tell, times 1 - t;
    classes in which no step keeps to ALARM are absent.
    """
    counts = candidates.groupBy("length", "step").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("length").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    even = F.sum(F.when(F.col("step") < EVEN, F.col("n")).otherwise(0)).over(Window.partitionBy("length")) / (1 - 10 ** (-EVEN / 10))
    ranked = counts.withColumns({"upto": F.sum("n").over(up), "random": even})
    genuine = F.col("random") * (1 - F.pow(F.lit(10.0), -(F.col("step") + 1) / 10.0))
    greatest = ranked.filter(F.col("upto") - genuine <= ALARM * F.col("upto")).groupBy("length").agg(F.max("step").alias("step"))
    return greatest.agg(F.map_from_entries(F.collect_list(F.struct("length", "step"))).alias("steps"))


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of kind, start, end, by start and then kind; kinds are the base ones and random.

    One row for each row of docs. Offsets are code points of the whole text, end exclusive. A null or empty text has no
    spans; a candidate that overlaps a base span is not reported again. Rows that repeat get equal spans. Other columns
    are not read; an empty table gives no rows.
    """
    tmp = Scratch(spark, "secrets")
    t = F.col("text")
    made = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    patterns = PATTERNS | {"random": CANDIDATE}
    guards = {"assign": t.contains("=") | t.contains(":"), "access": t.contains("AKIA")}
    made = made.withColumns({f"m_{k}": spans.found(t, p, guards.get(k)) for k, p in patterns.items()})
    made = made.withColumns({f"g_{k}": spans.gaps(t, F.col(f"m_{k}"), p) for k, p in patterns.items()})
    made = made.withColumns({f"s_{k}": spans.located(F.col(f"m_{k}"), F.col(f"g_{k}")) for k in patterns})
    valid = {"assign": lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= LEAST_VALUE}
    kinds = list(PATTERNS)
    ranked = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"))
    base = F.concat(*[F.transform(F.filter(F.col(f"s_{k}"), valid[k]) if k in valid else F.col(f"s_{k}"), ranked(i)) for i, k in enumerate(kinds)])
    tested = F.when(F.size("s_random") > 0, battery(F.col("s_random")))
    found = tmp.save(made.select("doc_id", F.array_sort(base).alias("base"), tested.alias("tested")), "found")
    one = found.select(F.explode("tested").alias("c")).select(_length_class(F.col("c.n")).alias("length"), _step(F.col("c.p")).alias("step"))
    found = found.withColumn("accept", acceptance(one).scalar())

    def stays(c: Column) -> Column:
        most = F.try_element_at(F.col("accept"), _length_class(c["n"]))
        apart = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return F.coalesce(_step(c["p"]) <= most, F.lit(False)) & apart

    random = F.transform(F.filter(F.coalesce("tested", F.array().cast("array<struct<start:bigint,end:bigint,n:double,p:double>>")), stays), ranked(len(kinds)))
    names = F.array(*[F.lit(k) for k in [*kinds, "random"]])
    every = F.transform(F.array_sort(F.concat(F.col("base"), random)), lambda s: F.struct(F.element_at(names, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", every.cast(SPAN).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    made = find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [F.size(F.filter("spans", spans.of_kind(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return made.select("doc_id", *counts, F.sha2(spans.listed(base), 256).alias("base_sha256"), spans.listed(F.col("spans")).alias("spans"))
