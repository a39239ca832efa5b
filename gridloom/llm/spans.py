"""Regular-expression matches with code-point offsets, from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def running(xs: Column) -> Column:
    """Inclusive prefix sums of an array of longs, by blocks: about n * BLOCK + (n / BLOCK)^2 steps."""
    n = F.size(xs)
    blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int")), lambda b: F.struct(b.alias("b"), _sum(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))).alias("s")))
    sums = F.transform(blocks, lambda b: b["s"])

    def block(b: Column) -> Column:
        before = _sum(F.slice(sums, F.lit(1), b["b"]))
        own = F.slice(xs, b["b"] * BLOCK + 1, F.lit(BLOCK))
        return F.transform(own, lambda _, i: before + _sum(F.slice(own, F.lit(1), i + 1)))

    return F.when(n > 0, F.flatten(F.transform(blocks, block))).otherwise(F.array().cast("array<bigint>"))


def found(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches; none where the guard does not hold."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return m if guard is None else F.when(guard, m).otherwise(F.array().cast("array<string>"))


def gaps(text: Column, matches: Column, pattern: str) -> Column:
    """Lengths of what lies between the matches; null where there are none. No match may be empty."""
    return F.when(F.size(matches) > 0, F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long")))


def located(matches: Column, between: Column) -> Column:
    """array<struct<start,end,match>>, end exclusive, in code points."""
    steps = F.transform(matches, lambda _, i: F.element_at(between, i + 1) + F.when(i > 0, F.length(F.element_at(matches, F.greatest(i, F.lit(1))))).otherwise(0))
    starts = running(steps)
    made = F.zip_with(matches, starts, lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))
    return F.when(F.size(matches) > 0, made).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>"))


def of_kind(kind: str):
    """Predicate of spans of one kind."""
    return lambda s: s["kind"] == kind


def listed(found_: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
