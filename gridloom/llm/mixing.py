"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source every word has the same expected number of copies, rate = target / source size. Documents are put in an
order, their expected copies are summed along it from one offset drawn for the source, and a document is emitted once for
each integer that its stretch crosses. As the rate is the same for all of a source's documents, the prefix sum at the
j-th of them is rate * j, so that only a rank is needed. Ranks come from two levels, the sizes of (source, size class,
slice) cells and row numbers within a cell: no task ever holds a whole source. Size classes come in order of size, so
what a source yields differs from its target by about one document at most, and not by the spread of their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a cell, about.
CELL = 512
#: No source gives more than this many times its size.
MOST = 3


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a string."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights 1, 2, 3, repeating, by code point, null last.

    All sizes are shared by weight; a target stops at MOST times its source's size, and what is above is shared among the
    others by weight until none is above. That ends at one water level: sources are capped in order of size / weight, and
    the level is what is left after the caps by the weight that is left. It has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (((F.row_number().over(by_name) - 1) % 3) + 1).cast("double"))
    w = w.withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - F.col("capped")) / F.col("open"))
    # the level rises along the order for as long as sources are capped below it, and falls after that
    w = w.withColumn("water", F.max("level").over(everything))
    return w.select("source", "source_size", F.least(F.col("cap"), F.col("water") * F.col("weight")).alias("target"))


def copies(spark: SparkSession, docs: DataFrame, seed: str = "mix", carried: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (and a column carried along): how often systematic sampling emits each document.

    A null text has size 0; a null source is a source; rows that repeat are documents of their own; documents of size 0
    take part and may be emitted, which takes no words. An empty table gives no rows. Equal input gives equal rows: the
    order within a cell is by an MD5 of doc_id and text, then doc_id, then size, and rows equal in all of these are
    interchangeable. Texts count in it so that rows without an id, or with one id for many, are spread over cells too.
    """
    tmp = Scratch(spark, "mix")
    more = [carried] if carried else []
    dice = unit(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    sized = tmp.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), dice.alias("dice"), *more), "sizes")
    sized = sized.withColumn("class", F.expr("IF(length(bin(size)) <= 5, size, length(bin(size)) * 32 + shiftright(size, length(bin(size)) - 5))"))
    classes = sized.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    sources = targets(classes.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")))
    slices = classes.select("source", "class", F.ceil(F.col("n") / CELL).cast("int").alias("slices"))
    same = lambda a, b, *more: [a[c].eqNullSafe(b[c]) for c in ("source", *more)]
    cut = sized.join(slices, same(sized, slices, "class"), "left").select(sized["*"], F.floor(sized["dice"] * slices["slices"]).cast("int").alias("slice"))
    cut = tmp.save(cut, "cut")
    cells = cut.groupBy("source", "class", "slice").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    cells = cells.join(sources, same(cells, sources)).select(cells["*"], sources["source_size"], sources["target"])
    inside = Window.partitionBy("source", "class", "slice").orderBy("dice", "doc_id", "size")
    ranked = cut.withColumn("rank", F.row_number().over(inside))
    at = ranked.join(cells, same(ranked, cells, "class", "slice")).select(ranked["doc_id"], ranked["source"], ranked["size"], cells["source_size"], cells["target"], (ranked["rank"] + cells["before"]).alias("j"), *[ranked[c] for c in more])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))))
    up = F.floor(rate * F.col("j") + offset) - F.floor(rate * (F.col("j") - 1) + offset)
    return tmp.finish(at.withColumn("copies", F.least(up, F.lit(MOST)).cast("long")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and its source's target."""
    c = copies(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return c.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(spark: SparkSession, docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents that the mix emits, with copy_no from 1: a document that is emitted twice has two rows.

    Rows are numbered in a written table, and what is emitted is joined by number, so that nothing is ranked or joined by an id
    that many rows may share. All columns stay; where docs has a copy_no, as when a mix is mixed, the new one is _copy_no.
    """
    tmp = Scratch(spark, "mixed")
    number, row, copies_ = unused(docs, "copy_no", "row", "copies")
    rows = tmp.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = copies(spark, rows.select("doc_id", "source", "text", F.col(row).alias("mixed_row")), seed, "mixed_row")
    taken = taken.filter("copies > 0").select(F.col("mixed_row").alias(row), F.col("copies").cast("int").alias(copies_))
    # what is emitted grows with the documents, so it is never broadcast
    return rows.join(taken.hint("merge"), row).select(*[F.col(f"`{x}`") for x in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies_))).alias(number))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS th FROM documents
), e AS (
  SELECT *, length(bin(size)) AS bits, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || th), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS dice FROM d
), f AS (
  SELECT *, CASE WHEN bits <= 5 THEN size ELSE bits * 32 + (size >> (bits - 5)) END AS class FROM e
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM f GROUP BY source
), w AS (
  SELECT *, (((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1)::DOUBLE AS weight, {MOST}.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER o1, 0.0::DOUBLE)) / sum(weight) OVER o2 AS level FROM w
  WINDOW o1 AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         o2 AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l
), r AS (
  SELECT f.doc_id, f.source, f.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY f.source ORDER BY f.class, f.dice, f.doc_id, f.size) AS j
  FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || coalesce('s' || source, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u FROM r
)
SELECT doc_id, size, source_size, target, (least(floor(rate * j + u) - floor(rate * (j - 1) + u), {MOST}) * size)::BIGINT AS taken FROM q
"""
