"""Near-duplicate line removal by an exact set-similarity join, with DataFrame functions only.

A line is the set of its lower-cased words. Words are ordered by rarity, so that two sets whose Jaccard similarity reaches
0.8 must share a word among the first few of each (the prefix). Rarity is counted over the whole corpus in a table of
SLOTS counters that words are hashed to, on a scale of logarithms; the order is the same for all lines, which is all that
exactness asks of it. Where the shared word is not rare, its counter over RARE, the pair must also share a second one of a
prefix that is one longer, so the join key is the pair of words and no list of lines under a key grows with the corpus for
being common. Under a key, lengths, positions and parity sketches of the sets (64 bits, 128 from WIDE words on) rule out
most pairs, and the rest are verified on the words themselves. Equal sets are one class from the start; sets are equal if
two 64-bit digests of their words' hashes are.

A line goes if an earlier one (by doc_id, then the text's hash, then line number) is similar, whether that one goes or
stays. One earlier line is enough, so there are two rounds. In the first, classes are keyed by a few pairs of successive
words of their prefix, and each is compared with its key's earliest class alone, which settles most of what has near copies
with one pair each. In the second, those that are left are compared with all that come earlier under their prefix keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch, unused

#: Counters of words; they are kept as one array in every task.
SLOTS = 1 << 20
#: Words up to this count are keys alone.
RARE = 8000
#: Pairs of successive words that the first round keys a class by, from the rarest on and from the first over FAMILY on.
LEADS, FAMILY = 3, 1000
#: Sets over this size have a second sketch.
WIDE = 48
#: Sets from this size on are also joined by single words among themselves, and from the next size on only so.
LONG, LONGER = 256, 320
#: Bits of the fixed-size filters for keys and documents, as 64-bit words.
FILTER = 1 << 17
#: Bits of a word's hash below its count, and steps of a count for each doubling.
_HASH, _STEPS = 53, 15
#: Where null ids are in the order of doc_ids, and what is before all.
_NULL, _NEVER = -(1 << 63) + 1, -(1 << 63)
RARER = "\t\v\f\r\n"


def _plain(line: Column) -> Column:
    """line with spaces for the rarer blanks, where there are any, so that it can be split at spaces without a regular expression."""
    some = F.lit(False)
    for blank in RARER:
        some = some | F.contains(line, F.lit(blank))
    return F.when(some, F.translate(line, RARER, " " * len(RARER))).otherwise(line)


def _spaced(text: Column) -> Column:
    """text with spaces for the rarer blanks but line feeds, looked for once a text and not for each of them in every line."""
    blanks = RARER.replace("\n", "")
    return F.when(F.regexp_like(text, F.lit("[\\t\\x0B\\f\\r]")), F.translate(text, blanks, " " * len(blanks))).otherwise(text)


def tokens(line: Column) -> Column:
    """The distinct lower-cased words of a line."""
    return F.array_distinct(F.array_remove(F.split(F.lower(_plain(line)), " "), ""))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, ln, line; docs has th, the text's hash, as it would be made for each line here."""
    return docs.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("ln", "line"))


def _packed(parts: DataFrame, width: int) -> DataFrame:
    """One row with xs, the array over all of range(width * 1024) from (slot, value); 0 where there is none."""
    every = parts.sparkSession.range(width * 1024).withColumnRenamed("id", "slot")
    full = every.select("slot").join(parts, "slot", "left").select("slot", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    some = full.groupBy(F.expr("shiftright(slot, 10)").alias("hi")).agg(F.array_sort(F.collect_list(F.struct("slot", "value")))["value"].alias("xs"))
    one = some.agg(F.array_sort(F.collect_list(F.struct("hi", "xs")))["xs"].alias("xs"))
    return one.select(F.flatten("xs").alias("xs"))


def _bits(hashes: DataFrame) -> DataFrame:
    """One row with xs, a bitmap of FILTER 64-bit words with the hashes of column h."""
    slot = F.expr(f"h & {64 * FILTER - 1}")
    parts = hashes.select(slot.alias("s")).groupBy(F.expr("shiftright(s, 6)").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("value"))
    return _packed(parts, FILTER // 1024)


def _bitmap(hashes: DataFrame) -> Column:
    """_bits() as a scalar."""
    return _bits(hashes).scalar()


def _in(bitmap: Column, h: Column) -> Column:
    word = F.get(bitmap, F.shiftright(h.bitwiseAND(64 * FILTER - 1), 6).cast("int"))
    return F.getbit(word, h.bitwiseAND(63).cast("int")) == 1


def _some(classes: DataFrame, ids: DataFrame) -> DataFrame:
    """classes with an id of ids, and a few besides, so that what is joined with ids is about as small as they are."""
    return classes.filter(_in(_bitmap(ids.select(F.xxhash64("id").alias("h"))), F.xxhash64("id")))


def _marked(tmp: Scratch, classes: DataFrame, gone: DataFrame) -> DataFrame:
    """classes with gone, true for ids of gone and else null; those that cannot be among them are neither joined nor written again."""
    may = _in(tmp.save(_bits(gone.select(F.xxhash64("id").alias("h"))), "bits").scalar(), F.xxhash64("id"))
    some = tmp.save(classes.filter(may).join(gone.select("id", F.lit(True).alias("gone")), "id", "left"), "marked")
    return some.unionByName(classes.filter(~may).withColumn("gone", F.lit(None).cast("boolean")))


def _keys(tmp: Scratch, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of one rare word, and of two words or one word of a long set: key, id, at, b, c, n, cap.

    cap bounds the overlap if the key's words are the first two sets share, and is negative for classes that are settled; at
    is the place of doc_id in the order.
    """
    own = ["id", "at", "b", "c", "n"]
    first = F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1
    # said here for all columns, as it would be inferred for some of one side of a join only, and make two exchanges of one
    known = classes.filter(" AND ".join(f"{c} IS NOT NULL" for c in own))
    sign = F.when(F.col("gone"), -1).otherwise(1).alias("sign")

    def words(some: DataFrame, low: Column, high: Column) -> DataFrame:
        """i, x: the words of p from place low up to place high."""
        return some.select(*own, sign, "p", low.alias("low"), F.posexplode(F.slice("p", low + 1, F.greatest(high - low, F.lit(0)))).alias("i", "x")).withColumn("i", F.col("i") + F.col("low"))

    def keyed(key: Column, cap: Column) -> list[Column]:
        return [key.alias("key"), *[F.col(c) for c in own], (F.col("sign") * cap).alias("cap")]

    behind = F.col("n") - F.col("i")
    single = words(known.filter(f"n <= {LONGER}"), F.lit(0), F.least(first, F.col("rare"))).select(*keyed(F.xxhash64(F.lit(1), "x"), behind))
    other = tmp.save(known.filter((F.col("n") > LONG) | (F.col("rare") < first)).select(*own, "gone", "rare", "p"), "others")
    two = words(other.filter(f"n <= {LONGER}").filter(F.col("rare") < first), F.col("rare"), first)
    two = two.select(*own, "sign", "i", "x", F.posexplode(F.slice("p", F.col("i") + 2, F.greatest(F.size("p") - F.col("i") - 1, F.lit(0)))).alias("j", "y"))
    long = words(other.filter(f"n > {LONG}"), F.lit(0), first)
    return single, two.select(*keyed(F.xxhash64(F.lit(2), "x", "y"), behind - F.col("j"))).unionByName(long.select(*keyed(F.xxhash64(F.lit(3), "x"), behind)))


def _leads(classes: DataFrame) -> DataFrame:
    """The keys of the first round: key, id, at, n.

    They are pairs of successive words, the first LEADS of all and the first LEADS over FAMILY, as large families of near
    copies share words that are not rare for them alone, behind those that tell their members apart.
    """
    word = lambda i: F.get(F.col("p"), i)
    pair = lambda i: F.when(word(i + 1).isNotNull(), F.xxhash64(word(i), word(i + 1)))
    leads = lambda start: [pair(start + i) for i in range(LEADS)]
    every = F.when(F.col("few") < F.size("p"), F.array_distinct(F.array(*leads(F.lit(0)), *leads(F.col("few"))))).otherwise(F.array(*leads(F.lit(0))))
    return classes.filter("n >= 4").select("id", "at", "n", F.explode(every).alias("key")).filter("key IS NOT NULL")


def _close(x: str, y: str) -> Column:
    """Whether lengths and sketches leave it open that two sets are similar."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    one = F.col(f"{x}.b").bitwiseXOR(F.col(f"{y}.b"))
    two = F.when(F.least(n, m) > WIDE, F.col(f"{x}.c").bitwiseXOR(F.col(f"{y}.c"))).otherwise(F.lit(0).cast("bigint"))
    # c has the parities of half of the words; the others' are those of all without them
    apart = F.bit_count(one.bitwiseXOR(two)) + F.bit_count(two)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * apart <= n + m)


def _joined(x: DataFrame, y: DataFrame) -> DataFrame:
    """x, y: ids under a key that length, position and sketch do not rule out; settled classes are the earlier of a pair only."""
    x, y = x.alias("x"), y.alias("y")
    # what needs one side alone is said with the other, so that both stay one exchange
    before = (F.col("y.at") <= F.when(F.col("x.cap") > 0, F.col("x.at")).otherwise(F.lit(_NEVER))) & (F.col("x.id") != F.col("y.id"))
    reach = 9 * F.least(F.abs("x.cap"), F.abs("y.cap")) >= 4 * (F.col("x.n") + F.col("y.n"))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & before & reach & _close("x", "y")).select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))


def _joined_alone(keys: DataFrame) -> DataFrame:
    """_joined() of keys of one word with themselves, the larger set of a pair in x.

    A set in y is the smaller one, so that 8 / 9 of its words are shared if the two are similar, and the first shared one is
    among the first ninth: the other keys are not sorted and not compared there. Both sides read one exchange, as the filter
    counts as random and so stays above it. No key has many more rows than RARE, so none needs to be split.
    """
    dealt = keys.repartition("key")
    x, y = dealt.alias("x"), dealt.filter(F.when(F.spark_partition_id() >= 0, 9 * F.abs("cap") >= 8 * F.col("n"))).alias("y")
    n, m, later = F.col("x.n"), F.col("y.n"), F.col("x.at") >= F.col("y.at")
    # first what needs the least and leaves a few of a thousand
    apart = 9 * F.bit_count(F.col("x.b").bitwiseXOR(F.col("y.b"))) <= n + m
    larger = (n > m) | ((n == m) & (F.col("x.id") > F.col("y.id")))
    unsettled = (later & (F.col("x.cap") > 0)) | ((F.col("y.at") >= F.col("x.at")) & (F.col("y.cap") > 0))
    reach = 9 * F.least(F.abs("x.cap"), F.abs("y.cap")) >= 4 * (n + m)
    return x.join(y, (F.col("x.key") == F.col("y.key")) & apart & larger & unsettled & reach & _close("x", "y")).select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))


def _proven(tmp: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id of the classes of pairs (x, y) that are like an earlier one, by the words (as 64-bit hashes) of their first lines."""
    pairs = tmp.save(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    both = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    wanted = tmp.save(_some(classes.select("id", "doc_id", "th", "ln"), both).join(both, "id", "left_semi"), "wanted")
    ids, places = _bitmap(wanted.select(F.xxhash64("doc_id", "th").alias("h"))), _bitmap(wanted.select(F.xxhash64("doc_id", "th", "ln").alias("h")))
    near = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).filter(_in(ids, F.xxhash64("doc_id", "th")))
    own = _lines(near).filter(_in(places, F.xxhash64("doc_id", "th", "ln"))).select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), F.col("ln").alias("_n"), "line")
    words = wanted.join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")) & (F.col("ln") == F.col("_n")))
    words = words.select("id", F.struct("doc_id", "th", "ln").alias("at"), F.transform(tokens(F.col("line")), lambda w: F.xxhash64(w)).alias("words"))
    words = tmp.save(words.dropDuplicates(["id"]), "words")
    side = lambda c: words.select(F.col("id").alias(c), F.col("at").alias(f"{c}_at"), F.col("words").alias(f"{c}_words"))
    joined = pairs.join(side("x"), "x").join(side("y"), "y")
    shared = F.size(F.array_intersect("x_words", "y_words"))
    similar = joined.filter(100 * shared >= 80 * (F.size("x_words") + F.size("y_words") - shared))
    return similar.select(F.when(F.col("x_at") > F.col("y_at"), F.col("x")).otherwise(F.col("y")).alias("id")).distinct()


def removed_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, th (xxhash64 of the text), lines: sorted numbers, from 0, of the lines that go; documents without any are absent.

    Lines are between line feeds; those without a word always stay. Null and empty texts lose nothing. Rows with the same
    doc_id and text are one document and lose the same lines. Null ids come before all others. Other columns are not read;
    an empty table gives no rows.
    """
    tmp = Scratch(spark, "lines")
    docs = docs.select("doc_id", "text")
    # cut and hashed once, and written, as words are counted before they can be ranked
    lined = _lines(docs.select("doc_id", F.xxhash64("text").alias("th"), F.lower(_spaced(F.col("text"))).alias("text")))
    hashed = lined.select("doc_id", "th", "ln", F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))).alias("h"))
    hashed = tmp.save(hashed.select("doc_id", "th", "ln", F.array_remove("h", F.xxhash64(F.lit(""))).alias("h")), "hashes", plain=("h.list.element",))
    counted = hashed.select(F.explode("h").alias("h")).groupBy(F.expr(f"h & {SLOTS - 1}").alias("slot"))
    counted = counted.agg(F.shiftleft(F.floor(_STEPS * F.log2(F.count(F.lit(1)))), _HASH).alias("value"))
    counts = _packed(tmp.save(counted, "counts"), SLOTS // 1024).scalar()
    # one reference to the scalar, which the optimizer folds into the projection, so that no row holds the array
    worded = hashed.filter("size(h) > 0").withColumn("counts", counts)
    rank = lambda h: F.get(F.col("counts"), h.bitwiseAND(SLOTS - 1).cast("int")).bitwiseOR(h.bitwiseAND((1 << _HASH) - 1))
    # never null, which sorts as plain numbers
    sets = worded.select("doc_id", "th", "ln", F.sort_array(F.transform("h", lambda h: F.coalesce(rank(h), F.lit(0).cast("bigint")))).alias("r"))
    n = F.size("r")
    half = F.expr("aggregate(r, 0L, (a, x) -> a ^ shiftleft(shiftright(x, 6) & 1L, cast(x & 63 as int)))")
    made = sets.select(
        "doc_id", "th", "ln", n.alias("n"), F.xxhash64("r").alias("d1"),
        F.expr("aggregate(r, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))").alias("b"),
        F.when(n > WIDE, half).otherwise(F.lit(0).cast("bigint")).alias("c"),
        F.slice("r", F.lit(1), n - F.ceil(n * 4 / 5).cast("int") + 2).alias("q"),  # the prefix and one more
    )

    def under(most: int) -> Column:
        """How many of q, which is sorted and not empty, were counted up to most times; mostly all, which the last one tells."""
        end = (int(_STEPS * math.log2(most)) + 1) << _HASH
        return F.when(F.element_at("q", -1) < end, F.size("q")).otherwise(F.size(F.filter("q", lambda x: x < end)))

    short = F.transform("q", lambda x: F.shiftright(x, 7).bitwiseAND((1 << 31) - 1).cast("int"))
    made = tmp.save(made.select("doc_id", "th", "ln", "n", "d1", "b", "c", under(RARE).alias("rare"), under(FAMILY).alias("few"), short.alias("p")), "lines", plain=("d1", "b", "p.list.element"))
    tmp.drop(hashed)  # it is the largest table
    at = F.coalesce("doc_id", F.lit(_NULL))
    carried = ["n", "c", "rare", "few", "p"]
    # in one value with the place, as each value of its own is kept and copied for every row
    classes = made.groupBy("d1", "b").agg(F.min(F.struct("doc_id", "th", "ln", *carried)).alias("first"), F.count(F.lit(1)).alias("rows"))
    # a number for each class, kept by being written, so that keys and pairs are short
    classes = tmp.save(classes.select(F.monotonically_increasing_id().alias("id"), "d1", "b", "first.*", "rows").withColumn("at", at), "classes", plain=("id", "d1", "b", "p.list.element"))

    leads = _leads(classes)
    earliest = leads.groupBy("key").agg(F.min_by("id", "at").alias("id"), F.min_by("n", "at").alias("n"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    earliest = tmp.save(earliest, "earliest")
    leads = leads.filter(_in(_bitmap(earliest.select(F.col("key").alias("h"))), F.col("key")))
    n, m = F.col("x.n"), F.col("y.n")
    star = leads.alias("x").join(earliest.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & (5 * F.least(n, m) >= 4 * F.greatest(n, m)))
    gone = tmp.save(_proven(tmp, docs, classes, star.select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))), "gone")

    singles, others = _keys(tmp, _marked(tmp, classes.filter("n >= 4").select("id", "at", "b", "c", "n", "rare", "p"), gone))
    more = _joined_alone(singles).unionByName(_joined(others.filter("cap > 0"), others))
    gone = tmp.save(gone.unionByName(_proven(tmp, docs, classes, more)).distinct(), "gone")

    touched = _marked(tmp, classes.select("id", "d1", "b", "rows", "doc_id", "th", "ln"), gone).filter("gone OR rows > 1")
    touched = tmp.save(touched.select("d1", "b", F.struct("doc_id", "th", "ln").alias("first"), F.coalesce("gone", F.lit(False)).alias("gone")), "touched")
    near = made.select("d1", "b", "doc_id", "th", "ln").filter(_in(_bitmap(touched.select(F.col("d1").alias("h"))), F.col("d1")))
    lost = near.join(touched, ["d1", "b"]).filter(F.col("gone") | ~F.struct("doc_id", "th", "ln").eqNullSafe(F.col("first")))
    return tmp.finish(lost.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("ln")).alias("lines")))


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the lines of removed_lines(); all rows and columns stay, and texts that lose nothing are untouched."""
    own, doc, text, gone = unused(docs, "hash", "doc", "text", "lines")
    lost = removed_lines(spark, docs).select(F.col("doc_id").alias(doc), F.col("th").alias(text), F.col("lines").alias(gone))
    kept = docs.withColumn(own, F.xxhash64("text")).join(lost, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(text)), "left")
    fewer = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    return kept.select(*[F.when(F.col(gone).isNull(), F.col("text")).otherwise(fewer).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go from every document, by number from 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lost = removed_lines(spark, docs).select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "lines")
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines"))
    out = own.join(lost, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("lines", ","), F.lit("")).alias("removed"))
