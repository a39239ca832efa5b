"""The prefix trie of conversations by partition refinement.

All conversations start as one class. A class is split by what its members say next, turn by turn; a member that is alone
in its class is retired, and the rest of its turns is emitted as a chain of nodes with one child each. What is left are
the shared nodes, and their counts are folded back from the deepest to the root.

Refinement goes by spans of turns, 4 to SPAN of them and twice as many each time, so that the rounds are few however deep
conversations agree: within a span a class is named by the class that it came from and a running 128-bit digest of
(turn number, role, text), and only members of classes of two or more go on to the next span. A span of one conversation
is the largest thing that is ever sorted as one group. Turns are numbered over a range partitioning, in which a long
conversation lies in many partitions, and the rows of a shared node meet in partial aggregates only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.mixing import word_count
from gridloom.llm.scratch import Scratch

#: Turns in a span at most.
SPAN = 4096
#: Members of a node in one piece of their list at most.
PIECE = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _span(pos: Column) -> Column:
    """The number of the span that a turn is in: turns 0 to 3, 4 to 7, 8 to 15, ... and SPAN each from SPAN on."""
    tens = SPAN.bit_length() - 3
    return F.when(pos < 4, F.lit(0)).when(pos < SPAN, F.length(F.bin(pos)) - 2).otherwise((F.lit(tens) + F.floor(pos / SPAN)).cast("int"))


def _bounds(span: int) -> tuple[int, int]:
    """First turn of a span and of the next one."""
    tens = SPAN.bit_length() - 3
    if span == 0:
        return 0, 4
    return (2 << span, 4 << span) if span <= tens else ((span - tens) * SPAN, (span - tens + 1) * SPAN)


def numbered(tmp: Scratch, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, pos from 0, digest, words), and (conv_id, n_turns).

    Order is by turn, null first, then role, then text; turns equal in all of these are interchangeable. A null role or
    text is empty. Turns without a conv_id belong to no conversation and are left out.
    """
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    at = F.monotonically_increasing_id()  # the partition's number above the row's within it
    own = tmp.save(dealt.select("conv_id", at.alias("at"), digest.alias("digest"), word_count(F.col("text")).alias("words")), "turns")
    own = own.withColumn("part", F.shiftright("at", 33))
    cells = own.groupBy("conv_id", "part").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("conv_id", "part", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("lo")).alias("shift"))
    pos = own.join(first, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "digest", "words")
    return tmp.save(pos, "numbered"), tmp.save(cells.groupBy("conv_id").agg(F.sum("n").alias("n_turns")), "lengths")


def rebuilt(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """numbered()'s tables with heads exchanged: the first h turns of conversation c - c % 20, all if fewer and none if it is absent,
    then c's own turns after its first h, where h is the CRC-32 of c's decimals modulo 4. A conversation can end up without turns."""
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    c = lengths.select("conv_id", "n_turns", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"))
    c = c.join(base, "base", "left").withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0))))
    own = turns.join(c.select("conv_id", "h", "head"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "words")
    heads = turns.filter("pos < 3").withColumnRenamed("conv_id", "base").join(c.filter("head > 0").select("conv_id", "base", "head"), "base").filter("pos < head")
    return own.unionByName(heads.select("conv_id", "pos", "digest", "words")), c.select("conv_id", (F.col("head") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted depth, node, conv_id to pieces of a node's list: depth, node, first conv_id, conv_ids joined by commas."""
    now, own = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": pa.array([now[0]], pa.int64()), "node": pa.array([now[1]], pa.int64()), "first": pa.array([own[0]], pa.int64()), "ids": pa.array([",".join(map(str, own))], pa.string())})

    for batch in batches:
        for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own and (now != (depth, node) or len(own) >= PIECE):
                yield piece()
                own = []
            now = (depth, node)
            own.append(conv)
    if own:
        yield piece()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to each node's SHA-256; what is kept is one hash's state."""
    now, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": pa.array([now[0]], pa.int64()), "node": pa.array([now[1]], pa.int64()), "ends_sha256": pa.array([state.hexdigest()])})

    for batch in batches:
        for depth, node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if now != (depth, node):
                if now is not None:
                    yield done()
                now, state = (depth, node), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if now is not None:
        yield done()


def _ends(rows: DataFrame) -> DataFrame:
    """depth, node, ends_sha256 of (depth, node, conv_id): pieces of the list are joined wherever their rows are, and only pieces meet."""
    order = ["depth", "node", "conv_id"]
    pieces = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth bigint, node bigint, first bigint, ids string")
    met = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return met.mapInArrow(_hashes, "depth bigint, node bigint, ends_sha256 string")


def fold(tmp: Scratch, turns: DataFrame, members: DataFrame) -> DataFrame:
    """The trie's nodes, of turns (conv_id, pos from 0, digest, words) and members (conv_id, n_turns, with 0 too).

    A node is named by its least member and its depth. Rows: conv_id, depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (nodes without children in its subtree, itself included), saved_tokens (words of its subtree's turns
    that need not be kept again, once for each further member) and ends_sha256 (of its members that end there).
    Without members there is no root, and no rows.
    """
    members = tmp.save(members, "members")
    total = members.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")).head()
    if not total.n:
        return tmp.finish(tmp.spark.createDataFrame([], NODE), "nodes")
    turns = tmp.save(turns.withColumn("span", _span(F.col("pos"))), "spans", by=("span",))
    active = members.filter(F.lit(total.n > 1) & (F.col("n_turns") > 0)).select("conv_id", "n_turns", F.lit(total.first).alias("from"))

    # refine: classes of two or more, with a row for each member and turn
    levels: list[DataFrame] = []
    while not active.isEmpty():
        start, end = _bounds(len(levels))
        run = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        rows = turns.filter(F.col("span") == len(levels)).drop("span").join(active, "conv_id")
        rows = rows.select("*", *(F.bit_xor(F.xxhash64(F.lit(k), "pos", "digest")).over(run).alias(f"x{k}") for k in (1, 2))).drop("digest")
        name = ["pos", "from", "x1", "x2"]
        shared = rows.groupBy(*name).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_turns") == F.col("pos") + 1).alias("ended")).filter("n > 1")
        level = tmp.save(rows.join(shared, name).select("conv_id", "pos", "n_turns", "words", "from", "node", "n", "ended"), "level")
        levels.append(level)
        active = level.filter((F.col("pos") == end - 1) & (F.col("n_turns") > end)).select("conv_id", "n_turns", F.col("node").alias("from"))

    # retire: where a member leaves its last shared node, a chain begins
    last = tmp.spark.createDataFrame([], "conv_id bigint, pos bigint, node bigint")
    for level in levels:
        last = last.unionByName(level.select("conv_id", "pos", "node"))
    last = last.groupBy("conv_id").agg((F.max("pos") + 1).alias("top"), F.max_by("node", "pos").alias("at"))
    tops = members.join(last, "conv_id", "left").select("conv_id", "n_turns", F.coalesce("top", F.lit(0)).alias("top"), F.coalesce("at", F.lit(total.first)).alias("at"))
    tops = tmp.save(tops, "tops")
    alone = (F.col("n_turns") > F.col("top")).cast("long")
    chain = turns.join(tops.filter("n_turns > top"), "conv_id").filter("pos >= top")
    end = F.col("pos") + 1 == F.col("n_turns")
    chain = chain.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("at")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )

    # fold back: a node's counts go with its least member's path, so a subtree's sum is its members' sums from its depth on
    carry = tops.select("conv_id", alone.alias("leaves"), F.lit(0).cast("long").alias("saved"), alone.alias("head"))
    nodes, enders = [], [members.filter("n_turns = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(total.first).alias("node"), "conv_id")]
    for k in range(len(levels) - 1, -1, -1):
        own = (F.col("conv_id") == F.col("node")).cast("long")
        rows = levels[k].join(carry, "conv_id").withColumn("own", own)
        path = Window.partitionBy("conv_id").orderBy("pos")
        below = path.rowsBetween(0, Window.unboundedFollowing)
        rows = rows.select(
            "conv_id", "pos", "node", "n", "own", F.coalesce(F.lag("node").over(path), F.col("from")).alias("up"), F.coalesce(F.lead("own").over(path), F.col("head")).alias("child"),
            (F.sum(F.when(F.col("ended") == F.col("n"), F.col("own")).otherwise(0)).over(below) + F.col("leaves")).alias("leaves"),
            (F.sum(F.col("own") * (F.col("n") - 1) * F.col("words")).over(below) + F.col("saved")).alias("saved"),
        )
        rows = tmp.save(rows, "folded")
        nodes.append(rows.groupBy("pos", "node").agg(F.max(F.when(F.col("own") == 1, F.col("up"))).alias("up"), F.max("n").alias("n"), F.sum("child").alias("child"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        enders.append(levels[k].filter("n_turns = pos + 1").select((F.col("pos") + 1).alias("depth"), "node", "conv_id"))
        top = rows.filter(F.col("pos") == _bounds(k)[0]).select("conv_id", F.col("leaves").alias("l"), F.col("saved").alias("s"), F.col("own").alias("h"))
        carry = carry.join(top, "conv_id", "left").select("conv_id", F.coalesce("l", "leaves").alias("leaves"), F.coalesce("s", "saved").alias("saved"), F.coalesce("h", "head").alias("head"))
        carry = tmp.save(carry, "carry")
    root = carry.agg(F.count(F.lit(1)).alias("n"), F.sum("head").alias("child"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    found = root.select(F.lit(-1).cast("long").alias("pos"), F.lit(total.first).alias("node"), F.lit(None).cast("long").alias("up"), "n", "child", F.when(F.col("child") == 0, F.lit(1)).otherwise(F.col("leaves")).alias("leaves"), "saved")
    ends = enders[0]
    for k, rows in enumerate(nodes):
        found, ends = found.unionByName(rows), ends.unionByName(enders[k + 1])
    found = found.withColumn("depth", F.col("pos") + 1).join(_ends(ends), ["depth", "node"], "left")
    found = found.select(F.col("node").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("child").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    return tmp.finish(found.unionByName(chain), "nodes")


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The prefix trie of conversations as they are, a row for each node; see fold() for the columns and numbered() for the order.

    Repeated rows are turns of their own, clashing other columns are not read, and an empty table gives no rows. Sequences
    are equal if 128-bit digests of their turns are.
    """
    tmp = Scratch(spark, "trie")
    return fold(tmp, *numbered(tmp, conversations))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with exchanged heads."""
    tmp = Scratch(spark, "trie")
    return fold(tmp, *rebuilt(*numbered(tmp, spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = """
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (
  SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda s, i: xor(s >> 1, 3988292384 * (s & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h FROM l
), r AS (
  SELECT c.conv_id, o.pos, role, text FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, o.pos + 100, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h
), s AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER w AS key, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), m AS (
  SELECT conv_id, depth, key, words FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM c
), t AS (
  SELECT conv_id, max(depth) AS n FROM m GROUP BY conv_id
), n AS (
  SELECT depth, key, min(m.conv_id) AS node, count(*) AS n_convs, max(words) AS words, coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (t.n = depth), '') AS ends
  FROM m JOIN t ON t.conv_id = m.conv_id GROUP BY depth, key
), p AS (
  SELECT m.conv_id, m.depth, n.node FROM m JOIN n ON n.depth = m.depth AND n.key = m.key
), u AS (
  SELECT n.*, p.node AS parent FROM n LEFT JOIN p ON p.conv_id = n.node AND p.depth = n.depth - 1
), k AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL
), v AS (
  SELECT u.*, coalesce(k.n_children, 0) AS n_children FROM u LEFT JOIN k ON k.node = u.node AND k.depth = u.depth
), b AS (
  SELECT p.node, p.depth, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved FROM v JOIN p ON p.conv_id = v.node AND p.depth <= v.depth GROUP BY ALL
)
SELECT v.node::BIGINT AS conv_id, v.depth::BIGINT AS depth, parent::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM v JOIN b ON b.node = v.node AND b.depth = v.depth
"""
