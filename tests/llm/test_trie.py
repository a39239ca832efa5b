"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from gridloom.llm import trie
from gridloom.llm.scratch import Scratch

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """conv_id -> its turns as (role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}


def exchanged(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    return out


def nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = sum(saved[k] for k in kids[key]) + (len(members[key]) - 1) * words
    out = set()
    for key, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(key))
        up = min(members[key[:-1]]) if key else None
        out.add((min(own), len(key), up, len(own), len(kids[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    got = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 60), 45):
        for t in range(rng.choice([1, 2, 3, 5, 9, 20])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant"]) if t > 2 else "user", rng.choice(["a b", "a b", "c", "", None])))
    df = frame(spark, rows)
    assert rows_of(trie.prefix_trie(spark, df)) == nodes(ordered(rows))
    tmp = Scratch(spark, "test")
    assert rows_of(trie.fold(tmp, *trie.rebuilt(*trie.numbered(tmp, df)))) == nodes(exchanged(ordered(rows)))


def test_deep_copies_and_spans(spark):
    """Conversations that agree for over a hundred turns, to the end or not, one inside another, and copies of one."""
    long = [("user" if t % 2 == 0 else "assistant", f"turn {t} of it") for t in range(150)]
    convs = {1: long, 2: long, 3: long[:140], 4: long[:64] + [("user", "else")] + long[64:], 5: long[:4], 6: long[:4], 7: [("user", "other")]}
    convs |= {c: long[:9] for c in range(100, 160)}
    rows = [(c, t, role, text) for c, own in convs.items() for t, (role, text) in enumerate(own)]
    assert rows_of(trie.prefix_trie(spark, frame(spark, rows))) == nodes(convs)


def test_span_numbers(spark):
    pos = [0, 3, 4, 7, 8, 15, 16, trie.SPAN - 1, trie.SPAN, 2 * trie.SPAN - 1, 2 * trie.SPAN, 10 * trie.SPAN + 5]
    got = spark.createDataFrame([(p,) for p in pos], "pos bigint").select("pos", trie._span(trie.F.col("pos")).alias("s")).collect()
    for r in got:
        lo, hi = trie._bounds(r.s)
        assert lo <= r.pos < hi and hi - lo <= trie.SPAN
    assert all(trie._bounds(k)[1] == trie._bounds(k + 1)[0] for k in range(20))


def test_lists_longer_than_a_piece(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(500)]
    want = nodes(ordered(rows))
    monkeypatch.setattr(trie, "PIECE", 7)
    ends = {(r.depth, r.node): r.ends_sha256 for r in trie._ends(spark.createDataFrame([(1, 0, c) for c in range(500)], "depth bigint, node bigint, conv_id bigint")).collect()}
    assert ends[1, 0] == next(x[-1] for x in want if x[1] == 1)
    assert rows_of(trie.prefix_trie(spark, frame(spark, rows))) == want


def test_awkward_tables(spark):
    assert trie.prefix_trie(spark, frame(spark, [])).count() == 0
    assert trie.prefix_trie(spark, frame(spark, [(None, 0, "user", "x")])).count() == 0
    one = [(7, None, None, None), (7, 1, "user", "w " * 200_000)]
    more = frame(spark, one).selectExpr("*", "1 AS node", "'x' AS digest", "2 AS words", "3 AS n_turns", "4 AS pos")
    assert rows_of(trie.prefix_trie(spark, more)) == nodes(ordered(one))
    tied = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (3, 1, "b", "x"), (3, 1, "a", "y")]
    assert rows_of(trie.prefix_trie(spark, frame(spark, tied))) == nodes(ordered(tied))
    # all turnless: 17 and 18 have no more than what is cut off, and their base is absent
    own = {c: [("user", "a")] for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 1 and c % 20}
    rows = [(c, 0, "user", "a") for c in own]
    tmp = Scratch(spark, "test")
    got = rows_of(trie.fold(tmp, *trie.rebuilt(*trie.numbered(tmp, frame(spark, rows)))))
    assert got == nodes(exchanged(ordered(rows))) and len(got) == 1


def test_query_is_its_sql(spark):
    where = "/root/testdata/sf0.01"
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{where}/conversations.parquet'")
        want = {tuple(r) for r in c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.SQL})").fetchall()}
    assert rows_of(trie.op11_prefix_trie(spark, where)) == want
