import random
import re

from pyspark.sql import functions as F

from gridloom.llm import lines


def words(line):
    return frozenset(w for w in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if w)


def brute(docs):
    """doc_id -> line numbers that go; doc_ids are distinct and not null."""
    every = [(d, n, words(x)) for d, t in sorted(docs) for n, x in enumerate((t or "").split("\n"))]
    out = {}
    for i, (d, n, w) in enumerate(every):
        if w and any(v and 100 * len(w & v) >= 80 * len(w | v) for _, _, v in every[:i]):
            out.setdefault(d, []).append(n)
    return out


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary if rng.random() < 0.5 else vocabulary[:12]) for _ in range(rng.choice([1, 3, 5, 6, 9, 12, 30, 47]))] for _ in range(60)]
    docs = []
    for d in range(120):
        text = []
        for _ in range(6):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            rng.shuffle(line)
            text.append(" ".join(line))
        docs.append((d, "\n".join(text)))
    return docs


def lost(spark, docs):
    return {r.doc_id: r.lines for r in lines.removed_lines(spark, spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}


def test_against_brute_force(spark, monkeypatch):
    docs = corpus()
    want = brute(docs)
    assert lost(spark, docs) == want and len(want) > 50
    monkeypatch.setattr(lines, "RARE", 3)  # pairs of words as keys for nearly all
    assert lost(spark, docs) == want
    monkeypatch.setattr(lines, "LEADS", 1)  # most is left to the second round
    monkeypatch.setattr(lines, "WIDE", 8)
    assert lost(spark, docs) == want


def test_a_large_family(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(40)]
    docs = []
    for d in range(400):
        line = list(base)
        for k in range(rng.choice([1, 2, 3, 4, 6, 9])):
            line[rng.randrange(40)] = f"own{d}x{k}"
        docs.append((d, " ".join(line)))
    assert lost(spark, docs) == brute(docs)


def test_long_lines(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [rng.sample(vocabulary, n) for n in (240, 260, 300, 330, 700)]
    docs = []
    for d in range(30):
        line = list(rng.choice(base))
        for _ in range(rng.choice([0, 5, 20, 60])):
            line[rng.randrange(len(line))] = rng.choice(vocabulary)
        docs.append((d, " ".join(line)))
    assert lost(spark, docs) == brute(docs)


def test_awkward(spark, awkward):
    out = lines.dedup_lines(spark, awkward)
    assert out.columns == awkward.columns
    got = {(r.doc_id, r.key): r.text for r in out.collect()}
    assert len(got) == 9 and out.count() == awkward.count()
    whole = awkward.filter("key = 'key'").first().text
    assert got[(None, "key")] == whole and got[(1, "x")] == "" and got[(5, None)] == "" and got[(2, None)] is None and got[(4, "n")] == " \t\n \r "
    assert lines.dedup_lines(spark, awkward.limit(0)).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four five\nsix", 1, 2, 3, 4), (2, "one two three four five\nseven", 5, 6, 7, 8)], "doc_id bigint, text string, hash int, lines int, _lines int, Doc int")
    out = lines.dedup_lines(spark, docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} == {(1, "one two three four five\nsix", 1, 2, 3, 4), (2, "seven", 5, 6, 7, 8)}


def test_words_are_between_any_blanks(spark):
    """Words are split at spaces, without a regular expression a line; the rarer blanks and runs of them count as before."""
    texts = ["a b  c", "\ta\x0bB\x0cc\r", " \t ", "", "é x  y", "a\nb\t\tc d", "  lead and trail  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.w for r in df.orderBy("i").select(lines.tokens(F.col("t")).alias("w")).collect()]
    assert got == [list(dict.fromkeys(w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w)) for t in texts]
    plan = df.select(lines.tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "x20" not in plan and "RLIKE" not in plan and "regexp" not in plan


def test_work_a_line_does_not_grow_with_its_document(spark):
    """A text's hash is made before the text is cut, not once for each of its lines."""
    docs = spark.createDataFrame([(1, "a b\nc d")], "doc_id bigint, text string").withColumn("th", F.xxhash64("text"))
    plan = lines._lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1 and plan.index("Generate") < plan.index("xxhash64")


def test_a_key_is_compared_from_the_larger_set_only(spark, tmp_path):
    """About half of the rows are enough on one side, and no similar pair is lost."""
    rng = random.Random(7)
    bases = [rng.sample(range(60), 12) for _ in range(40)]
    sets = {i: sorted({*rng.choice(bases)[: rng.choice([9, 10, 11, 12])], rng.randrange(60)}) for i in range(300)}
    rows = []
    for i, w in sets.items():
        n, b = len(w), 0
        for x in w:
            b ^= 1 << x
        rows += [(w[k], i, i, b, 0, n, (-1 if i % 5 == 0 else 1) * (n - k)) for k in range(n - -(-4 * n // 5) + 1)]
    spark.createDataFrame(rows, "key bigint, id bigint, at bigint, b bigint, c bigint, n int, cap int").write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    made = lines._joined_alone(keys)
    got = {(min(r.x, r.y), max(r.x, r.y)) for r in made.collect()}
    similar = {(i, j) for j, w in sets.items() if j % 5 for i in range(j) if 10 * len(set(w) & set(sets[i])) >= 8 * len(set(w) | set(sets[i]))}
    assert similar and similar <= got and all(j % 5 for _, j in got)


def test_words_of_sets_are_not_written_again_once_some_are_settled(spark, monkeypatch):
    """Between the rounds only the settled sets are written, with their mark; the others are read from where they are."""
    rng = random.Random(8)
    base = [rng.sample(range(500), 12) for _ in range(30)]
    docs = [(d, " ".join(f"w{x}" for x in [*rng.choice(base)[: rng.choice([10, 11, 12])], 500 + d])) for d in range(200)]
    wrote = {}

    def save(self, df, label="t", *args, old=lines.Scratch.save, **kwargs):
        out = old(self, df, label, *args, **kwargs)
        if "p" in df.columns:
            wrote[label] = out.count()
        return out

    monkeypatch.setattr(lines.Scratch, "save", save)
    want = brute(docs)
    assert lost(spark, docs) == want and len(want) > 50
    assert "open" not in wrote and wrote["lines"] >= wrote["classes"] > wrote["marked"] > 0


def test_rarer_blanks_of_whole_texts(spark):
    """They are looked for once a text, and part words all the same."""
    docs = [(1, "a b c d e\nx"), (2, "a\tb\x0bc\x0cd\re\n\t \r"), (3, "E\tD  c b\ra\n\x0by\x0c"), (4, "a b c d\x0be f\nY")]
    assert lost(spark, docs) == brute_of(docs)


def brute_of(docs):
    return brute([(d, t.replace("\x0b", " ").replace("\x0c", " ")) for d, t in docs])
