from pyspark.sql import functions as F

import corpus_pipeline as pipe
from gridloom.llm import decontam, minhash, mixing, toxicity
from test_lines import brute as lost_lines
from test_minhash import brute as groups

DIR = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark, documents):
    assert [n for n, _ in pipe.STAGES] == ["toxicity", "line dedup", "near-duplicates", "decontamination", "mixing"]
    docs, made = documents, []
    for name, stage in pipe.STAGES:
        docs = stage(spark, docs, DIR)
        rows = docs.collect()
        made.append({r.doc_id: r.text for r in rows})
        docs = spark.createDataFrame(rows, docs.schema)
        if name != "mixing":
            assert docs.columns == documents.columns and len(made[-1]) == len(rows)
    source = {r.doc_id: r.text for r in documents.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert all(labels.get(d) != 0 for d in set(source) - set(made[0])) and {d: source[d] for d in made[0]} == made[0]
    lost = lost_lines(list(made[0].items()))
    left = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost.get(d, ())) for d, t in made[0].items()}
    assert made[1] == {d: t for d, t in left.items() if t.split() or not made[0][d].split()} and len(made[1]) < len(left)  # what is emptied goes
    assert set(made[2]) == {d for d, _, _, kept in groups(list(made[1].items()), 5, 80) if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert set(made[3]) == {r.doc_id for r in decontam.overlap(spark, spark.createDataFrame(list(made[2].items()), "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect() if not r.contaminated}
    assert set(made[4]) <= set(made[3])
    assert docs.columns == [*documents.columns, "copy_no"]


def test_extra_columns_and_empty_table(spark, awkward):
    for frame in (awkward, awkward.limit(0)):
        docs = frame.withColumns({"th": pipe.F.lit(1), "score": pipe.F.lit("s"), "copies": pipe.F.lit(2.5)})
        for name, stage in pipe.STAGES:
            if name == "near-duplicates":
                assert stage(spark, docs, DIR).filter("doc_id = 1").count() in (0, 2)
            out = stage(spark, docs, DIR)
            assert set(docs.columns) <= set(out.columns) and out.count() <= 3 * docs.count()


def test_mix_is_what_the_query_says(spark, documents):
    told = {r.doc_id: (r.size, r.copies) for r in mixing.copies(spark, documents).collect()}
    got = {}
    for r in mixing.mix(spark, documents).collect():
        got.setdefault(r.doc_id, []).append(r.copy_no)
    assert {d: c for d, (_, c) in told.items() if c} == {d: len(v) for d, v in got.items()}
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


def test_mix_awkward(spark, awkward):
    rows = mixing.copies(spark, awkward).collect()
    assert len(rows) == awkward.count() and all(r.copies <= 3 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    assert all(v[0].target <= 3 * sum(r.size for r in v) + 1e-9 for v in by.values())
    assert mixing.copies(spark, awkward.limit(0)).count() == 0 and mixing.mix(spark, awkward.limit(0)).count() == 0


def test_operators_do_not_mind_repeats(spark, awkward):
    assert minhash.near_duplicates(spark, awkward.unionAll(awkward)).count() == 2 * awkward.count()
    assert toxicity.keep_clean(awkward, toxicity.Model(toxicity.np.zeros(toxicity.SLOTS, "f4"), -6.0, 0.0)).columns == awkward.columns


def test_null_and_repeated_ids_are_judged_by_text(spark):
    """One contaminated or copied document without an id takes no other with it; nor does one whose id another text has."""
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    clean = ["the first clean text of all that is about nothing much at all today", "another one that says quite different things in many more words"]
    long = "a long text that several rows hold in common and that is copied from one to the other without any change at all"
    rows = [(None, item), (None, clean[0]), (5, item), (5, clean[1]), (7, long), (None, long), (None, long + " but"), (8, None), (None, None), (None, ""), (9, clean[1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("document", F.lit("a column of that name"))
    left = [(r.doc_id, r.text) for r in pipe.drop_contaminated(spark, docs, DIR).collect()]
    assert sorted(left, key=str) == sorted([r for r in rows if r[1] != item], key=str)
    out = pipe.drop_near_duplicates(spark, docs, DIR)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns
    assert sum(t == item for _, t in kept) == 1 and sum(t == clean[0] for _, t in kept) == 1 and sum(t == clean[1] for _, t in kept) == 1
    assert sum((t or "").startswith(long) for _, t in kept) == 1 and {(8, None), (None, None), (None, "")} <= set(kept)


def test_mixing_a_mix_and_equal_rows(spark):
    rows = [(k % 3, f"some words {k % 5} here", f"s{k % 2}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first = [sorted(map(tuple, mixing.mix(spark, docs.repartition(n)).collect())) for n in (1, 3, 7)]
    assert first[0] == first[1] == first[2] and first[0]
    again = mixing.mix(spark, mixing.mix(spark, docs).withColumns({"copies": F.lit(1), "nth": F.lit(2)}))
    assert again.columns == ["doc_id", "text", "source", "copy_no", "copies", "nth", "_copy_no"] and again.count() > 0


def test_documents_that_line_dedup_empties_go(spark):
    """Copies are emptied by line dedup and go with it; what had no words stays, and nothing that is emitted is empty."""
    one = "\n".join(f"line {k} of this text has enough words of its own, as number {k * 7} says" for k in range(5))
    rows = [(1, one, "en", "a"), (2, one, "en", "a"), (3, one + "\nand one more line that no other text here has in it", "en", "a"), (4, None, "en", "a"), (5, "", "en", "a"), (6, " \n ", "en", "a"), (2, one, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("had_words", F.lit(7))
    got = pipe.drop_repeated_lines(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 4, 5, 6] and {r.had_words for r in got} == {7}
    assert {r.doc_id: r.text for r in got}[3] == "and one more line that no other text here has in it"


def test_no_text_is_emitted_empty(spark):
    where = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{where}/documents.parquet").filter("text RLIKE '[^ \\n]'").count()
    out = pipe.run(spark, where)
    assert before > 0 and out.filter("text IS NOT NULL AND NOT text RLIKE '[^ \\n]'").count() == 0 < out.count()


def test_rows_without_an_id_are_dealt_over_cells(spark):
    """20,000 texts of one size and source without an id: no cell has more than about CELL of them."""
    docs = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('text number ', id) AS text", "'a' AS source")
    got = mixing.copies(spark, docs, carried="text")
    assert got.count() == 20_000
    dice = mixing.unit(F.concat_ws(":", F.lit("null"), F.md5(F.col("text").cast("binary"))))
    slices = -(-20_000 // mixing.CELL)
    cells = got.groupBy(F.floor(dice * slices).alias("slice")).count().collect()
    assert len(cells) == slices and max(r["count"] for r in cells) < 1.25 * mixing.CELL
    assert 0.99 < got.agg(F.sum(F.col("copies") * F.col("size")) / F.max("target")).first()[0] < 1.01
    many = mixing.mix(spark, docs)
    assert many.count() == got.agg(F.sum("copies")).first()[0]
