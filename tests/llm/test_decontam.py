from gridloom.llm import decontam


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_brute_force(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    own = documents.limit(60)
    items = [(r.item_id, r.text) for r in bench.collect()] + [(900, "The"), (901, "of the"), (902, None), (903, "!!"), (901, "and the")]
    docs = [(r.doc_id, r.text) for r in own.collect()]
    docs += [(5000 + k, f"lead in words {text} and tail") for k, (_, text) in enumerate(items[:6])]
    docs += [(6000 + k, " ".join((text or "").split()[3:15])) for k, (_, text) in enumerate(items[:6])]
    docs += [(None, None), (7000, ""), (7001, items[0][1]), (7001, items[0][1])]
    got = decontam.overlap(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows(got) == sorted(decontam.brute(docs, items), key=repr)


def test_awkward_and_empty(spark, awkward):
    bench = spark.createDataFrame([(1, "quick brown fox"), (None, "lazy dog")], "item_id bigint, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontam.overlap(spark, awkward, bench).collect()}
    assert (None, 18, 5, 1) in got and (2, 0, 0, 0) in got and (1, 18, 5, 1) in got
    assert decontam.overlap(spark, awkward.limit(0), bench).count() == 0
    assert decontam.overlap(spark, awkward, bench.limit(0)).filter("n_hit > 0").count() == 0
