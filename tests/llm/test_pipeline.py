import corpus_pipeline
from tests.conftest import SF
from tests.llm.fixtures import SCHEMA, rows


def test_stages_keep_columns_and_pack_the_rest(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    passage = rows()[0][1]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, counts = now.columns, [now.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns, name
            counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1]
    left = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out2").collect()}
    assert 0 not in left  # all of it is the benchmark's passage
    whole = corpus_pipeline.run(spark, str(tmp_path))
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, whole.collect()), key=order) == sorted(map(tuple, now.collect()), key=order)


def test_stages_on_empty_tables_and_null_texts(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, q int, pii_seen string"
    rows = [(1, None, "en", "web", 0, 1, "a"), (2, "", "en", "web", 0, 2, "b"), (3, "no match here", None, None, 13, 3, None), (3, "no match here", None, None, 13, 3, None)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nothing = stage(spark, spark.createDataFrame([], schema), SF)
        assert nothing.columns == [x.split()[0] for x in schema.split(", ")] and nothing.count() == 0, name
        if name in ("decontamination", "personal_data"):
            got = stage(spark, spark.createDataFrame(rows, schema), SF).collect()
            assert sorted(map(tuple, got), key=str) == sorted(rows, key=str), name
