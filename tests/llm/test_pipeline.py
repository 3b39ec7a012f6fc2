import corpus_pipeline
from parchment.llm.jaccard import jaccard_join
from tests.llm.test_dedup import plain_line_dedup
from tests.llm.test_search_pack_warc import plain_hits

SF = "/root/testdata/sf0.01"


def test_each_stage_does_its_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.write_table(stage(spark, seen[-1], SF), "stage"))
    texts = [{r.doc_id: r.text for r in df.collect()} for df in seen[:-1]]
    assert all(df.columns == docs.columns for df in seen[:-1])
    gone = set(texts[0]) - set(texts[1])
    assert sum(labels.get(d) == 1 for d in gone) > 0.6 * sum(labels.values()) and sum(labels.get(d) == 0 for d in gone) < 5
    assert texts[2] == plain_line_dedup(texts[1])
    assert set(texts[3]) == {r.class_id for r in jaccard_join(seen[2]).collect()} and texts[3].items() <= texts[2].items()
    dirty = {d for d, t in texts[3].items() if (h := plain_hits(t, items))[1] and 20 * h[1] >= h[0]}
    assert set(texts[4]) == set(texts[3]) - dirty
    assert {r.doc_id for r in seen[5].collect()} == set(texts[4])


def test_run_reads_what_it_wrote(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_one_row_of_each_near_duplicate_class_stays(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words, "z"])
    rows = [(1, "a " * 9 + " ".join(words), "x"), (1, "a " * 9 + near, "y"), (2, near + " v", "x"), (2, near + " v", "x"), (3, "only " + "b c d e f g h", "x")]
    rows += [(None, " ".join(words[::-1]), "x")] * 3 + [(4, "j k l m n o p", "x")] * 2 + [(5, "", "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = jaccard_join(docs).collect()
    assert sorted((r.class_id or 0) for r in got if r.kept) == [0, 1, 3, 4, 5, 5]
    assert {r.class_id for r in got if r.doc_id == 2} == {1}
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 1, 3, 4, 5, 5]
