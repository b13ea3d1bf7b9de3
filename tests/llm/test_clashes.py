"""Tables whose columns have the names that operators use inside, in any case of letters; chains and shared ids."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daybook.llm import decontaminate, exact_dedup, html_extract, language_model, near_join, packing, quality, secrets, surrogates, token_output

NAMES = "_gone _found _hot _salt rid _row _ROW2 _id _sha _own_id _own_sha _again _nth _s _w _h _n key rep band block comp set place mark r size n salt digest keep_id kept group_id class_id train word c lat base prompt part pos ids half x y score known others prefix starts page stream".split()
TEXT = "the quick brown fox jumps over the lazy dog and runs far away from here today again"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, TEXT), (2, TEXT), (3, TEXT + " end"), (4, None), (5, ""), (6, "another text about other things altogether, said plainly and at some length"), (None, TEXT), (6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))


def test_operators_take_tables_with_clashing_columns(spark, clashing):
    n = clashing.count()
    labels = spark.createDataFrame([(1, 1, 7), (2, 0, 7), (6, 1, 7)], "doc_id long, quality int, _row int")
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", 3)], "item_id long, text string, hash int")
    assert near_join.near_join(spark, clashing).count() == n
    assert exact_dedup.exact_dedup(spark, clashing).count() == n
    assert quality.classify(spark, clashing, labels).count() == n
    assert token_output.token_output(spark, clashing).count() == n
    assert secrets.find_secrets(spark, clashing).count() == n
    assert surrogates.replace_entities(spark, clashing, b"k").count() == n
    assert language_model.score_documents(spark, clashing).count() == n
    assert packing.pack(spark, clashing).agg(F.sum("length")).first()[0] > n
    assert {r.doc_id for r in decontaminate.contaminated(spark, clashing, items).collect()} == {1, 2, 3}
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), *NAMES[:5])
    assert html_extract.extract(spark, pages).count() == n


def test_pipeline_stages_keep_clashing_columns(spark, clashing, tmp_path):
    spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "said plainly and at some length")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, clashing, str(tmp_path))
        assert left.columns == clashing.columns, name
        assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0, name
    rows = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    assert rows(corpus_pipeline.exact(spark, clashing, "")) == [("1", TEXT), ("3", TEXT + " end"), ("4", ""), ("6", "another text about other things altogether, said plainly and at some length"), ("6", "x")]
    assert [r for r in rows(corpus_pipeline.near(spark, clashing, "")) if TEXT in r[1]] == [("1", TEXT)]
    assert ("6", "x") in rows(corpus_pipeline.decontaminate(spark, clashing, str(tmp_path))) and len(rows(corpus_pipeline.decontaminate(spark, clashing, str(tmp_path)))) == 7
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    assert "sequence_id" in corpus_pipeline.run(spark, str(tmp_path)).columns


def test_near_join_of_a_chain_and_of_ids_with_two_texts(spark, monkeypatch):
    """A chain of 5,000 texts, each like ten on both sides; unlike texts that share ids stay apart."""
    monkeypatch.setattr(near_join, "BLOCK_WEIGHT", 100_000)
    n, w = 5000, 100
    chain = spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda k: F.concat(F.lit("w"), (F.col("id") + k).cast("string"))), " ").alias("text"))
    words = lambda p: " ".join(f"{p}{i}" for i in range(60))
    ids = spark.createDataFrame([(10**6, words("l")), (10**6, words("m")), (10**6 + 1, words("l")), (10**6 + 2, words("m")), (None, words("l")), (None, words("n"))], "doc_id long, text string")
    rows = near_join.near_join(spark, chain.unionByName(ids)).collect()
    reach = max(d for d in range(w) if (w - 4 - d) >= 0.8 * (w - 4 + d) - 1e-9)
    got = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id < n}
    assert len(got) == n and {r.group_id for r in got.values()} == {0}
    assert all(got[i].n_links == min(i, reach) + min(n - 1 - i, reach) for i in range(n))
    rest = {(r.doc_id, r.class_id, r.class_size, r.group_id, r.n_links) for r in rows if r.doc_id is None or r.doc_id >= n}
    m = 10**6
    assert rest == {(m, m, 3, m, 2), (m + 1, m, 3, m, 2), (m, m, 2, m, 1), (m + 2, m, 2, m, 1), (None, m, 3, m, 2), (None, None, 1, None, 0)}


def test_digest_index_takes_more_rows_and_answers_look_ups(spark):
    """Flush, compact, look up; then flush more, compact again."""
    rows = lambda lo, hi: spark.range(lo, hi).select("id", F.sha2(F.concat(F.lit("t"), (F.col("id") % 700).cast("string")), 256).alias("digest"))
    index = exact_dedup.DigestIndex(spark)
    index.flush(rows(0, 500), memtable_rows=64).compact()
    digest = lambda k: rows(k, k + 1).first().digest
    assert index.probe([digest(3), digest(600)]).collect()[0].n == 1
    index.flush(rows(500, 1400), memtable_rows=64).compact()
    assert sorted((r.low, r.high, r.n) for r in index.probe([digest(3), digest(600)]).collect()) == [(3, 703, 2), (600, 1300, 2)]
    plan = index.probe([digest(3)])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(digest" in plan or "In(digest" in plan
