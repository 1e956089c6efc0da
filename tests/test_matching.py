from pyspark.sql import functions as F

from lexloom.operators import hybrid, matching


def test_terms_are_found_as_contains_finds_them(spark):
    terms = ["he", "she", "hers", "é", "a b", "he", "", "ZZ", "aaa"]
    texts = ["she and hers", "", None, "caféa b", "zz ZZ", "aaaa", "ushers" * 1000]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = {r.id: r.hits for r in frame.select("id", matching.contained(F.col("t"), terms).alias("hits")).collect()}
    assert out == {i: [n for n, term in enumerate(terms) if t is not None and term in t] for i, t in enumerate(texts)}
    assert frame.select(matching.contained(F.col("t"), []).alias("hits")).first().hits == []


def test_structure_scores_equal_one_contains_a_term(spark):
    chunks = spark.createDataFrame([(i, "ab"[i % 2], "xy"[i % 2], i % 4, f"Annex {i}", f"Body {i} of Some Term and other{i % 3}") for i in range(30)], "chunk_id bigint, doc_kind string, chunk_kind string, article_num int, section_path string, content string")
    plans = spark.createDataFrame([(1, ["a"], ["x"], [], [], ["SOME term", "nothing"]), (2, [], [], [3], ["Annex 7"], []), (3, ["z"], ["y"], [], [], ["other1"])], "query_id bigint, doc_kinds array<string>, preferred_chunk_kinds array<string>, article_refs array<int>, annex_refs array<string>, quoted_terms array<string>")
    own = sorted(tuple(r) for r in hybrid.structure_scores(chunks, plans).collect())
    pairs = hybrid.in_scope(chunks.crossJoin(plans), F.col("doc_kinds"), F.col("doc_kind"))
    score = hybrid.structure_score(F.col("chunk_kind"), F.col("content"), F.col("preferred_chunk_kinds"), F.col("quoted_terms"))
    bonus = hybrid.reference_bonus(F.col("article_num"), F.col("section_path"), F.col("article_refs"), F.col("annex_refs"))
    assert own == sorted(tuple(r) for r in pairs.select("query_id", "chunk_id", score, bonus).collect()) and len(own) == 75


def test_hits_meet_texts_that_stay_where_they_are(spark, tmp_path):
    from lexloom.operators import hybrid

    spark.range(300).selectExpr("id AS chunk_id", "repeat('text ', 2000) AS content").repartition(3).write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = hybrid.with_chunks(spark.range(5).selectExpr("1 AS query_id", "id AS chunk_id"), chunks)
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and both.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
