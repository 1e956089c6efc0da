"""Queries over all rows, where vectors are missing."""

import pytest

from lexloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Sixty documents, eight of them with a vector; the first questions have vectors of their own."""
    root = str(tmp_path_factory.mktemp("whole"))
    spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 8 or vec_id >= 60").write.parquet(f"{root}/embeddings.parquet")
    return root


def test_answers_read_documents_without_a_stored_vector(spark, folder):
    rows = catalog.queries()["answer_path"](spark, folder).collect()
    assert len(rows) == 20 and next(r for r in rows if r.query_id == 0).n_sources == 6


def test_whole_forms_have_all_questions_and_documents(spark, folder):
    queries = catalog.queries()
    assert {r.query_id for r in queries["refusal_gate"](spark, folder).collect()} == set(range(20))
    assert max(r.chunk_id for r in queries["structure_score"](spark, folder).collect()) > 8
    assert {r.query_id for r in queries["comparison_coverage"](spark, folder).collect()} == set(range(20))


def test_every_document_is_listed_and_every_ready_one_scanned(spark, folder):
    queries = catalog.queries()
    assert sorted(r.place for r in queries["document_list"](spark, folder).collect()) == list(range(1, 61))
    assert len({r.chunk_id for r in queries["ready_scan"](spark, folder).collect()}) > 5
