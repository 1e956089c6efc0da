from lexloom.engine import Engine
from lexloom.operators.store import stored_name

from . import law


def test_engine(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "one.txt").write_text(law.ONE)
    (files / "two.md").write_text(law.TWO)
    (files / "bad.exe").write_text("x")
    engine = Engine(spark, f"file://{tmp_path}/store")
    out = {r.filename: (r.code, r.id) for r in engine.upload(str(files)).collect()}
    assert out == {"one.txt": (None, 1), "two.md": (None, 2), "bad.exe": (415, None)}
    again = {r.filename: r.code for r in engine.upload(str(files)).collect()}
    assert again["one.txt"] == 409 and engine.health().first().ready == 2
    assert [r.id for r in engine.list_documents().collect()] == [2, 1]
    asked = spark.createDataFrame([(1, "What is a 'kit'?"), (2, "What is an 'accessory'?")], "query_id bigint, question string")
    paths = {r.query_id: r.answer_path for r in engine.ask(asked, [2]).collect()}
    assert paths[1] == "direct" and paths[2] != "direct"
    kept = [r.stored_name for r in engine.store.documents().collect()]
    assert all((tmp_path / "store" / "files" / n).exists() for n in kept) and engine.health(probed=True).first().models.chat == "ok"
    assert engine.history().filter("elapsed_ms > 0").count() == 2 and "# Session export" in engine.export_markdown().first().markdown
    engine.clear_history()
    engine.delete_document(1)
    assert len(list((tmp_path / "store" / "files").glob("[!.]*"))) == 1
    assert engine.document(1).count() == 0 and engine.store.chunks().filter("document_id = 1").count() == 0


def test_files_past_the_limit_are_told(spark, tmp_path):
    from dataclasses import replace

    from lexloom.settings import DEFAULT

    files = tmp_path / "in"
    files.mkdir()
    for n in range(4):
        (files / f"{n}.txt").write_text(law.NOTE)
    engine = Engine(spark, f"file://{tmp_path}/store", settings=replace(DEFAULT, max_documents=2))
    out = {r.filename: (r.code, r.id) for r in engine.upload(str(files)).collect()}
    assert out == {"0.txt": (None, 1), "1.txt": (None, 2), "2.txt": (409, None), "3.txt": (409, None)}


def test_a_batch_of_questions_meets_the_model_once(spark, tmp_path):
    from lexloom.functions.models import RecordingChat

    files = tmp_path / "in"
    files.mkdir()
    (files / "one.txt").write_text(law.ONE)
    chat = RecordingChat(spark, "Makers keep files [MDR].")
    engine = Engine(spark, f"file://{tmp_path}/store", chat=chat)
    engine.upload(str(files))
    out = engine.ask(spark.createDataFrame([(1, "Who must keep technical files under Article 10?"), (2, "  ")], "query_id bigint, question string"))
    assert out.count() == 2 and out.filter("answer_path = 'rejected'").count() == 1
    assert {r.answer for r in out.collect()} == {"Makers keep files [MDR].", ""} and chat.calls == 1
    assert engine.history().count() == 1


def test_stored_names_differ(spark):
    from pyspark.sql import functions as F

    names = [r[0] for r in spark.range(3).select(stored_name(F.lit("a.PDF"))).collect()]
    assert len(set(names)) == 3 and all(n.endswith(".pdf") and len(n) == 36 for n in names)
