"""From files to answers over two small regulations."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom import schema
from lexloom.functions import models
from lexloom.functions.text import NO_ANSWER
from lexloom.operators import answer, chunking, hybrid, ingest, structure
from lexloom.operators.store import Store, reset_stale
from lexloom.sources import readers
from lexloom.streaming import events, landing

from . import law


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, 1, law.ONE), (2, 1, law.TWO), (3, 1, law.NOTE)], "document_id bigint, page int, text string").cache()


@pytest.fixture(scope="module")
def blocks(pages):
    return structure.parse(pages).cache()


def test_hierarchy(blocks):
    ten = blocks.filter("document_id = 1 and article_num = 10").orderBy("block_no").collect()
    assert {b.section_path for b in ten} == {"Chapter II > Article 10"} and ten[0].heading == "General obligations of makers"
    assert [b.paragraph for b in ten] == ["1", "2", "3"] and [b.kind for b in ten] == ["obligation", "obligation", "list"]
    assert blocks.filter("document_id = 1 and kind = 'definition'").count() == 3
    annex = blocks.filter("annex = 'Annex II'").first()
    assert annex.kind == "annex" and annex.article is None and annex.section_path == "Annex II"
    assert not blocks.filter("text like '%Official%' or text = '42'").collect()


def test_kinds(pages):
    out = {r.document_id: r for r in ingest.kinds(pages).collect()}
    assert (out[1].doc_kind, out[1].short_label, out[1].article_count) == ("mdr", "MDR", 4)
    assert out[2].doc_kind == "ivdr" and (out[3].doc_kind, out[3].article_count) == ("general", 0)


def test_general_documents_with_three_articles_are_regulations(spark):
    text = "A law without a number\n" + "\n".join(f"some words on Article\nARTICLE {n} b\nTitle\nText of the article goes here." for n in (1, 2, 3))
    rows = spark.createDataFrame([(1, 1, text)], "document_id bigint, page int, text string")
    assert ingest.kinds(rows).first().doc_kind == "regulation"


def test_inline_heading_quirk(spark):
    rows = spark.createDataFrame([(1, 1, "Article 4\nTitle\nBody text here\nArticle 10 of this law applies\nmore text here")], "document_id bigint, page int, text string")
    out = structure.parse(rows).orderBy("block_no").collect()
    assert [(b.article_num, b.heading) for b in out] == [(4, "Title"), (10, "of this law applies")]


def test_title_swallows_bare_paragraphs_but_not_numbered_ones(spark):
    rows = spark.createDataFrame([(1, 1, "Article 1\n1.\nBody of one is here"), (2, 1, "Article 1\n1. Body of one is here")], "document_id bigint, page int, text string")
    out = {b.document_id: b for b in structure.parse(rows).collect()}
    assert out[1].heading == "1." and out[1].paragraph is None and out[2].heading is None and out[2].paragraph == "1"


def test_lines_of_any_script_end_alike(spark):
    rows = spark.createDataFrame([(1, 1, "a\r\nb\x0bc d\x85e\n\nf\n")], "document_id bigint, page int, text string")
    assert [r.line for r in structure.lines(rows).orderBy("line_no").collect()] == ["a", "b", "c", "d", "e", "", "f"]


def walked(text, most, overlap):
    """The windows of a text, walked."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while True:
        stop = min(start + most, len(text))
        if stop < len(text):
            for mark in ("\n\n", "\n", ". "):
                at = text.rfind(mark, start, stop)
                if at - start > most // 2:
                    stop = at + len(mark)
                    break
        if piece := text[start:stop].strip():
            out.append(piece)
        if stop >= len(text):
            return out
        start = max(stop - overlap, start + 1)


def split(spark, texts, most, overlap):
    frame = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in chunking.split_blocks(frame, most, overlap).orderBy("document_id", "piece_no").collect():
        assert r.piece_no == len(out[r.document_id])
        out[r.document_id].append(r.text)
    return list(out.values())


def test_oversized_blocks_are_split_at_marks(spark):
    import random

    rnd = random.Random(3)
    words = ["word", "é☃", "x. y", "end.\n", "\n\n", "a" * 30, "   ", "𝕏𝕐", ". "]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 900))) for _ in range(40)]
    texts += ["short", "", "x" * 5000, " " * 4000, "line\n" * 900, " ".join(f"Sentence number {i} of the block." for i in range(400))]
    for most, overlap in ((1600, 200), (100, 20), (7, 2)):
        assert split(spark, texts, most, overlap) == [walked(t, most, overlap) for t in texts]
    assert split(spark, ["x" * 300], 50, 49) == [walked("x" * 300, 50, 49)]


def test_a_very_long_block_is_split_in_proportion(spark):
    text = "A sentence of a very long block. Another one\n" * 60_000
    assert split(spark, [text], 1600, 200) == [walked(text, 1600, 200)]



def test_chunks(blocks):
    chunks = chunking.build_chunks(blocks)
    for row in chunks.groupBy("document_id").agg(F.sort_array(F.collect_list("chunk_index")).alias("i"), F.max(F.length("content")).alias("m")).collect():
        assert row.i == list(range(len(row.i))) and row.m <= 1600
    ten = chunks.filter("document_id = 1 and article_num = 10").collect()
    assert len(ten) == 1 and ten[0].chunk_kind == "obligation" and ten[0].paragraph == "1"
    assert chunks.filter("chunk_kind = 'definition'").count() == 5


@pytest.fixture(scope="module")
def store(spark, pages, tmp_path_factory):
    own = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    ids = own.create(spark.createDataFrame([("a_one.txt", "s1", ".txt", 10), ("b_two.txt", "s2", ".txt", 20), ("c_note.txt", "s3", ".txt", 5), ("d_blank.txt", "s4", ".txt", 1)], "filename string, stored_name string, file_type string, size_bytes bigint"))
    assert list(ids) == [1, 2, 3, 4]
    ingest.ingest(own, pages, ids)
    return own


def test_store_life(store):
    docs = {r.id: r for r in store.documents().collect()}
    assert [docs[i].status for i in (1, 2, 3, 4)] == ["ready", "ready", "ready", "failed"]
    assert docs[1].short_label == "MDR" and docs[3].short_label == "c_note" and docs[1].chunk_count == store.chunks().filter("document_id = 1").count()
    assert docs[4].error and docs[1].indexed_at is not None


def ready(store):
    from lexloom.operators.store import ready_chunks

    return ready_chunks(store.chunks(), store.documents())


def ask(spark, store, *questions, reply=NO_ANSWER):
    frame = spark.createDataFrame(list(enumerate(questions)), "query_id bigint, question string")
    return {r.query_id: r for r in answer.answer(frame, ready(store), chat=models.ScriptedChat(reply)).collect()}


def test_answers(spark, store):
    out = ask(
        spark, store,
        "What is a 'gadget'?", "What is quantum chromodynamics?", "Who must keep technical files under Article 10?", "Compare obligations of makers in MDR and IVDR",
        "Compare the duties in the MDR", "   ", reply="Makers keep the files [MDR, Article 10(1), p. 1].",
    )
    assert set(out) == {0, 1, 2, 3, 4, 5} and out[5].answer_path == "rejected" and out[5].warnings == [answer.EMPTY]
    assert out[0].answer_path == "direct" and "intends for use on people" in out[0].answer and out[0].answer.endswith("[MDR, Article 2(1), p. 1]")
    assert any(s.highlights for s in out[0].sources)
    assert out[1].answer_path == "refused" and out[1].answer == NO_ANSWER and out[1].warnings
    assert out[2].answer_path == "synthesis" and out[2].sources[0].citation.startswith(("MDR, Article 10", "IVDR, Article 10"))
    assert out[3].mode == "compare" and out[3].answer_path == "synthesis" and {s.short_label for s in out[3].sources} == {"MDR", "IVDR"}
    assert out[4].answer_path == "refused" and out[4].answer.endswith("found for: .")


def test_one_sided_comparison_names_what_is_missing(spark, store):
    chunks = ready(store).filter("doc_kind = 'mdr'")
    frame = spark.createDataFrame([(1, "Compare obligations in MDR and IVDR")], "query_id bigint, question string")
    out = answer.answer(frame, chunks).first()
    assert out.answer_path == "refused" and out.answer.endswith("found for: IVDR.")


def test_article_reference_comes_first(spark, store):
    from lexloom.functions.planner import planned

    frame = planned(spark.createDataFrame([(1, "What does Article 13 say in the MDR?")], "query_id bigint, question string")).withColumn("query_vector", models.HashEmbedder().as_column(F.col("question")))
    hits = hybrid.retrieve(frame, ready(store)).orderBy("rank").collect()
    assert hits[0].article_num == 13 and hits[0].doc_kind == "mdr" and {h.doc_kind for h in hits} == {"mdr"}


def test_events(spark, store):
    frame = spark.createDataFrame([(1, "What is a 'gadget'?"), (2, "Who must keep technical files under Article 10?")], "query_id bigint, question string")
    done = answer.answer(frame, ready(store), chat=models.ScriptedChat("Makers [MDR]."))
    rows = events.events(done).orderBy("query_id", "seq").collect()
    types = {q: [r.type for r in rows if r.query_id == q] for q in (1, 2)}
    assert types[1] == ["status", "status", "sources", "token", "done"] and types[2] == ["status", "status", "sources", "status", "token", "token", "done"]
    payloads = {(r.query_id, r.seq): json.loads(r.payload) for r in rows}
    assert payloads[2, 4]["text"] + payloads[2, 5]["text"] == "Makers [MDR]." and payloads[2, 2]["sources"][0]["content"] and payloads[2, 2]["confidence"] > 0
    end = payloads[2, 6]
    assert end["answer"] == "Makers [MDR]." and end["replaced"] is False and end["mode"] == "ask" and end["sources"][0]["citation"] and "warnings" in end


def test_replaced_and_rejected_answers_as_events(spark, store):
    frame = spark.createDataFrame([(1, "Who must keep technical files under Article 10?"), (2, " "), (3, "x" * 3000)], "query_id bigint, question string")
    chat = models.ScriptedChat("The same sentence said over and over. " * 8)
    rows = events.events(answer.answer(frame, ready(store), chat=chat)).orderBy("query_id", "seq").collect()
    last = json.loads([r for r in rows if r.query_id == 1][-1].payload)
    assert last["type"] == "done" and last["replaced"] is True and last["answer"] == NO_ANSWER
    assert [(r.type, json.loads(r.payload)["message"]) for r in rows if r.query_id > 1] == [("error", answer.EMPTY), ("error", answer.TOO_LONG)]
    said = [json.loads(r.payload)["text"] for r in rows if r.query_id == 1 and r.type == "token"]
    assert "".join(said).startswith("The same sentence said") and len(said) > 40


def test_only_questions_without_a_direct_answer_reach_the_model(spark, store):
    chat = models.RecordingChat(spark, "Makers keep them [MDR, Article 10(1), p. 1].")
    frame = spark.createDataFrame([(1, "What is a 'gadget'?"), (2, "Who must keep technical files under Article 10?"), (3, "What is quantum chromodynamics?")], "query_id bigint, question string")
    out = {r.query_id: r for r in answer.answer(frame, ready(store), chat=chat).collect()}
    assert [out[i].answer_path for i in (1, 2, 3)] == ["direct", "synthesis", "refused"]
    assert {u.rsplit("Question: ", 1)[1] for _, u in chat.prompts} == {"Who must keep technical files under Article 10?"}


def test_scores_round_half_to_even(spark):
    row = spark.sql("select 1 as x").select(F.bround(F.lit(0.0625), 3).alias("a"), F.bround(F.lit(0.1875), 3).alias("b")).first()
    assert (row.a, row.b) == (0.062, 0.188)
    hits = spark.createDataFrame([(1, 1, 0.5, 0.0, "body", [])], "query_id int, rank int, score double, semantic_score double, chunk_kind string, preferred_chunk_kinds array<string>")
    assert hybrid.confidence(hits).first().confidence == 0.388  # 0.3875


def test_a_batch_that_is_tried_again_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    files = tmp_path / "in"
    files.mkdir()
    (files / "one.txt").write_text(law.ONE)
    (files / "two.txt").write_text(law.TWO)
    own = Store(spark, f"file://{tmp_path}/store")
    whole = landing.ingest

    def stopped(*_args, **_kwargs):
        raise RuntimeError("stopped")

    monkeypatch.setattr(landing, "ingest", stopped)
    with pytest.raises(Exception, match="stopped"):
        landing.watch(spark, str(files), own, f"{tmp_path}/checkpoint").awaitTermination()
    assert own.documents().count() == 2 and own.chunks().count() == 0
    landing.recover(own)
    monkeypatch.setattr(landing, "ingest", whole)
    landing.watch(spark, str(files), own, f"{tmp_path}/checkpoint").awaitTermination()
    assert [r.status for r in own.documents().collect()] == ["ready", "ready"]
    before = own.chunks().count()
    pages = spark.createDataFrame([(1, 1, law.ONE), (2, 1, law.TWO)], "document_id bigint, page int, text string")
    names = {r.filename: r.id for r in own.documents().collect()}
    ingest.ingest(own, pages.filter("document_id = 1").withColumn("document_id", F.lit(names["one.txt"]).cast("bigint")), spark.createDataFrame([(names["one.txt"],)], "id bigint"))
    assert before > 0 and own.chunks().count() == before


def test_history(spark, store):
    out = answer.answer(spark.createDataFrame([(1, "What is a 'gadget'?")], "query_id bigint, question string"), ready(store)).withColumn("elapsed_ms", F.lit(5))
    store.record(out)
    store.record(out)
    from lexloom.operators.store import export_markdown, recent

    rows = recent(store.history()).collect()
    assert [r.id for r in rows] == [2, 1] and rows[0].sources[0].citation
    assert export_markdown(store.history()).first().markdown.count("## What is a 'gadget'?") == 2
    store.clear_history()
    assert store.history().count() == 0


def test_delete_and_recovery(spark, pages, tmp_path):
    own = Store(spark, f"file://{tmp_path}/s")
    ids = own.create(spark.createDataFrame([("x.txt", "s1", ".txt", 10), ("y.txt", "s2", ".txt", 20)], "filename string, stored_name string, file_type string, size_bytes bigint"))
    ingest.ingest(own, pages.filter("document_id = 1"), ids[:1])
    own.update(reset_stale)
    assert [r.status for r in own.documents().orderBy("id").collect()] == ["ready", "failed"]
    own.delete([1])
    assert own.documents().count() == 1 and own.chunks().count() == 0


def test_a_batch_of_chunks_is_one_folder_whatever_its_documents(spark, pages, tmp_path):
    own = Store(spark, f"file://{tmp_path}/s")
    kinds = StructType.fromDDL(schema.CHUNKS)
    some = lambda ids, text: spark.createDataFrame([(n << 20, n, 0, text, None, 1, None, None, None, None, None, None) for n in ids], kinds)
    seen = lambda: sorted((r.document_id, r.content, r.chunk_kind) for r in own.chunks().collect())
    own.insert_chunks(some(range(40), "first"))
    assert len([p for p in (tmp_path / "s/chunks").iterdir() if p.is_dir()]) == 1
    own.insert_chunks(some([3, 4], "again"))
    assert seen() == sorted([(n, "again" if n in (3, 4) else "first", "body") for n in range(40)])
    own.delete([4, 5])
    assert seen() == sorted([(n, "again" if n == 3 else "first", "body") for n in range(40) if n not in (4, 5)])
    kept = spark.read.parquet(f"file://{tmp_path}/s/chunks")
    assert kept.filter("document_id in (4, 5)").count() == 0  # nor in the files


def test_small_files_are_packed(spark):
    own = landing.many_small_files(spark)
    assert own.conf.get("spark.sql.files.openCostInBytes") == "65536" and spark.conf.get("spark.sql.files.openCostInBytes") != "65536"
    assert own.conf.get("spark.sql.session.timeZone") == "UTC" and own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_landed_files_lie_in_few_folders(spark, tmp_path):
    rows = spark.createDataFrame([(f"f-{n}.txt", f"é {n}\nx" * (n % 3)) for n in range(300)], "name string, value string").repartition(3)
    pattern = landing.land(rows, f"file://{tmp_path}/in here")
    files = {p.name: p.read_text() for p in (tmp_path / "in here").rglob("*") if p.is_file()}
    assert files == {f"f-{n}.txt": f"é {n}\nx" * (n % 3) + "\n" for n in range(300)}  # no checksum files beside them either
    assert len([p for p in (tmp_path / "in here").rglob("*") if p.is_dir()]) == landing.FOLDERS
    assert spark.read.format("binaryFile").load(pattern).count() == 300
    assert landing.land(rows.limit(0), f"file://{tmp_path}/none") and not [p for p in (tmp_path / "none").rglob("*") if p.is_file()]


def test_files_land_on_a_store_that_is_not_mounted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "mounted", lambda *_: None)
    pattern = landing.land(spark.createDataFrame([(f"f-{n}.txt", f"{n}") for n in range(9)], "name string, value string"), f"file://{tmp_path}/in")
    assert sorted(bytes(r.content) for r in spark.read.format("binaryFile").load(pattern).collect()) == [b"%d\n" % n for n in range(9)]


def test_a_batch_reads_its_files_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text(law.ONE)
    own, whole = Store(spark, f"file://{tmp_path}/store"), landing.ingest

    def after_they_went(*args, **kwargs):
        (tmp_path / "in" / "one.txt").unlink()
        whole(*args, **kwargs)

    monkeypatch.setattr(landing, "ingest", after_they_went)
    landing.watch(spark, f"{tmp_path}/in", own, f"{tmp_path}/check").awaitTermination()
    assert [(r.filename, r.status) for r in own.documents().collect()] == [("one.txt", "ready")] and own.chunks().count() > 0


def docx(path, paragraphs, cells):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as file:
        file.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{"".join(map(p, paragraphs))}{table}</w:body></w:document>')


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"good \xff text")
    (tmp_path / "b.md").write_text(" \n ")
    docx(tmp_path / "c.docx", ["One", "", "Two"], ["x", "y"])
    out = {r.path.rsplit("/", 1)[1]: (r.page, r.text) for r in readers.read_pages(spark, str(tmp_path)).collect()}
    assert out == {"a.TXT": (1, "good � text"), "c.docx": (1, "One\nTwo\nx | y")}
    (tmp_path / "d.exe").write_bytes(b"x")
    with pytest.raises(readers.UnsupportedFileType):
        readers.read_pages(spark, str(tmp_path))


def test_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text(law.ONE)
    own = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        landing.watch(spark, f"{tmp_path}/in", own, f"{tmp_path}/check").awaitTermination()
    (tmp_path / "in" / "two.txt").write_text(law.TWO)
    landing.watch(spark, f"{tmp_path}/in", own, f"{tmp_path}/check").awaitTermination()
    assert sorted((r.filename, r.status) for r in own.documents().collect()) == [("one.txt", "ready"), ("two.txt", "ready")]


def test_scope_falls_back_only_if_asked(spark):
    pairs = spark.createDataFrame([(1, "a", ["a"]), (1, "b", ["a"]), (2, "a", ["z"]), (3, "b", [])], "query_id bigint, kind string, wanted array<string>")
    loose, strict = (sorted((r.query_id, r.kind) for r in hybrid.in_scope(pairs, F.col("wanted"), F.col("kind"), s).collect()) for s in (False, True))
    assert loose == [(1, "a"), (2, "a"), (3, "b")] and strict == [(1, "a"), (3, "b")]


def test_annex_references_match_as_text(spark):
    bonus = hybrid.reference_bonus(F.lit(1), F.lit("Annex II > x"), F.array().cast("array<int>"), F.array(F.lit("Annex I")))
    assert spark.range(1).select(bonus.alias("b")).first().b == 0.5
