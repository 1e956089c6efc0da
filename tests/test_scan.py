"""Scans in parts, and what stands on them: a document's structure and its chunks, however long it is."""

import random

from pyspark.sql import functions as F

from lexloom.operators import chunking, scan, structure


def test_scans_equal_a_walk_over_each_group(spark):
    rnd = random.Random(1)
    rows = [(g, i, rnd.choice([None, None, "set", "clear"]), f"{g}-{i}", rnd.choice([None, 1, 5])) for g in range(4) for i in rnd.sample(range(200), 90 * (g > 0) + 3)]
    frame = spark.createDataFrame(rows, "g int, i int, what string, name string, n int").repartition(5)
    event = F.when(F.col("what") == "set", scan.setting(F.col("name"))).when(F.col("what") == "clear", scan.setting(F.lit(None).cast("string")))
    for backwards in (False, True):
        out = scan.scanned(frame, ["g"], {"p": F.floor(F.col("i") / 7)}, ["i"], last={"upto": event}, before={"past": event}, sums={"total": F.col("n")}, backwards=backwards)
        assert out.columns == [*frame.columns, "upto", "past", "total"]
        got = {(r.g, r.i): (r.upto, r.past, r.total) for r in out.collect()}
        known = {}
        for g in range(4):
            now, total = None, 0
            for _, i, what, name, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=backwards):
                past = now
                now = name if what == "set" else None if what == "clear" else now
                total += n or 0
                known[g, i] = (now, past, total)
        assert got == known
    assert scan.scanned(frame.limit(0), ["g"], {"p": F.col("i")}, ["i"], sums={"total": F.col("n")}).count() == 0


def test_one_long_document_is_many_tasks(spark, monkeypatch):
    """300,000 lines of one page, with headings far apart: parts know what was set long before them, and none holds more than its lines."""
    every = 25_000
    line = f"CASE WHEN id % {every} = 0 THEN 'Article ' || (1 + id DIV {every}) WHEN id % {every} = 1 THEN 'Title ' || id WHEN id = 130000 THEN 'ANNEX II' WHEN id % 1000 = 7 THEN '1. point' ELSE 'plain words ' || id END"
    rows = spark.range(300_000).selectExpr("1L AS document_id", "1 AS page", "CAST(id AS INT) AS line_no", f"{line} AS line")
    own = structure.carried(structure.typed(rows)).cache()
    at = {r.line_no: r for r in own.filter(F.col("line_no").isin(0, 1, 2, 24_999, 25_000, 129_999, 130_001, 150_001, 299_999)).collect()}
    assert at[1].ltype == "title" and at[24_999].article == "Article 1" and at[24_999].heading == "Title 1" and at[24_999].paragraph == "1"
    assert at[25_000].heading is None and at[129_999].annex is None and at[130_001].annex == "Annex II" and at[130_001].article is None
    assert at[150_001].article == "Article 7" and at[150_001].annex is None and at[299_999].heading == "Title 275001"
    assert own.filter("ltype = 'title'").count() == 12
    assert own.agg(F.max("block_no")).first()[0] == 12 + 1 + 300
    own.unpersist()


def test_a_title_is_found_across_parts(spark, monkeypatch):
    monkeypatch.setattr(structure, "PART_LINES", 2)
    lines = ["Article 1", "CHAPTER I", "First title", "Text one", "Article 2", "1. not a title", "Other", "Article 3 Inline", "Plain", "Article 4", "Late title"]
    rows = spark.createDataFrame([(1, 1, i, x) for i, x in enumerate(lines)], "document_id bigint, page int, line_no int, line string")
    out = structure.carried(structure.typed(rows)).orderBy("line_no").collect()
    assert [r.line for r in out if r.ltype == "title"] == ["First title", "Late title"]
    assert [r.heading for r in out] == [None, None, "First title", "First title", None, None, None, "Inline", "Inline", None, "Late title"]


def greedy(rows, most):
    """The merge, walked."""
    out = []
    for doc in sorted({r[0] for r in rows}):
        last = None
        for _, block, piece, text, num, annex, kind in sorted(r for r in rows if r[0] == doc):
            joins = last and last[2:4] == [num, annex] and "definition" not in (kind, last[5]) and len(last[1]) + len(text) + 1 <= most
            if joins:
                last[1] += "\n" + text
                last[4] = kind if last[4] == "body" else last[4]
                last[5] = kind
            else:
                last = [doc, text, num, annex, kind, kind, block, piece]
                out.append(last)
    return sorted((x[0], x[6], x[7], x[1], x[4]) for x in out)


def test_merges_equal_a_walk(spark, monkeypatch):
    for name, value in (("PART_BLOCKS", 5), ("STRETCH", 150)):
        monkeypatch.setattr(chunking, name, value)
    rnd = random.Random(8)
    rows = []
    for doc in range(6):
        num, annex = None, None
        for block in range(rnd.randrange(1, 90)):
            if rnd.random() < 0.15:
                num, annex = rnd.choice([(None, None), (1, None), (2, None), (None, "Annex I")])
            for piece in range(rnd.choice([1, 1, 1, 3])):
                rows.append((doc, block, piece, "abcdefghij"[: rnd.randrange(1, 10)] * rnd.randrange(1, 6), num, annex, rnd.choice(["body", "body", "list", "obligation", "definition"])))
    frame = spark.createDataFrame(rows, "document_id bigint, block_no int, piece_no int, text string, article_num int, annex string, kind string").repartition(4)
    out = chunking.merge_blocks(frame, 60)
    assert out.columns == frame.columns
    assert sorted((r.document_id, r.block_no, r.piece_no, r.text, r.kind) for r in out.collect()) == greedy(rows, 60)
    assert chunking.merge_blocks(frame.limit(0), 60).count() == 0


def test_a_run_of_a_million_pieces(spark):
    frame = spark.range(1_000_000).selectExpr("1L AS document_id", "CAST(id AS INT) AS block_no", "0 AS piece_no", "repeat('x', CAST(15 + id % 7 AS INT)) AS text", "3 AS article_num", "CAST(NULL AS STRING) AS annex", "'body' AS kind")
    out = chunking.merge_blocks(frame, 1600)
    got = out.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest")).first()
    chunks, held = 0, 0
    for i in range(1_000_000):
        size = 15 + i % 7
        held = held + 1 + size if chunks and held + 1 + size <= 1600 else size
        chunks += held == size
    assert got.n == chunks and got.longest <= 1600
    assert got.chars + got.n == sum(16 + i % 7 for i in range(1_000_000))


def test_short_and_long_blocks_are_computed_once(spark):
    frame = spark.range(4).selectExpr("id AS document_id", "CAST(id AS INT) AS block_no", "CASE id WHEN 0 THEN NULL WHEN 1 THEN 'short ' WHEN 2 THEN repeat('x', 60) ELSE concat(repeat('y', 70), repeat(' ', 400)) END AS text")
    out = chunking.split_blocks(frame, 60, 10)
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["document_id", "block_no", "text", "piece_no"]
    got = sorted((r.document_id, r.piece_no, r.text) for r in out.collect())
    assert got == [(1, 0, "short "), (2, 0, "x" * 60), (3, 0, "y" * 60), (3, 1, "y" * 20)]
