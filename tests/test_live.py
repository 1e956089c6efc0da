"""Streams whose pieces are cut anywhere and come in any order."""

import json
import random

from pyspark.sql import functions as F

from lexloom.streaming import events, live


def files(spark, folder, batches, schema):
    """A stream with one batch for each list of rows."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_frames_cut_at_any_byte(spark, tmp_path):
    rnd = random.Random(4)
    texts = {}
    for stream in range(12):
        parts = ["data: " + json.dumps({"type": "token", "text": f"{stream} é☃ {i}" * rnd.randrange(4)}, ensure_ascii=False) for i in range(rnd.randrange(5))]
        texts[stream] = "\n\n".join([*parts, "data: {broken", ": comment", 'data: {"type": "done"}']) + "\n\n" + "data: {\"type\":\"do"
    pieces = []
    for stream, text in texts.items():
        data, at = text.encode(), 0
        while at < len(data):
            size = rnd.randrange(1, 9)
            pieces.append((stream, at, data[at : at + size]))
            at += size
    rnd.shuffle(pieces)
    pieces += pieces[:20]
    folder = f"file://{tmp_path}"
    stream = files(spark, f"{folder}/in", [pieces[i::4] for i in range(4)], "stream bigint, at bigint, data binary")
    out = sorted((r.stream, r.seq, r.event.type, r.event.text) for r in live.run(spark, live.frames(stream), f"{folder}/run").collect())
    known = events.parsed(spark.createDataFrame(list(texts.items()), "stream bigint, text string"), "text")
    assert out == sorted((r.stream, r.seq, r.event.type, r.event.text) for r in known.collect()) and len(out) > 20


def test_tokens_come_out_before_the_answer_ends(spark, tmp_path):
    words = {1: ["One ", "two ", "three"], 2: ["Only"], 3: [f"w{i} " for i in range(9)]}
    rows = [(q, n, w, n == len(own) - 1) for q, own in words.items() for n, w in enumerate(own)]
    early, late = [r for r in rows if r[1] in (0, 1, 5)], [r for r in rows if r[1] not in (0, 1, 5)]
    folder = f"file://{tmp_path}"
    stream = files(spark, f"{folder}/in", [early, late, late[:2]], "query_id bigint, n bigint, fragment string, last boolean")
    out = live.run(spark, live.spoken(stream), f"{folder}/run").orderBy("query_id", "seq").collect()
    for q, own in words.items():
        mine = [r for r in out if r.query_id == q]
        assert [r.text for r in mine if r.type == "token"] == own and [r.text for r in mine if r.type == "done"] == ["".join(own)]
        assert [r.seq for r in mine] == list(range(len(own) + 1))
    assert {(r.seq, r.batch) for r in out if r.query_id == 3 and r.seq in (0, 1, 5)} == {(0, 0), (1, 0), (5, 1)}


def test_a_stopped_stream_goes_on_with_its_unfinished_frame(spark, tmp_path):
    folder, schema = f"file://{tmp_path}", "stream bigint, at bigint, data binary"
    data = 'data: {"type":"token","text":"half and half"}\n\n'.encode()
    first = live.run(spark, live.frames(files(spark, f"{folder}/in", [[(1, 0, data[:20])]], schema)), f"{folder}/run")
    assert first.count() == 0
    whole = files(spark, f"{folder}/in", [[(1, 20, data[20:])]], schema)
    with live.stateful(spark):
        query = live.frames(whole).writeStream.foreachBatch(lambda own, n: own.select("event.text").write.mode("overwrite").parquet(f"{folder}/more/{n}")).option("checkpointLocation", f"{folder}/run/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    assert [r.text for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/more").collect()] == ["half and half"]


def test_a_table_of_pieces(spark):
    rows = [(1, 0, b"data: {\"type\":\"a\"}\n"), (1, 19, b"\n"), (2, 0, b"")]
    with live.stateful(spark):
        out = live.frames(spark.createDataFrame(rows, "stream bigint, at bigint, data binary")).select("stream", "seq", F.col("event.type")).collect()
    assert [tuple(r) for r in out] == [(1, 0, "a")]


def test_a_block_of_streams_is_one_key(spark, tmp_path):
    """Two hundred neighbours, others far away, and null; pieces come backwards over two batches."""
    streams = [*range(200), 5_000_000_000, -7, None]
    words = {q: [f"a{q} ", "b ", "c"] for q in streams}
    rows = [(q, n, w, n == 2) for q, own in words.items() for n, w in enumerate(own)]
    folder = f"file://{tmp_path}"
    stream = files(spark, f"{folder}/in", [[r for r in rows if r[1] > 0], [r for r in rows if r[1] == 0]], "query_id bigint, n bigint, fragment string, last boolean")
    out = live.run(spark, live.spoken(stream), f"{folder}/run")
    assert sorted((str(r.query_id), r.seq, r.text) for r in out.collect()) == sorted((str(q), n, t) for q, own in words.items() for n, t in enumerate([*own, "".join(own)]))
    assert live.by_block(spark.range(200), "id").count().count() == 1
