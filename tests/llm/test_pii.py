import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from lexloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def fits(kind: str, match: str) -> bool:
    number = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 12 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15}[kind]


def plain(text: str) -> list[tuple[int, int, int, str]]:
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if fits(k, m.group()))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def hold(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r for r in pii.detect(frame).select("doc_id", pii.listed(pii.base_spans(F.col(pii.RESERVED))).alias("base")).collect()}
    for number, text in rows:
        assert out[number].base == listed(plain(text or "")), repr(text)


def test_base_spans_equal_the_plain_patterns(spark):
    import random

    rnd = random.Random(11)
    parts = ["a@b.c", "a@b.c_d@e.f", "x.@y.z.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00255.0.0.1", "4111111111111111", "4111 1111-1111 1111", "4111  1111", "+1 (415) 555-2671", "+1", "+12)", "+123456789", "+1234567890123456", " ", "-", ".", "é", "☃", "99", "@", "a", "\n", "_", "%"]
    hold(spark, [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))) for i in range(3000)])


def test_long_runs_are_linear(spark):
    hold(spark, [(1, "9" * 40_000), (2, "a" * 60_000), (3, "1.1." * 8000), (4, "+1" + " " * 20_000), (5, "a.b-" * 9000 + "@x"), (6, None), (7, "")])


def test_added_kinds_need_checksums_or_context(spark):
    rows = [(1, "my iban is DE89 3704 0044 0532 0130 00."), (2, "my iban is DE88 3704 0044 0532 0130 00."), (3, "ssn 536-22-1234"), (4, "part 536-22-1234"), (5, "GB82WEST12345698765432")]
    out = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", pii.listed(F.col(pii.RESERVED)).alias("spans")).collect()}
    assert "iban:11:38" in out[1] and "iban" not in out[2] and out[3] == "ssn:4:15" and out[4] == "" and out[5] == "iban:0:22"


def spans(spark, texts: list[str]) -> list[str]:
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: r.spans for r in pii.detect(frame).select("doc_id", pii.listed(F.col(pii.RESERVED)).alias("spans")).collect()}
    return [out[i] for i in range(len(texts))]


def test_context_decides_every_added_kind(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [
        "536-22-1234 (SSN)", "536-22-1234 (order)", "ssn of the sample 536-22-1234", "ssn " + "x " * 30 + "536-22-1234",
        "GB82WEST12345698765432", "GB82WEST12345698765432 is an example", "serial GB82WEST12345698765432",
        f'token = "{key}"', f"commit {key}", key, f"{key} is my password", f"token {'a' * 40}", f"token {'aB3-' * 200}", f"api_key: {'aB3_' * 10}",
    ]
    assert spans(spark, texts) == [
        "ssn:0:11", "", "", "", "iban:0:22", "", "", "secret:9:49", "", "", "secret:0:40", "", "secret:6:806", "secret:9:49",
    ]


def test_very_many_matches(spark):
    """Five megabytes with a quarter of a million addresses: every span is in its place, and four times as many matches cost no square of it."""
    import time

    one = "a.b@c.de 10.0.0.1 ok "
    took = []
    for many in (30_000, 120_000):
        frame = spark.createDataFrame([(1, one * many), (2, one * 700)], "doc_id bigint, text string")
        found = pii.detect(frame).select("doc_id", F.size(pii.RESERVED).alias("n"), F.slice(pii.RESERVED, -2, 2).alias("last"))
        began = time.time()
        out = {r.doc_id: r for r in found.collect()}
        took.append(time.time() - began)
        assert out[1].n == 2 * many and out[2].n == 1400
        at = len(one) * (many - 1)
        assert [(s.kind, s.start, s.end) for s in out[1].last] == [("email", at, at + 8), ("ip", at + 9, at + 17)]
    assert took[1] < 12 * took[0]
    text = {r.doc_id: r for r in pii.masked(frame).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("h")).collect()}
    assert text[1].h == hashlib.md5(("<EMAIL> <IP> ok " * many).encode()).hexdigest()


def test_masks_are_not_context(spark):
    frame = spark.createDataFrame([(1, "ssn 536-22-1234 or" + " " * 60 + "536-22-1235", "x")], f"doc_id bigint, text string, {pii.RESERVED} string")
    once = pii.masked(frame)
    assert once.columns == frame.columns and once.first()[pii.RESERVED] == "x"
    assert once.first().text == pii.masked(once).first().text and "536-22-1235" in once.first().text


def test_query_and_masking(spark, folder, docs, rows, no_docs):
    out = pii.op10_pii(spark, folder).collect()
    expected = Counter((n, hashlib.sha256(listed(plain(t or "")).encode()).hexdigest()) for n, t, *_ in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in out) == expected
    row = next(r for r in out if r.doc_id == 13)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1) and "iban" in row.spans
    masked = pii.masked(docs, n_chars="n_chars")
    assert masked.columns == docs.columns and masked.count() == docs.count()
    text = masked.filter("doc_id = 13").first()
    assert text.text == "write to <EMAIL> or call <PHONE>, host <IP> and 300.1.1.1, card <CARD>, iban <IBAN>" and text.n_chars == len(text.text)
    assert masked.filter("doc_id = 1").first().text is None and masked.filter("doc_id = 9").first().text == docs.filter("doc_id = 9").first().text
    assert pii.detect(no_docs).count() == 0
