from __future__ import annotations

import random

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __kept string, n_words string, shard string, code string"


def document(number: int | None, text: str | None) -> tuple:
    """With columns beside whose names clash with those that operators make."""
    return number, text, "en", "src", len(text or ""), "x", "y", "z", "w"


def body(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randrange(2, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Nulls, empty, blank and very long texts, ties and repeated rows, copies and near copies, odd characters."""
    long = body(1, 60_000)
    base = body(2, 400)
    near = base.replace(base.split()[200], "changed", 1)
    texts: list[tuple] = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (5, base), (6, base), (7, near), (8, base + " tail"), (9, long),
        (10, "é" * 700 + " ☃ <|endoftext|> it's 'll 12   x"), (11, "=" * 3000), (12, "same line here\n" * 40), (5, base), (None, body(3, 30)), (None, body(3, 30)), (None, None),
        (13, "write to a.b@c.de or call +1 (415) 555-2671, host 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111, iban DE89 3704 0044 0532 0130 00"),
        *[(20 + i, body(100 + i, 5 + 13 * i)) for i in range(30)],
    ]
    return [document(n, t) for n, t in texts]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory) -> str:
    """The rows as tables in a folder, with labels and pages."""
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{root}/documents.parquet")
    labels = [(n, int(n not in (11, 12)), 0) for n in range(4, 50)] + [(None, 1, 0), (7, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root
