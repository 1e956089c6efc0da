"""Queries on sources: documents written as files of a format and read back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from .registry import query, table

PAGE_LINES = 30


def pdf_file(text: str) -> bytes:
    """A PDF file of ``text``: thirty lines a page, two-byte codes in the order of the characters, a ToUnicode map."""
    lines = text.split("\n")
    codes = {c: i + 1 for i, c in enumerate(sorted(set(text)))}

    def stream(data: bytes) -> bytes:
        packed = zlib.compress(data)
        return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed)

    shown = b"\n".join(b"<%04X> <%s>" % (i, c.encode("utf-16-be").hex().encode()) for c, i in codes.items())
    font = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R >>"
    own = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font, 4: stream(b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar\n" + shown + b"\nendbfchar")}
    starts = range(0, len(lines), PAGE_LINES)
    for i, at in enumerate(starts):
        said = b"\n".join(b"<%s> Tj T*" % "".join(f"{codes[c]:04X}" for c in line).encode() for line in lines[at : at + PAGE_LINES])
        own[5 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (6 + 2 * i)
        own[6 + 2 * i] = stream(b"BT /F1 10 Tf 12 TL 50 800 Td\n" + said + b"\nET")
    own[2] = b"<< /Type /Pages /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(starts)))
    out, places = b"%PDF-1.4\n", {}
    for number in sorted(own):
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, own[number])
    cross = b"xref\n0 %d\n0000000000 65535 f \n" % (len(own) + 1) + b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(own))
    return out + cross + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(own) + 1, len(out))


@query(
    f"WITH l AS (SELECT doc_id, unnest(range(len(parts))) AS no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)), "
    f"s AS (SELECT doc_id, no, CAST(no // {PAGE_LINES} + 1 AS INTEGER) AS page, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM l), "
    "p AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY no) AS text FROM s WHERE line <> '' GROUP BY ALL) SELECT doc_id, page, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM p"
)
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PDF file, read back page by page."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time
                data = pdf_file(batch.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([f"{batch.column(0)[i].as_py()}.pdf"]), pa.array([data], pa.binary())], names=["path", "content"])

    files = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(written, "path string, content binary")
    pages = readers.decoded_pages(files)
    return pages.select(F.regexp_extract("path", "^(-?[0-9]+)", 1).cast("bigint").alias("doc_id"), "page", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))
