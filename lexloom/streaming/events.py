"""Answers as ordered events, their server-sent framing, and its parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SOURCE = "struct<citation:string,score:double,chunk_id:bigint,short_label:string>"
FRAME = (
    "type string, stage string, question_type string, text string, confidence double, answer string, answer_path string, mode string, message string, "
    f"replaced boolean, elapsed_ms bigint, warnings array<string>, sources array<{SOURCE}>"
)


def events(answers: DataFrame) -> DataFrame:
    """(query_id, seq, type, payload) of finished answers: planning, retrieving, sources, generating, tokens, done.

    ``sources`` carries the evidence and comes before the text. A model's answer has a token for each of its ``fragments``, all else one. ``done`` carries the
    whole result; ``replaced`` tells that validation put another answer in place of what was streamed. A rejected question gives one
    ``error``. Columns that ``answers`` lacks are left out of the payloads.
    """
    kinds = {f.name: f.dataType for f in answers.schema}
    plain = {f.name: f.dataType for f in StructType.fromDDL(FRAME) if f.name != "sources"}

    def own(name: str) -> Column:
        return F.col(name) if name in kinds else F.lit(None).cast(plain[name])

    fields = {name: F.lit(None).cast(kind) for name, kind in plain.items() if name != "type"}
    fields["sources"] = F.lit(None).cast(kinds.get("sources", f"array<{SOURCE}>"))

    def event(kind: str, **values: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), *(values.get(k, v).alias(k) for k, v in fields.items()))

    sources = F.col("sources") if "sources" in kinds else fields["sources"]
    asked = F.coalesce(own("mode"), F.lit("ask")) == "ask"
    model = F.col("answer_path") == "synthesis"
    streamed = asked & (model | (own("replaced") == F.lit(True))) if "replaced" in kinds else asked & model
    whole = F.array("answer")
    fragments = F.when(streamed & (F.size("fragments") > 0), F.col("fragments")).otherwise(whole) if "fragments" in kinds else whole
    done = {k: own(k) for k in ("answer", "answer_path", "confidence", "question_type", "mode", "warnings", "elapsed_ms", "replaced")}
    before = F.array_compact(
        F.array(
            event("status", stage=F.lit("planning"), question_type=own("question_type")),
            event("status", stage=F.lit("retrieving")),
            event("sources", confidence=F.col("confidence"), sources=sources),
            F.when(streamed, event("status", stage=F.lit("generating"))),
        )
    )
    items = F.concat(before, F.transform(fragments, lambda t: event("token", text=t)), F.array(event("done", sources=sources, **done)))
    reason = F.try_element_at(own("warnings"), F.lit(1)) if "warnings" in kinds else F.lit(None).cast("string")
    items = F.when(F.col("answer_path") == "rejected", F.array(event("error", message=reason))).otherwise(items)
    return answers.select("query_id", F.posexplode(items).alias("seq", "event")).select("query_id", "seq", F.col("event.type").alias("type"), F.to_json("event").alias("payload"))


def framed(payload: Column) -> Column:
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def parsed(stream: DataFrame, column: str = "stream") -> DataFrame:
    """(seq, event) of complete frames of a stream's text; what follows the last blank line is not complete, malformed frames are left out."""
    frames = F.split(F.col(column), "\n\n")
    whole = F.slice(frames, 1, F.size(frames) - 1)
    others = [c for c in stream.columns if c != column]
    rows = stream.select(*others, F.posexplode(whole).alias("seq", "frame")).filter(F.startswith(F.col("frame"), F.lit("data: ")))
    return rows.select(*others, "seq", F.from_json(F.substring("frame", 7, 1 << 30), FRAME).alias("event")).filter("event.type is not null")
