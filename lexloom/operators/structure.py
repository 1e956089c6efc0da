"""Structural parse of legal documents: lines to blocks with their place in the hierarchy, by scans over the parts of each document.

State that a heading sets and another clears is carried as structs: a set writes one around the value, a clear one around null. A document's lines lie in parts (``scan``), so
a document of any length is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structure import POINT, block_kind, is_blank, is_noise, line_type, part, section_path, unicode
from ..functions.text import strip
from .lineage import kept, new_folder
from .scan import scanned, setting

LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
PARAGRAPH = r"^\s*(\d{1,2})\.\s+(\S.*)$"


def lines(pages: DataFrame) -> DataFrame:
    """(document_id, page, line_no, line) from (document_id, page, text); no line for a final line end."""
    split = F.split(F.regexp_replace("text", f"(?:{LINE_ENDS})\\z", ""), LINE_ENDS)
    return pages.filter("text is not null").select("document_id", "page", F.posexplode(split).alias("line_no", "line"))


def clean(rows: DataFrame) -> DataFrame:
    """Without blank lines and page furniture; lines lose white space at their end."""
    own = rows.withColumn("line", F.regexp_replace("line", r"(?U)\s+$", ""))
    return own.filter(~is_blank(F.col("line")) & ~is_noise(F.col("line")))


#: Lines of a page that one part of a scan has at most.
PART_LINES = 4096
HEADINGS = ("annex", "chapter", "section", "article", "article_inline")
OPENERS = ("article", "article_inline")


def _parts() -> dict[str, Column]:
    """The parts in which a document's lines are scanned: runs of lines of a page."""
    return {"page": F.col("page"), "run": F.floor(F.col("line_no") / PART_LINES)}


def typed(rows: DataFrame, order: tuple[str, ...] = ("page", "line_no")) -> DataFrame:
    """Add ``ltype``. The first line after a bare article that is no heading is its title, if short and no paragraph or point.

    So the line is a title if, of the articles and plain lines before it, the last is a bare article.
    """
    own = _kept(rows.withColumn("ltype", line_type(F.col("line"))))
    heading = F.col("ltype").isin(*HEADINGS)
    mark = F.when(F.col("ltype").isin(*OPENERS) | ~heading, setting(F.col("ltype")))
    own = scanned(own, ["document_id"], _parts(), list(order), before={"__mark": mark})
    title = ~heading & F.coalesce(F.col("__mark") == "article", F.lit(False)) & (F.length("line") < 200)
    title = title & ~F.col("line").rlike(unicode(PARAGRAPH)) & ~F.col("line").rlike(unicode(POINT))
    return own.withColumn("ltype", F.when(title, "title").otherwise(F.col("ltype"))).drop("__mark")


def _kept(rows: DataFrame) -> DataFrame:
    return kept(rows, new_folder(rows.sparkSession))


def _event(sets: list[tuple[tuple[str, ...], Column]], clears: tuple[str, ...]) -> Column:
    event = F.when(F.col("ltype").isin(*clears), setting(F.lit(None).cast("string")))
    for kinds, value in sets:
        event = event.when(F.col("ltype").isin(*kinds), setting(value.cast("string")))
    return event


def carried(rows: DataFrame, order: tuple[str, ...] = ("page", "line_no")) -> DataFrame:
    """Typed lines with the structural state after each."""
    return carried_of_kept(_kept(rows), order)


def carried_of_kept(rows: DataFrame, order: tuple[str, ...] = ("page", "line_no")) -> DataFrame:
    """``carried`` of typed lines that are kept as they are, and are read twice."""
    line = F.col("line")
    number = F.when(F.col("ltype") == "article", part(line, "article")).otherwise(part(line, "article_inline"))
    plain = F.regexp_replace(number, "^0+(?=.)", "")
    marker = F.when(F.col("ltype") == "definition", part(line, "definition")).when(F.col("ltype") == "paragraph", part(line, "paragraph")).otherwise(part(line, "bare"))
    boundary = F.col("ltype").isin(*HEADINGS, "definition", "paragraph", "bare")
    events = {
        "annex": _event([(("annex",), F.concat(F.lit("Annex "), F.upper(part(line, "annex"))))], OPENERS),
        "chapter": _event([(("chapter",), F.concat(F.lit("Chapter "), F.upper(part(line, "chapter"))))], ("annex",)),
        "section": _event([(("section",), F.concat(F.lit("Section "), part(line, "section")))], ("annex", "chapter")),
        "article": _event([(OPENERS, F.concat(F.lit("Article "), plain))], ("annex",)),
        "article_num": _event([(OPENERS, plain)], ("annex",)),
        "heading": _event([(("article_inline",), strip(part(line, "article_inline", 2))), (("title",), strip(line))], ("annex", "article")),
        "paragraph": _event([(("definition", "paragraph", "bare"), marker)], HEADINGS),
    }
    out = scanned(rows, ["document_id"], _parts(), list(order), last=events, sums={"block_no": boundary.cast("int")})
    return out.withColumn("article_num", F.col("article_num").cast("int"))


def blocks(rows: DataFrame, order: tuple[str, ...] = ("page", "line_no")) -> DataFrame:
    """Blocks of carried lines: text, page and state of the opener (heading: of the last line), kind, section path; no empty ones."""
    spot = F.struct(*order)
    consumed = ~F.col("ltype").isin("annex", "chapter", "section", "article", "article_inline", "title")
    pieces = F.array_sort(F.collect_list(F.when(consumed, F.struct(spot.alias("at"), strip(F.col("line")).alias("line")))))
    first = {c: F.min_by(c, spot).alias(c) for c in ("page", "chapter", "section", "article", "article_num", "paragraph", "annex")}
    grouped = rows.groupBy("document_id", "block_no").agg(
        pieces.alias("pieces"), *first.values(), F.max_by("heading", spot).alias("heading"), F.min_by("ltype", spot).alias("opener")
    )
    text = strip(F.array_join(F.transform("pieces", lambda p: p["line"]), "\n"))
    own = grouped.withColumn("text", text).filter("text <> ''")
    kind = block_kind(F.col("text"), F.col("annex").isNotNull(), F.col("opener") == "definition")
    return own.withColumn("kind", kind).withColumn("section_path", section_path(*(F.col(c) for c in ("annex", "chapter", "section", "article")))).drop("pieces", "opener")


def parse(pages: DataFrame) -> DataFrame:
    """All steps, from pages to blocks."""
    return blocks(carried(typed(clean(lines(pages)))))


def article_counts(typed_rows: DataFrame) -> DataFrame:
    opener = typed_rows.filter(F.col("ltype").isin("article", "article_inline"))
    number = F.when(F.col("ltype") == "article", part(F.col("line"), "article")).otherwise(part(F.col("line"), "article_inline"))
    return opener.groupBy("document_id").agg(F.countDistinct(F.regexp_replace(number, "^0+(?=.)", "")).alias("article_count"))


def upgraded_kind(kind: Column, article_count: Column) -> Column:
    """A general document with three articles or more is a regulation."""
    return F.when((kind == "general") & (F.coalesce(article_count, F.lit(0)) >= 3), "regulation").otherwise(kind)
