"""Sections of text documents, found for all documents at once.

A document is one row, and its lines are one array in that row. Where a section starts and ends is worked out on small
rows - a heading and its line number - and the text itself is cut in the row that holds it, so text is moved at most
once, next to the sections asked for, and never once per name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinrun.functions.strings import WS, WS_INLINE, column, strip

# Markers of the parts of a documentation page, and the line that separates its sections.
INPUT_PART = rf"Input{WS}+Data{WS}+Explanations"
LOGIC_PART = rf"Pre-ETL{WS}+Business{WS}+Logics"
SECTION_MARK = "****"

_SPLIT_LINES = "\n"


def section_between(text: Column | str, start: str, end: str | None = None) -> Column:
    """The text after the first match of ``start`` up to the next match of ``end`` (or to the end of the text).

    ``start`` and ``end`` are regular expressions, matched in either case. NULL when ``start`` does not occur.
    """
    text = column(text)
    flags = "(?isu)"
    stop = rf"(?:{end}|\z)" if end else r"\z"
    found = F.regexp_extract(text, rf"{flags}{start}(.*?){stop}", 1)
    return F.when(text.rlike(flags + start), found)


def _lines(text: Column) -> Column:
    return F.split(text, _SPLIT_LINES)


def _with_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, lines``. Exploding an array of one keeps the split below what comes next, so lines are made once; and all
    that asks for them by ``key`` reads one exchange."""
    return docs.select(key, F.explode(F.array(_lines(F.col(text)))).alias("lines"))


def cut_lines(docs: DataFrame, spans: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``spans`` rows (``key``, first line ``s``, line after the last ``e`` or NULL) with their stripped ``block``; the
    lines of a document are made once, however many spans are cut from it."""
    size = F.coalesce(F.col("e"), F.size("lines")) - F.col("s")
    block = strip(F.array_join(F.slice("lines", F.col("s") + 1, size), "\n"))
    return spans.join(_with_lines(docs, key, text), key).withColumn("block", block).drop("lines", "s", "e")


# ---------------------------------------------------------------- blocks under known names


def _colons(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))


def _heads(line: Column, ends: Column, last: Column) -> Column:
    """What a line may be headed by, in lower case: its text before each of the first ``ends`` colons, and all of it.

    A heading is a line of its own, or followed by a colon; the name may hold colons itself. A bare name on the very
    last line does not count: its line has no end.
    """
    colons = _colons(line)
    text = lambda k: F.lower(strip(F.call_function("substring_index", line, F.lit(":"), k)))
    return F.transform(F.sequence(F.lit(1), F.least(colons - F.when(last, 1).otherwise(0), ends) + 1), text)


def _headings_of_page(pages: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """Lines headed by a name of their page: ``key, ln, head``. Each page meets its names once, in its row; of its lines
    only the headings leave it. Colons beyond those that a name of the page holds are not looked at."""
    held = names.groupBy(key).agg(F.collect_set("head").alias("heads"))
    most = F.array_max(F.transform("heads", _colons))
    rows = _with_lines(pages, key, text).join(held, key).withColumn("ends", most)

    def of_line(line: Column, ln: Column) -> Column:
        last = ln == F.size("lines") - 1
        none = last & (_colons(line) == 0)
        heads = F.when(none, F.array().cast("array<string>")).otherwise(_heads(line, F.col("ends"), last))
        return F.transform(heads, lambda h: F.struct(ln.alias("ln"), h.alias("head")))

    found = F.flatten(F.transform("lines", of_line))
    # Which of the names occur at all is found by hashing; lines are then compared with those alone.
    rows = rows.select(key, "heads", F.explode(F.array(found)).alias("found"))
    there = F.array_intersect(F.transform("found", lambda x: x["head"]), F.col("heads"))
    rows = rows.select(key, "found", F.explode(F.array(there)).alias("there")).where(F.size("there") > 0)
    hits = F.explode(F.filter("found", lambda x: F.array_contains("there", x["head"]))).alias("hit")
    return rows.select(key, hits).select(key, "hit.*").distinct()


def _heading_lines(pages: DataFrame, key: str, text: str, ends: int) -> DataFrame:
    """All lines that may be headings, for names of no certain page: ``key, ln, head``."""
    lines = _lines(F.col(text))
    rows = pages.select(key, F.size(lines).alias("n"), F.posexplode(lines).alias("ln", "line"))
    last = F.col("ln") == F.col("n") - 1
    heads = F.explode(_heads(F.col("line"), F.lit(ends), last)).alias("head")
    return rows.where(~last | (_colons(F.col("line")) > 0)).select(key, "ln", heads).where("head <> ''").distinct()


def named_blocks(
    pages: DataFrame, names: DataFrame, key: str = "page_id", text: str = "text", groups: Sequence[str] = ()
) -> DataFrame:
    """The block of every known name: ``*groups, key, name, block``.

    ``names`` holds ``name``, and may hold ``key`` (names of one page) and ``groups`` columns (names that belong
    together, such as the tables of one pipeline). A block starts at the first line headed by its name, in either case,
    and ends before the next line headed by another name of the same group; its own name repeated does not end it. A
    name may hold colons; one with a line end never has a block. With ``key`` in ``names`` a page's names are looked up in
    the page's row, and its lines move once, to meet them; work grows with the length of the lines times the most colons
    in a name.
    """
    per_page = [key] if key in names.columns else []
    known = names.select(*groups, *per_page, "name", F.lower("name").alias("head")).distinct()
    if per_page:
        heads = _headings_of_page(pages, known.where("head <> ''"), key, text).join(known, [key, "head"])
    else:
        most = known.agg(F.max(_colons(F.col("head")))).first()[0] or 0
        heads = _heading_lines(pages, key, text, most).join(known, "head")
    # Walking up from the bottom, each heading remembers the closest line below it that is headed by another name. Of
    # names that a line may be headed by, one going on after the colon of another, the longest counts.
    page = Window.partitionBy(*groups, key).orderBy(F.desc("ln"), F.desc(F.length("head")))
    of_line = (F.lag("ln").over(page) == F.col("ln")) & (F.lag("head").over(page) != F.col("head"))
    heads = heads.withColumn("shorter", F.coalesce(of_line, F.lit(False))).where("NOT shorter").drop("shorter")
    below = F.lag("head").over(page)
    other = F.when(below != F.col("head"), F.lag("ln").over(page))
    upward = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (
        heads.withColumn("other", other)
        .withColumn("e", F.last("other", ignorenulls=True).over(upward))
        .groupBy(*groups, key, "name")
        .agg(F.min(F.struct("ln", "e")).alias("first"))
        .select(*groups, key, "name", F.col("first.ln").alias("s"), F.col("first.e").alias("e"))
    )
    return cut_lines(pages, spans, key, text).select(*groups, key, "name", "block")


# ---------------------------------------------------------------- sections with a heading of their own


# Which form a piece of text belongs to; the first is preferred.
_MARKED, _HEADED = 1, 2

_MARK_LINE = rf"(?m)(?d)^{WS_INLINE}*{re.escape(SECTION_MARK)}{WS_INLINE}*\n"
_MARKED_HEADER = rf"(?s)^{WS}*([^:]*?){WS}*:{WS_INLINE}*\n(.*)\z"
# Hash signs and a space open a piece and end the one before. A hash directly followed by its name opens a section too,
# but ends none: it runs from inside a piece to the end of that piece.
_HASH_LINE = rf"(?m)(?d)^(?={WS_INLINE}*#+{WS})"
_INNER_HASH = rf"(?m)(?d)^(?={WS_INLINE}*#[^#\s])"
_HASH_HEADER = rf"^{WS}*#{WS}*([^:\n#][^:\n]*?){WS}*[:\n]"


def _parts(text: Column, form: int) -> Column:
    """The text cut at its marker or hash lines. What stands before the first marker line is no section."""
    parts = F.split(text, _MARK_LINE if form == _MARKED else _HASH_LINE)
    return F.slice(parts, 2, F.size(parts)) if form == _MARKED else parts


def _pieces(pages: DataFrame, key: str, text: str, forms: Sequence[int]) -> DataFrame:
    """Pieces of all forms one after the other: ``key, pos, form, part``; ``pos`` starts anew with each form."""
    found = [
        pages.select(key, F.lit(form).alias("form"), F.posexplode(_parts(F.col(text), form)).alias("pos", "part"))
        for form in forms
    ]
    return reduce(DataFrame.union, found)


def _openings(pieces: DataFrame, key: str) -> DataFrame:
    """Names that open a section, without any text: ``key, form, pos, sub, head`` (lower case)."""
    marked = F.when(
        strip(F.regexp_extract("part", _MARKED_HEADER, 2)) != "", F.regexp_extract("part", _MARKED_HEADER, 1)
    )
    headed = F.transform(F.split("part", _INNER_HASH), lambda x: F.regexp_extract(x, _HASH_HEADER, 1))
    names = F.when(F.col("form") == _MARKED, F.array(marked)).otherwise(headed)
    rows = pieces.select(key, "form", "pos", F.posexplode(names).alias("sub", "name")).where("name <> ''")
    return rows.select(key, "form", "pos", "sub", F.lower("name").alias("head"))


def _section_text() -> Column:
    """Text of the section that opens at ``sub`` of a piece."""
    inner = F.split("part", _INNER_HASH)
    part = F.array_join(F.slice(inner, F.col("sub") + 1, F.size(inner)), "")
    opened = F.regexp_extract(part, _HASH_HEADER, 0)
    body = F.substr(part, F.length(opened) + 1)
    # A bare heading directly followed by another one takes the text of that one.
    taken = F.when(~opened.endswith(":") & (body == ""), F.coalesce("after", F.lit(""))).otherwise(body)
    return strip(F.when(F.col("form") == _MARKED, F.regexp_extract("part", _MARKED_HEADER, 2)).otherwise(taken))


def _section_blocks(pages: DataFrame, names: DataFrame, key: str, text: str, forms: Sequence[int]) -> DataFrame:
    """``key, name, block`` of every wanted ``(key, name)`` that has a section; the first one counts.

    The sections are chosen on their names and positions alone; then each page meets its choices, once, and is cut in
    its own row (the explode of an array of one keeps the split below the join, as in ``cut_lines``). A name ends at a
    colon or at the line end here, so one that holds either has no section.
    """
    asked = names.select(key, "name", F.lower("name").alias("head")).distinct()
    pieces = _pieces(pages, key, text, forms)
    first = F.min(F.struct("form", "pos", "sub")).alias("at")
    chosen = _openings(pieces, key).join(asked, [key, "head"]).groupBy(key, "name").agg(first).select(key, "name", "at.*")
    cut = F.struct(*[_parts(F.col(text), form).alias(f"f{form}") for form in forms])
    pages = pages.select(key, F.explode(F.array(cut)).alias("parts"))
    of_form = F.coalesce(*[F.when(F.col("form") == form, F.col(f"parts.f{form}")) for form in forms])
    # A marked section never reads the next piece.
    after = F.when(F.col("form") == _HEADED, F.get(of_form, F.col("pos") + 1))
    found = chosen.join(pages, key).select(key, "name", "form", "sub", F.get(of_form, "pos").alias("part"), after.alias("after"))
    return found.select(key, "name", _section_text().alias("block"))


def marker_blocks(pages: DataFrame, names: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """The ``****`` section of every wanted ``(key, name)`` that has one: ``key, name, block``.

    A section opens with ``name:`` below a ``****`` line and ends at the next such line. One without text counts as
    absent (it does not take the text of the next one).
    """
    return _section_blocks(pages, names, key, text, [_MARKED])


def heading_blocks(pages: DataFrame, names: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """The ``# name`` section of every wanted ``(key, name)`` that has one: ``key, name, block``.

    A section ends at the next line of hash signs and a space. As a quirk of the format that is kept, a bare heading
    directly followed by another heading takes that section's text.
    """
    return _section_blocks(pages, names, key, text, [_HEADED])


def logic_blocks(pages: DataFrame, names: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """The section of every wanted name, in ``****`` form or else in ``#`` form, else an empty text."""
    found = _section_blocks(pages, names, key, text, [_MARKED, _HEADED])
    asked = names.select(key, "name").distinct()
    return asked.join(found, [key, "name"], "left").select(key, "name", F.coalesce("block", F.lit("")).alias("block"))
