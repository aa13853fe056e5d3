"""Definition files: which file defines a table, the block that does, and the parts of a definition worth keeping."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinrun.functions.strings import WS, bound, column
from twinrun.functions.text import output_table
from twinrun.operators.sections import cut_lines

# Table attributes that are dropped, and the one column attribute that is kept.
DROPPED_ATTRIBUTES = ("path", "primary_key", "control_list", "control_params", "storage_type")
KEPT_ATTRIBUTE = "description"

def _key_lines(corpus: DataFrame) -> DataFrame:
    """Lines that end in a colon: ``path, ln, key, e`` with ``e`` the line of the next unindented key (NULL at the end).

    Only these few lines are sorted per file; the text stays where it is.
    """
    lines = F.split("content", "\n")
    rows = corpus.select("path", F.posexplode(lines).alias("ln", "line")).where(F.col("line").rlike(rf":{WS}*$"))
    top = F.col("line").rlike(rf"(?U)^[^\s#]\w*{WS}*:{WS}*$")
    key = F.regexp_extract("line", rf"^{WS}*(.*?):{WS}*$", 1)
    flagged = rows.select("path", "ln", key.alias("key"), F.when(top, F.col("ln")).alias("top"))
    file = Window.partitionBy("path").orderBy(F.desc("ln"))
    below = file.rowsBetween(Window.unboundedPreceding, -1)
    return flagged.select("path", "ln", "key", F.last("top", ignorenulls=True).over(below).alias("e"))


def _first_place(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    # Least first: a key that stands in every file leaves each task as one row.
    place = _key_lines(corpus).groupBy("key").agg(F.min(F.struct("path", "ln", "e")).alias("at"))
    place = place.join(keys.select("key").distinct(), "key")
    return place.select("key", "at.path", F.col("at.ln").alias("s"), F.col("at.e").alias("e"))


def pick_file(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """The file that defines each key: ``key, path``. The key must stand alone on its line; the smallest path wins."""
    return _first_place(corpus, keys).select("key", "path")


def key_blocks(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """The definition of each key: ``key, path, block``, from its line up to the next unindented key."""
    return cut_lines(corpus, _first_place(corpus, keys), "path", "content").select("key", "path", "block")


def strip_attributes(attributes: Column | str) -> Column:
    """A table's MAP of attributes without the technical ones."""
    return F.map_filter(column(attributes), lambda name, _: ~name.isin(*DROPPED_ATTRIBUTES))


def strip_columns(columns: Column | str) -> Column:
    """A table's MAP of columns: only the description of each, where it has one; else all its attributes stay."""
    described = lambda _, value: F.when(
        F.map_contains_key(value, KEPT_ATTRIBUTE), F.map_filter(value, lambda name, _: name == KEPT_ATTRIBUTE)
    ).otherwise(value)
    return F.transform_values(column(columns), described)


def strip_keys(definitions: DataFrame) -> DataFrame:
    """``strip_attributes`` and ``strip_columns`` over the ``attributes`` and ``columns`` maps of a definitions table."""
    return definitions.withColumns(
        {"attributes": strip_attributes("attributes"), "columns": strip_columns("columns")}
    )


def _sections(rows: Column, starts: Callable[[Column, Column], Column]) -> Column:
    """Rows cut before each row that starts a section; rows before the first of them are left out."""
    marked = F.filter(F.transform(rows, lambda x, i: F.when(starts(x, i), i)), lambda i: i.isNotNull())
    cut = lambda at: F.transform(
        at, lambda p, k: F.slice(rows, p + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - p)
    )
    return bound(marked, cut)


def _first_indent(rows: Column) -> Column:
    return F.get(rows, F.lit(0))["indent"]


def _column_lines(rows: Column) -> Column:
    """Lines of one column: its name and the attributes that describe it, or all where none does."""

    def told(body: Column) -> Column:
        attributes = _sections(body, lambda x, _: (x["indent"] <= _first_indent(body)) & ~x["item"])
        return F.flatten(F.filter(attributes, lambda s: F.get(s, F.lit(0))["name"] == KEPT_ATTRIBUTE))

    described = bound(F.slice(rows, F.lit(2), F.size(rows)), told)
    return bound(described, lambda d: F.when(F.size(d) > 0, F.concat(F.slice(rows, 1, 1), d)).otherwise(rows))


def _attribute_lines(rows: Column) -> Column:
    """Lines of one attribute of a table: none of a dropped one, the columns of ``schema``, all of any other."""
    name = F.get(rows, F.lit(0))["name"]

    def columns(body: Column) -> Column:
        starts = lambda x, i: (i == 0) | ((x["indent"] <= _first_indent(body)) & ~x["item"])
        return F.flatten(F.transform(_sections(body, starts), _column_lines))

    kept = F.concat(F.slice(rows, 1, 1), bound(F.slice(rows, F.lit(2), F.size(rows)), columns))
    return F.when(name.isin(*DROPPED_ATTRIBUTES), F.slice(rows, 1, 0)).when(name == "schema", kept).otherwise(rows)


def strip_definition_text(block: Column | str) -> Column:
    """The same on the text of a definition, by its lines and their indentation: no parser is needed, and what stays
    stands as it was written.

    The first indented line gives the depth of the table's attributes. Below ``schema:`` the next depth holds columns,
    the one after it their attributes. List items at the depth of their key belong to it; blank lines go. Lines are cut
    into attributes, these into columns and those into what describes them, each line once per depth.
    """

    def described(line: Column) -> Column:
        return F.struct(
            (F.length(line) - F.length(F.ltrim(line))).alias("indent"),
            F.ltrim(line).startswith("-").alias("item"),
            F.trim(F.regexp_extract(line, r"^\s*([^:]+?)\s*:", 1), F.lit("'\"")).alias("name"),
            line.alias("line"),
        )

    def body(rows: Column) -> Column:
        depth = _first_indent(rows)
        starts = lambda x, i: (i == 0) | (x["indent"] < depth) | ((x["indent"] == depth) & ~x["item"])
        return F.transform(F.flatten(F.transform(_sections(rows, starts), _attribute_lines)), lambda x: x["line"])

    def stripped(lines: Column) -> Column:
        below = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda line: F.trim(line) != "")
        return F.array_join(F.concat(F.slice(lines, 1, 1), bound(F.transform(below, described), body)), "\n")

    return bound(F.split(column(block), "\n"), stripped)


def source_tables(config: DataFrame) -> DataFrame:
    """Input tables of each pipeline in order of its ``sources`` map: ``pipeline, pos, table``."""
    entries = config.select("pipeline", F.posexplode("sources").alias("pos", "source", "spec"))
    return entries.select("pipeline", "pos", F.col("spec.table_name").alias("table")).where("table is not null")


def tables_to_search(config: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Tables to look up for each pipeline: the output table first (``pos`` -1), then its inputs without it.

    ``pipeline, *carry, pos, table``; one scan of the configuration.
    """
    own = output_table("pipeline")
    none = F.lit(None).cast("string")
    output = F.array(F.struct(F.lit(-1).alias("pos"), own.alias("table")))
    specs = F.map_values("sources")
    inputs = F.transform(specs, lambda s, i: F.struct(i.alias("pos"), F.coalesce(s["table_name"], none).alias("table")))
    wanted = F.filter(inputs, lambda t: t["table"].isNotNull() & (t["table"] != own))
    every = F.concat(output, F.coalesce(wanted, F.slice(output, 1, 0)))
    return config.select("pipeline", *carry, F.explode(every).alias("t")).select("pipeline", *carry, "t.pos", "t.table")
