"""The context document of each pipeline: business logic, output table, input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinrun.functions.strings import blank_to_null
from twinrun.functions.text import html_to_text
from twinrun.operators.definitions import key_blocks, strip_definition_text, tables_to_search
from twinrun.operators.sections import INPUT_PART, LOGIC_PART, logic_blocks, named_blocks, section_between
from twinrun.session import computed_once

# Headings and placeholders of the document.
LOGIC_HEADING = "# Pre-ETL Business Logic"
OUTPUT_HEADING = "# Output Table"
INPUT_HEADING = "# Input Tables"
NO_LOGIC = "(No business logic section found.)"
NO_DEFINITION = "(No definition found.)"


def page_parts(pages: DataFrame) -> DataFrame:
    """``page_id, inputs, logic``: the two parts of each page, from its HTML in one pass. NULL when a part is missing."""
    text = pages.select("page_id", html_to_text("html").alias("text"))
    return text.select(
        "page_id",
        section_between("text", INPUT_PART, LOGIC_PART).alias("inputs"),
        section_between("text", LOGIC_PART).alias("logic"),
    )


def first_value(*choices: Column, default: str) -> Column:
    """The first choice that is neither NULL nor empty, else the placeholder."""
    return F.coalesce(*[blank_to_null(c) for c in choices], F.lit(default))


def merge_definitions(wanted: DataFrame, definitions: DataFrame, explanations: DataFrame) -> DataFrame:
    """``wanted`` rows (``pipeline, pos, table``) with their ``text``: definition file first, then page, then placeholder.

    ``definitions`` is keyed by ``table``; ``explanations`` by ``pipeline, table``. A table many pipelines use makes a
    hot key only on the narrow ``wanted`` side, which Spark splits.
    """
    joined = wanted.join(definitions.select("table", F.col("block").alias("defined")), "table", "left").join(
        explanations.select("pipeline", "table", F.col("block").alias("explained")), ["pipeline", "table"], "left"
    )
    text = first_value(F.col("defined"), F.col("explained"), default=NO_DEFINITION)
    return joined.select("pipeline", "pos", "table", text.alias("text"))


def context_parts(
    config: DataFrame, logic: DataFrame, definitions: DataFrame, explanations: DataFrame
) -> DataFrame:
    """The pieces of every document in order: ``pipeline, pos, text``. Joined by line ends they are the document.

    ``config`` holds ``pipeline, sources``; ``logic`` ``pipeline, block``; the others as in ``merge_definitions``.
    """
    pipelines = config.select("pipeline")
    logic_text = first_value(F.col("block"), default=NO_LOGIC)
    intro = pipelines.join(logic, "pipeline", "left").select(
        "pipeline",
        F.lit(-3).alias("pos"),
        F.concat(F.lit(LOGIC_HEADING + "\n## "), "pipeline", F.lit("\n"), logic_text, F.lit("\n")).alias("text"),
    )
    merged = merge_definitions(tables_to_search(config), definitions, explanations)
    is_output = F.col("pos") == -1
    tables = merged.select(
        "pipeline",
        F.when(is_output, -2).otherwise(F.col("pos")).alias("pos"),
        F.when(is_output, F.concat(F.lit(OUTPUT_HEADING + "\n## "), "table", F.lit("\n"), "text", F.lit("\n")))
        .otherwise(F.concat(F.lit("## "), "table", F.lit("\n\n"), "text", F.lit("\n")))
        .alias("text"),
    )
    heading = pipelines.select("pipeline", F.lit(-1).alias("pos"), F.lit(INPUT_HEADING).alias("text"))
    parts = intro.unionByName(tables).unionByName(heading)
    return parts.select("pipeline", (F.col("pos") + 3).alias("pos"), "text")


def assemble_context(parts: DataFrame) -> DataFrame:
    """One document per pipeline: ``pipeline, document``. For documents too large for a cell write the parts instead."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    joined = F.array_join(F.transform(ordered, lambda part: part["text"]), "\n")
    return parts.groupBy("pipeline").agg(F.concat(joined, F.lit("\n")).alias("document"))


def build_context(config: DataFrame, pages: DataFrame, corpus: DataFrame) -> DataFrame:
    """``context_parts`` from the raw tables.

    ``config``: ``pipeline, page_id, sources``; ``pages``: ``page_id, html``; ``corpus``: ``path, content``. The text of
    the pages is needed in several places; where the session names a shared folder it is worked out once.
    """
    used = pages.join(config.select("page_id"), "page_id", "left_semi")
    halves = computed_once(page_parts(used), "pages")
    tables = tables_to_search(config, ["page_id"])
    names = tables.select("pipeline", "page_id", F.col("table").alias("name"))
    inputs = halves.where("inputs is not null")
    blocks = named_blocks(inputs, names, "page_id", "inputs", groups=["pipeline"])
    explanations = blocks.select("pipeline", F.col("name").alias("table"), "block")
    asked = config.select("page_id", F.col("pipeline").alias("name"))
    found = logic_blocks(halves.where("logic is not null"), asked, "page_id", "logic")
    logic = config.join(found.withColumnRenamed("name", "pipeline"), ["page_id", "pipeline"]).select("pipeline", "block")
    found_blocks = key_blocks(corpus, tables.select(F.col("table").alias("key")))
    definitions = found_blocks.select(F.col("key").alias("table"), strip_definition_text("block").alias("block"))
    return context_parts(config, logic, definitions, explanations)
