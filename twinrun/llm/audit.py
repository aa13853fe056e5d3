"""Audit of filters that are applied one after the other: what each removes, and what others would have removed anyway.

A text is measured once. Which of the filters it fails is a set of few bits, so documents are counted by part and set,
and every order of the filters is answered from these counts.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinrun.llm.common import table
from twinrun.llm.transducer import measures

#: When a text fails, by the measures of the transducer; COPY: it equals the text of a smaller doc_id.
COPY = "copy"
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "n_symbols > 0",
    "E": COPY,
}


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, part: str = "source", text: str = "text") -> DataFrame:
    """``part, fails, n, good, toxic``: documents by part and set of failed filters (bit i for filter i).

    Copies, of which there may be very many, are counted by task before they meet; what meets by text is one row for each
    part and label. Labels are joined to counts, so repeated rows are one row there too.
    """
    bits = {letter: 1 << i for i, letter in enumerate(filters)}
    copy_bit = sum(bits[x] for x, rule in filters.items() if rule == COPY)
    own = " + ".join(f"IF({rule}, {bits[x]}, 0)" for x, rule in filters.items() if rule != COPY) or "0"
    others = [
        F.col("doc_id").cast("bigint").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256)).alias("same"),
    ]
    counted = measures(docs, text, *others).groupBy("id", "part", "same", F.expr(own).alias("fails")).agg(F.count("*").alias("n"))

    # Rows without an id have no labels; the second key spreads them over all tasks.
    spread = F.when(F.col("id").isNull(), F.hash("same")).otherwise(0)
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"),
    )
    labelled = counted.withColumn("spread", spread).join(known.withColumn("spread", F.lit(0)), ["id", "spread"], "left")
    marks = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("is_good", "is_toxic")]
    copies = labelled.groupBy("same", "part", "fails", *marks).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
    )
    least = F.min("least.id").over(Window.partitionBy("same"))
    first = F.when(F.col("least.id") == least, F.col("least.n")).otherwise(0) + F.col("unnamed")
    split = copies.withColumn("first", first).select(
        "part",
        "is_good",
        "is_toxic",
        F.explode(F.array(
            F.struct(F.col("fails").alias("fails"), F.col("first").alias("n")),
            F.struct((F.col("fails") + copy_bit).alias("fails"), (F.col("n") - F.col("first")).alias("n")),
        )).alias("x"),
    )
    return split.groupBy("part", F.col("x.fails").alias("fails")).agg(
        F.sum("x.n").alias("n"),
        F.sum(F.when(F.col("is_good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("x.n")).otherwise(0)).alias("toxic"),
    )


def _steps(letters: str) -> list[dict]:
    """Every step of every order: its filter's bit and the bits of the filters before it."""
    out = []
    for order in map("".join, permutations(letters)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            out.append({"filter_order": order, "step": step, "bit": bit, "before": before})
            before |= bit
    return out


def interactions(failed: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """One row for each part, order and step from the counts of ``failures``, zeros included.

    ``kept`` after this step, ``removed`` here, ``redundant`` (fails here, removed before), ``unique_fails`` (fails this
    filter alone), ``good_lost`` and ``toxic_lost`` of the removed, and ``shapley``: what this filter removes, summed over
    all orders. In k! orders of k filters, each of the m filters a document fails is the first of them equally often.
    """
    letters = "".join(filters)
    shape = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    steps = F.from_json(F.lit(json.dumps(_steps(letters))), shape)
    sets = failed.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))

    def total(value: str, condition: str) -> str:
        return f"aggregate(filter(sets, x -> {condition}), 0L, (a, x) -> a + x.{value})"

    here = "x.fails & s.bit <> 0 AND x.fails & s.before = 0"
    columns = {
        "kept": total("n", "x.fails & (s.bit | s.before) = 0"),
        "removed": total("n", here),
        "redundant": total("n", "x.fails & s.bit <> 0 AND x.fails & s.before <> 0"),
        "unique_fails": total("n", "x.fails = s.bit"),
        "good_lost": total("good", here),
        "toxic_lost": total("toxic", here),
        "shapley": f"""aggregate(filter(sets, x -> x.fails & s.bit <> 0), 0L,
                       (a, x) -> a + x.n * ({factorial(len(letters))} div bit_count(x.fails)))""",
    }
    each = sets.select("part", "sets", F.explode(steps).alias("s"))
    return each.select("part", "s.filter_order", "s.step", *[F.expr(e).alias(c) for c, e in columns.items()])


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, part: str = "source") -> DataFrame:
    """The interactions of filters over whole texts, by part.

    NULL texts are empty, a NULL part is the empty string. Rows without an id are no copies of others, nor are
    repeated rows of one id copies of each other; a document counts once for each of its rows. Of several labels of one
    id, one that says 1 counts; an id without labels is neither good nor toxic. Further columns make no difference. A
    part with no failures has zeros; an empty table has no parts, so no rows.
    """
    return interactions(failures(docs, labels, filters, part), filters)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), marks AS (
    SELECT doc_id, max(quality = 1) AS g, max(toxic = 1) AS x FROM labels GROUP BY doc_id
), counted AS (
    SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
           len(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS n_distinct,
           length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals, min(doc_id) OVER (PARTITION BY t) AS least
    FROM docs
), failing AS (
    SELECT r, part, coalesce(g, false) AS good, coalesce(x, false) AS toxic,
           {'A': n_words < 200, 'B': 100 * n_distinct < 50 * n_words, 'C': 100 * n_capitals > 2 * length(t),
            'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS f
    FROM counted LEFT JOIN marks USING (doc_id)
), fails AS (
    SELECT r, part, good, toxic, l,
           CASE l WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END AS failed
    FROM failing, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l)
), sets AS (
    SELECT r, part, good, toxic, coalesce(list(l) FILTER (failed), []) AS s FROM fails GROUP BY ALL
), groups AS (
    SELECT part, s, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM (SELECT part, good, toxic, list_sort(s) AS s FROM sets) GROUP BY part, s
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letters AS a, letters AS b, letters AS c, letters AS d, letters AS e
    WHERE b.l <> a.l AND c.l NOT IN (a.l, b.l) AND d.l NOT IN (a.l, b.l, c.l) AND e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS l, string_split(filter_order[1:step - 1], '') AS before
    FROM orders, range(1, 6) AS t(step)
), rows AS (
    SELECT part, filter_order, step, l, n, good, toxic, list_contains(s, l) AS here, list_has_any(s, before) AS gone, len(s) = 1 AS alone
    FROM groups, steps
), told AS (
    SELECT part, filter_order, step, l,
           CAST(coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS BIGINT) AS kept,
           CAST(coalesce(sum(n) FILTER (here AND NOT gone), 0) AS BIGINT) AS removed,
           CAST(coalesce(sum(n) FILTER (here AND gone), 0) AS BIGINT) AS redundant,
           CAST(coalesce(sum(n) FILTER (here AND alone), 0) AS BIGINT) AS unique_fails,
           CAST(coalesce(sum(good) FILTER (here AND NOT gone), 0) AS BIGINT) AS good_lost,
           CAST(coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS BIGINT) AS toxic_lost
    FROM rows GROUP BY part, filter_order, step, l
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM told
"""
