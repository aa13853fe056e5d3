"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinrun.llm.common import blank_pieces, let, table, text_of

# Symbols that are counted, and frequent words of English, French, German and Spanish.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from "
    "de la le et les en des un du une que pour est par avec dans qui pas sur au "
    "der die und den von zu das sich mit auf für ist im nicht dem ein eine als "
    "el y los las se del por con no su para es al lo"
).split()

#: Words in a window, and the share in percent of repeated words above which a text fails.
WINDOW = 5
REPEATED_PERCENT = 20
FEWEST_WORDS = 10
#: Share of stop words that prose has at least; that of the four languages has ten times as many and more.
LEAST_STOP_WORDS = 0.01


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high`` for texts of at least ``from_words`` words.

    Numerator and denominator name measures; a denominator of 0 lets a text pass. The bounds are checked by
    multiplication, so no rounding decides.
    """

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None
    from_words: int = 0

    def fails(self, measure: dict[str, Column]) -> Column:
        value = measure[self.numerator].cast("double")
        base = measure[self.denominator].cast("double") if self.denominator else F.lit(1.0)
        broken = F.lit(False)
        if self.low is not None:
            broken = broken | (value < base * F.lit(float(self.low)))
        if self.high is not None:
            broken = broken | (value > base * F.lit(float(self.high)))
        return broken & (base > 0) & (measure["n_words"] >= self.from_words)


#: The production table. Bounds are wide: prose of the four languages lies well inside all of them.
RULES = (
    Rule("word length", "word_chars", "n_words", low=2, high=12),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop words", "n_stop_words", "n_words", low=LEAST_STOP_WORDS, from_words=50),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more. Windows are told apart by 64-bit hashes within one text.

    A text without a repeated window is done after one hash set; otherwise the windows are sorted by hash, those
    equal to a neighbour are put back into text order, and the union of their spans is added up. O(n log n).
    """

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            def same(j: Column) -> Column:
                return F.coalesce(F.get(s, j)["g"], F.lit(None).cast("bigint"))

            hit = F.filter(
                s,
                lambda x, j: F.coalesce(x["g"] == same(j - 1), F.lit(False))
                | F.coalesce(x["g"] == same(j + 1), F.lit(False)),
            )
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        def span(starts: Column) -> Column:
            own = F.transform(
                starts,
                lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))),
            )
            return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(let(pairs, repeated), span)

    def joined(heads: Column, tails: Column, shift: int) -> Column:
        """Hashes of spans made of a span of ``heads`` and the span of ``tails`` that starts ``shift`` words later."""
        last = F.size(tails) - shift
        return F.zip_with(F.slice(heads, F.lit(1), last), F.slice(tails, F.lit(shift + 1), last), lambda a, b: F.xxhash64(a, b))

    def windows(hashes: Column) -> Column:
        # 5 = 2 + 2 + 1: pairs, pairs of pairs, and the last word.
        return let(let(joined(hashes, hashes, 1), lambda p: joined(p, p, 2)), lambda q: joined(q, hashes, 4))

    def count(grams: Column) -> Column:
        none = F.size(F.array_distinct(grams)) == F.size(grams)
        return F.when(none, F.lit(0).cast("bigint")).otherwise(covered(grams))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("bigint")).otherwise(let(let(hashes, windows), count))


def quality(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All measures of a text and the verdict, as one struct column: no shuffle, no user function.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word), n_stop_words (in any case)
    (long), base_failed, kept (boolean), failed_rules (array of rule names). NULL and empty texts have no words: all
    measures are 0, base_failed is true and kept false. Repeated rows and other columns make no difference. Work and memory
    are linear in a text, but for the windows of one that repeats some, which are sorted. An empty table gives no rows.
    """

    def measured(text: Column, pieces: Column, words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            (F.length(text) - F.size(pieces) + 1).cast("bigint").alias("word_chars"),  # a blank stands between pieces
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(lines).cast("bigint").alias("n_lines"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        )

    def judged(m: Column) -> Column:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
        measure = {n: m[n] for n in names}
        base = (m["n_words"] < FEWEST_WORDS) | (100 * m["n_repeat_words"] > REPEATED_PERCENT * m["n_words"])
        fails = {r.name: r.fails(measure) for r in rules}
        failed = F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in fails.items()], F.lit(None).cast("string")))
        broken = reduce(lambda a, b: a | b, fails.values(), F.lit(False))
        return F.struct(
            *[c.alias(n) for n, c in measure.items()],
            base.alias("base_failed"),
            (~base & ~broken).alias("kept"),
            failed.alias("failed_rules"),
        )

    def of_text(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
        return let(
            blank_pieces(text),
            lambda p: let(F.array_remove(p, ""), lambda w: let(lines, lambda ls: let(measured(text, p, w, ls), judged))),
        )

    return let(F.coalesce(text, F.lit("")), of_text)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    judged = docs.select("doc_id", quality(text_of("text")).alias("q"))
    return judged.select("doc_id", *[F.col(f"q.{f}") for f in fields])


_STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH base AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), grams AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n
    FROM (SELECT r, i, ws[i:i + 4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM base))
), repeated AS (
    SELECT r, count(DISTINCT i + k) AS n FROM grams, range(5) AS offsets(k) WHERE n > 1 GROUP BY r
), measured AS (
    SELECT doc_id, len(ws) AS n_words,
           CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
           coalesce(repeated.n, 0) AS n_repeat_words,
           len(list_filter(ws, lambda w: lower(w) IN ({_STOP_LIST}))) AS stops
    FROM base LEFT JOIN repeated USING (r)
), lined AS (
    SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 12 * n_words AND 10 * n_symbols <= n_words
       AND (n_words < 50 OR stops >= n_words * CAST(0.01 AS DOUBLE)) AND 2 * n_dup_lines <= n_lines AS kept
FROM lined
"""
