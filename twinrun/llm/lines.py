"""Line dedup: hashes in range partitions with a secondary sort, and keep bitmaps per document instead of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinrun.llm.common import BLANKS, let, row_key, shuffle_partitions, table, text_of

#: Into so many ranges the lines of one key are dealt, so that a line in every document does not meet in one task.
SALTS = 32
WORD = 64


def line_keys(text: Column) -> Column:
    """128-bit hashes of the keys of all lines; NULL where the key is empty.

    A key is the line without BLANKS at both ends and with A-Z lower-cased. Lower-casing works on the bytes read as
    Latin-1, where ``lower`` is one fast pass: it also maps the lead bytes C0-DE to E0-FE, which keeps keys apart
    (the number of continuation bytes still tells two-byte characters from longer ones) and so changes no comparison.
    """
    folded = F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))

    def hashed(key: Column) -> Column:
        return F.when(key != "", F.struct(*[h.alias(n) for h, n in zip(row_key(key), ("h1", "h2"))]))

    return F.transform(F.split(folded, "\n"), lambda line: hashed(F.trim(line, F.lit(BLANKS))))


def line_bitmaps(docs: DataFrame, text: str = "text", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """Bitmaps of the lines to drop: ``k1, k2`` (key of the row), ``n_dropped``, ``bitmap``.

    A line goes when its key stands in at least ``min_docs`` documents; with ``keep_first`` the first occurrence of
    the key stays (smallest doc_id, NULL and missing ids before all, then document key, then position). ``bitmap`` is an array of (word, mask) in order, one long
    for each 64 lines with a dropped one among them; a set bit is a line to drop. Documents without such lines have
    no row.

    1. Count documents by key: keys are made distinct inside each row, then merged in each task before the shuffle.
    2. Deal line hashes and the frequent keys by range over (key, salt), sorted by document and position within; the
       frequent key, standing first, streams its verdict over the lines that follow. The salt splits every key the
       same way at every size, so no key meets in one task.
    3. Or the bits of the dropped lines together by document. No text moves.
    """
    spark = docs.sparkSession
    ident = (F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("bigint")).alias("ident")
    keyed = docs.select(ident, *[k.alias(n) for k, n in zip(_document_key(docs, text), ("k1", "k2"))], line_keys(text_of(text)).alias("keys"))
    id_type = keyed.schema["ident"].dataType
    each = keyed.select(F.explode(F.array_distinct("keys")).alias("h")).where("h IS NOT NULL")
    frequent = each.groupBy(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")).count().where(F.col("count") >= min_docs)
    marks = frequent.select(
        "h1",
        "h2",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        F.lit(True).alias("mark"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("ident", id_type), ("k1", "bigint"), ("k2", "bigint"), ("pos", "int"))],
    )
    lines = keyed.select("ident", "k1", "k2", F.posexplode("keys").alias("pos", "h")).where("h IS NOT NULL")
    lines = lines.select(
        F.col("h.h1").alias("h1"),
        F.col("h.h2").alias("h2"),
        F.pmod("k1", F.lit(SALTS)).cast("int").alias("salt"),
        F.lit(None).cast("boolean").alias("mark"),
        "ident",
        "k1",
        "k2",
        "pos",
    )
    ranged = marks.union(lines).repartitionByRange(shuffle_partitions(spark), "h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("mark").desc_nulls_last(), "ident", "k1", "k2", "pos")
    seen = ranged.withColumn("drop", F.first("mark").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumn("nth", F.row_number().over(stream))
    dropped = seen.where("mark IS NULL AND drop")
    if keep_first:
        # The first line of each range stands right behind the mark; the least of them over all ranges stays.
        heads = dropped.where("nth = 2").select("h1", "h2", "ident", "k1", "k2", "pos")
        least = heads.groupBy("h1", "h2").agg(F.min(F.struct("ident", "k1", "k2", "pos")).alias("at"))
        least = least.select(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"), F.col("at.pos").alias("pos"))
        dropped = dropped.select("k1", "k2", "pos").join(least, ["k1", "k2", "pos"], "left_anti")
    dealt = dropped.select("k1", "k2", "pos").repartition(shuffle_partitions(spark), "k1", "k2")
    masks = dealt.groupBy("k1", "k2", F.expr(f"pos DIV {WORD}").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, pos % {WORD}))").alias("mask")
    )
    bits = F.sort_array(F.collect_list(F.struct("word", "mask")))
    return masks.groupBy("k1", "k2").agg(F.sum(F.bit_count("mask")).cast("bigint").alias("n_dropped"), bits.alias("bitmap"))


def _document_key(docs: DataFrame, text: str) -> list[Column]:
    ids = [F.col("doc_id")] if "doc_id" in docs.columns else []
    return row_key(*ids, text_of(text))


def kept_lines(text: Column, bitmap: Column) -> Column:
    """The text without the lines set in a bitmap of ``line_bitmaps``; NULL bitmap: the text as it is."""

    def dense(words: Column) -> Column:
        def filled(w: Column, i: Column) -> Column:
            before = F.coalesce(F.get(words, i - 1)["word"], F.lit(-1).cast("bigint"))
            gap = (w["word"] - before - 1).cast("int")
            return F.concat(F.array_repeat(F.lit(0).cast("bigint"), gap), F.array(w["mask"]))

        return F.flatten(F.transform(words, filled))

    def kept(masks: Column) -> Column:
        def stays(_: Column, i: Column) -> Column:
            mask = F.coalesce(F.get(masks, F.floor(i / WORD).cast("int")), F.lit(0).cast("bigint"))
            return F.getbit(mask, i % WORD) == 0

        return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")

    return F.when(bitmap.isNull(), text).otherwise(let(dense(bitmap), kept))


def drop_repeated_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """Documents as ``doc`` (the whole input row) with ``n_lines``, ``n_dropped`` (long) and ``kept`` (the text left).

    NULL and empty texts are one empty line, which is never dropped. Every row is a document of its own, so repeated
    rows count as often as they stand there, and all get the same bitmap. An empty table gives an empty one. The
    input row travels as one struct, so its column names clash with nothing.
    """
    bitmaps = line_bitmaps(docs, text, min_docs, keep_first)
    keyed = docs.select(F.struct("*").alias("doc"), *[k.alias(n) for k, n in zip(_document_key(docs, text), ("k1", "k2"))])
    joined = keyed.join(bitmaps, ["k1", "k2"], "left")
    body = F.coalesce(F.col(f"doc.`{text}`").cast("string"), F.lit(""))
    return joined.select(
        "doc",
        F.size(F.split(body, "\n")).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
        kept_lines(body, F.col("bitmap")).alias("kept"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
    SELECT r, doc_id, i, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
          FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), frequent AS (
    SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
    SELECT r, doc_id, i, line, frequent.key IS NOT NULL AS dropped FROM lines LEFT JOIN frequent USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
