"""WARC derivatives: responses become linked metadata and plain-text conversion records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinrun.llm.common import let, table

CRLF = "\r\n"

# The format's version line, tags that end a line, and entities in the order they are decoded.
VERSION = "WARC/1.1"
#: Elements whose content is no text, and tags that end a line (what their names begin with).
UNSEEN = ("script", "style")
LINE_END = r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/title|/article|/section|/nav|hr)[^>]*>"
#: The same tags, tried with fewer steps.
_LINE_END = r"(?i)<(?:[bh]r|/(?:p|div|h[1-6]|li|tr|title|article|section|nav))[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
DATE = "1970-01-01T00:00:00Z"


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; NULL without one."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substr(text, at + len(mark)))


def _up_to_last(text: Column, mark: str) -> Column:
    """The text up to the last ``mark`` and with it; empty without one."""
    return F.substr(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, mark, -1)))


def _replaced(text: Column, last: str, opening: str, pattern: str, by: str) -> Column:
    """A pattern that begins with ``opening`` and ends with ``last`` replaced. Behind the last ``last`` it is not looked for
    where something opens there, so no search runs to the end in vain, and the work is linear."""

    def whole(t: Column) -> Column:
        head = lambda h: F.concat(F.regexp_replace(h, pattern, by), F.substr(t, F.length(h) + 1))
        safely = let(_up_to_last(t, last), head)
        behind = F.substring_index(t, last, -1)
        return F.when(~F.contains(t, F.lit(opening)), t).when(F.contains(behind, F.lit(opening)), safely).otherwise(F.regexp_replace(t, pattern, by))

    return let(text, whole)


def _without_element(text: Column, name: str) -> Column:
    """Passages from an opening tag to the next closing one become a space. Each match begins where the last one ended, so an
    opening tag that nothing closes is tried once and ends the search: the work is linear whatever is left open."""
    upto = lambda mark: f"(?>[^<]*)(?:<(?!{mark})(?>[^<]*))*+"
    pattern = f"(?i)\\G({upto(name)})<{name}{upto('/' + name)}</{name}(?>[^>]*)>"
    return F.regexp_replace(text, pattern, "$1 ")


def _where(text: Column, marks: tuple[str, ...], pattern: str, by: str) -> Column:
    """A pattern replaced where one of ``marks`` is found; without them there is no match, and looking for them costs less."""

    def if_any(t: Column) -> Column:
        return F.when(reduce(Column.__or__, [F.contains(t, F.lit(m)) for m in marks]), F.regexp_replace(t, pattern, by)).otherwise(t)

    return let(text, if_any)


def _tidied(text: Column) -> Column:
    """Runs of blanks become one space; lines lose the blanks at their ends, and empty ones go."""
    lines = F.split(_where(text, ("\t", "\r", "\x0b", "\x0c"), r"[\t\r\x0b\x0c]", " "), "\n")
    kept = F.array_remove(F.transform(lines, lambda x: F.trim(x)), "")
    return _where(F.array_join(kept, "\n"), ("  ",), " {2,}", " ")


def plain_text(html: Column) -> Column:
    """Text of a page: comments, scripts and styles go, some tags end a line, all others go, entities are decoded,
    runs of blanks become one space and empty lines go. What is not closed is read as text. Work is linear in the page,
    also where a great many comments, scripts or tags are opened and none is closed."""
    text = _replaced(html, "-->", "<!--", "(?s)<!--.*?-->", " ")
    text = reduce(_without_element, UNSEEN, text)
    text = _replaced(_replaced(text, ">", "<", _LINE_END, "\n"), ">", "<", "<[^>]*>", "")
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    return _tidied(text)


def _title(html: Column) -> Column:
    # The first opening tag alone is tried, so the work is linear.
    inside = F.regexp_extract(html, "(?is)\\A(?>.*?<title)(?>[^>]*>)(.*?)</title", 1)
    return F.trim(F.regexp_replace(inside, r"[\t\r\n ]+", " "))


def _language(html: Column) -> Column:
    tag = F.regexp_extract(html, "(?is)\\A(?>.*?<html)([^>]*)", 1)
    return F.regexp_extract(tag, "(?is)^.* lang=\"([^\"]*)\"", 1)


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def record_id(kind: str, *parts: Column) -> Column:
    """A record id that follows from what it names, in the form of a UUID."""
    name = F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    h = F.sha2(name, 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses_of(pages: DataFrame) -> DataFrame:
    """Pages as responses: ``page_id, record_id, target_uri, date, http_headers, payload``. NULL html is no payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html))
    return pages.select(
        "page_id",
        record_id("response", F.col("url"), F.col("page_id"), F.sha2(html, 256)).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        headers.alias("http_headers"),
        html.alias("payload"),
    )


def _fields(*fields: tuple[str, Column | str]) -> Column:
    """Header lines ``name: value``, each ended by CRLF; fields that are NULL are left out."""
    lines = [F.concat(F.lit(f"{n}: "), v if isinstance(v, Column) else F.lit(v), F.lit(CRLF)) for n, v in fields]
    return F.concat_ws("", *lines)


def derive(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records for each response: ``key, warc_type, record_id, refers_to, concurrent_to, target_uri, content_type,
    content_length, block_digest, source_digest, record``.

    The conversion holds the plain text. The metadata record names the source (id, HTTP status line and headers,
    digest) and what was found in it. Both refer to the response and to each other; ids follow from the response's id,
    so a repeated run or a repeated row gives the same ids. ``record`` is the whole record up to its two final line
    ends. Responses may bring ``payload_digest`` (the source's WARC-Payload-Digest, which then is the source's digest) and
    ``warc_headers`` (its own header lines, carried as they are). A NULL target is left out of the headers; NULL payloads
    give an empty text; without a date it is 1970. Other columns are left out; an empty table gives no rows. Work is
    linear in a page. One projection and one explode: nothing is shuffled.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    own = digest(payload)
    base = responses.select(
        F.col(key).alias("key"),
        F.col("record_id").alias("source"),
        F.col("target_uri").alias("uri"),
        F.coalesce("date", F.lit(DATE)).alias("date"),
        F.coalesce("http_headers", F.lit("")).alias("http"),
        plain_text(payload).alias("text"),
        (F.coalesce("payload_digest", own) if "payload_digest" in responses.columns else own).alias("source_digest"),
        (F.coalesce("warc_headers", F.lit("")) if "warc_headers" in responses.columns else F.lit("")).alias("warc"),
        _title(payload).alias("title"),
        _language(payload).alias("language"),
    )
    ids = {kind: record_id(kind, F.col("source")) for kind in ("metadata", "conversion")}
    about = _fields(
        ("source-record-id", F.col("source")),
        ("source-payload-digest", F.col("source_digest")),
        ("title", F.nullif("title", F.lit(""))),
        ("language", F.nullif("language", F.lit(""))),
        ("text-characters", F.length("text").cast("string")),
    )
    # Source headers are kept as they came, one field for each line.
    for name, of in (("warc", "source-warc-header"), ("http", "source-http-header")):
        given = F.filter(F.split(name, CRLF), lambda x: x != "")
        about = F.concat(about, F.array_join(F.transform(given, lambda x: F.concat(F.lit(f"{of}: "), x, F.lit(CRLF))), ""))

    # Ids and digests are columns of their own: in the explode they would be worked out wherever they are named.
    base = base.withColumns({"about": about} | {f"{kind}_id": name for kind, name in ids.items()})
    base = base.withColumns({f"{name}_digest": digest(F.col(name)) for name in ("about", "text")})

    def record(kind: str, other: str, content_type: str, name: str) -> Column:
        block, block_digest = F.col(name), F.col(f"{name}_digest")
        own_id, other_id = F.col(f"{kind}_id"), F.col(f"{other}_id")
        head = _fields(
            ("WARC-Type", kind),
            ("WARC-Record-ID", own_id),
            ("WARC-Refers-To", F.col("source")),
            ("WARC-Concurrent-To", other_id),
            ("WARC-Target-URI", F.col("uri")),
            ("WARC-Date", F.col("date")),
            ("WARC-Block-Digest", block_digest),
            ("Content-Type", content_type),
            ("Content-Length", F.octet_length(block).cast("string")),
        )
        return F.struct(
            F.lit(kind).alias("warc_type"),
            own_id.alias("record_id"),
            F.col("source").alias("refers_to"),
            other_id.alias("concurrent_to"),
            F.col("uri").alias("target_uri"),
            F.lit(content_type).alias("content_type"),
            F.octet_length(block).cast("bigint").alias("content_length"),
            block_digest.alias("block_digest"),
            F.col("source_digest"),
            F.concat(F.lit(VERSION + CRLF), head, F.lit(CRLF), block).alias("record"),
        )

    two = F.array(
        record("metadata", "conversion", "application/warc-fields", "about"),
        record("conversion", "metadata", "text/plain; charset=utf-8", "text"),
    )
    return base.select(F.col("key").alias(key), F.explode(two).alias("r")).select(key, "r.*")


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records to files, one for each partition. The writer's line end closes each record."""
    records.select("record").write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses_of(table(spark, sf_dir, "pages")))


def _uuid(kind: str, name: str) -> str:
    h = f"sha256('{kind}|' || {name})"
    cut = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cut} || '>'"


def _sql() -> str:
    text = "payload"
    for rx in ("(?is)<!--.*?-->", *[f"(?is)<{name}[^>]*>.*?</{name}[^>]*>" for name in UNSEEN]):
        text = f"regexp_replace({text}, '{rx}', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{LINE_END}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for entity, character in ENTITIES:
        text = f"replace({text}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    text = f"regexp_replace(regexp_replace({text}, '[\\t\\r\\x0b\\x0c ]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    crlf, nl = "(chr(13) || chr(10))", " || chr(13) || chr(10)"
    optional = "CASE WHEN {0} <> '' THEN '{0}: ' || {0}" + nl + " ELSE '' END"
    http = f"'source-http-header: HTTP/1.1 200 OK'{nl} || 'source-http-header: Content-Type: text/html; charset=utf-8'{nl} || 'source-http-header: Content-Length: ' || octet_length(encode(payload)){nl}"

    def record(kind: str, other: str, content_type: str, block: str) -> str:
        return f"""
        SELECT page_id, '{kind}' AS warc_type, {kind}_id AS record_id, source AS refers_to, {other}_id AS concurrent_to,
               url AS target_uri, '{content_type}' AS content_type, CAST(octet_length(encode({block})) AS BIGINT) AS content_length,
               'sha256:' || sha256({block}) AS block_digest, source_digest,
               '{VERSION}'{nl} || 'WARC-Type: {kind}'{nl} || 'WARC-Record-ID: ' || {kind}_id{nl} || 'WARC-Refers-To: ' || source{nl}
               || 'WARC-Concurrent-To: ' || {other}_id{nl} || coalesce('WARC-Target-URI: ' || url{nl}, '')
               || 'WARC-Date: {DATE}'{nl} || 'WARC-Block-Digest: sha256:' || sha256({block}){nl}
               || 'Content-Type: {content_type}'{nl} || 'Content-Length: ' || octet_length(encode({block})){nl} || {crlf} || {block} AS record
        FROM whole"""

    return f"""
    WITH pages_in AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
    found AS (
        SELECT *, {_uuid("response", "coalesce(url, '') || '|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || sha256(payload)")} AS source,
               'sha256:' || sha256(payload) AS source_digest, trim({text}, ' ' || chr(10)) AS t,
               trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '[\\t\\r\\n ]+', ' ', 'g'), ' ') AS title,
               regexp_extract(payload, '(?is)<html[^>]* lang="([^"]*)"', 1) AS language
        FROM pages_in
    ), whole AS (
        SELECT *, {_uuid("metadata", "source")} AS metadata_id, {_uuid("conversion", "source")} AS conversion_id,
               'source-record-id: ' || source{nl} || 'source-payload-digest: ' || source_digest{nl}
               || {optional.format("title")} || {optional.format("language")} || 'text-characters: ' || length(t){nl} || {http} AS about
        FROM found
    ) {record("metadata", "conversion", "application/warc-fields", "about")} UNION ALL {record("conversion", "metadata", "text/plain; charset=utf-8", "t")}
    """


SQL = _sql()
