"""WARC derivatives: plain text against patterns, records against a reader of the format, odd pages."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from twinrun.llm import warc
from twinrun.llm.warc import CRLF, ENTITIES, LINE_END, UNSEEN, derive, plain_text, responses_of, write_warc

SCHEMA = "page_id bigint, url string, html string"


def plainly(html):
    text = re.sub(r"(?s)<!--.*?-->", " ", html)
    for name in UNSEEN:
        text = re.sub(rf"(?is)<{name}.*?</{name}[^>]*>", " ", text)
    text = re.sub(r"<[^>]*>", "", re.sub(LINE_END, "\n", text))
    for entity, character in ENTITIES:
        text = text.replace(entity, character)
    text = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[\t\r\x0b\x0c ]+", " ", text))
    return text.strip(" \n")


def texts_of(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    return [r.t for r in df.orderBy("k").select(plain_text(F.col("html")).alias("t")).collect()]


def test_text_equals_patterns(spark):
    r = random.Random(5)
    parts = ["<!--", "-->", "<script>", "<SCRIPT a=1>", "</script>", "<style>", "</style >", "<p>", "</p>", "<br/>", "a", " b ", "\n", "<", ">", "&amp;lt;", "é", "<h1 x>", "</H1>"]
    pages = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(500)]
    for page, got in zip(pages, texts_of(spark, pages)):
        assert got == plainly(page), repr(page)


@pytest.mark.parametrize("piece", ["<!-- x ", "<script> ", "</script ", "<script></script ", "<style", "<br ", "<a <br>", "<script </script>", "<style> <script <!-- ", "<", "<title>", "<html lang="])
def test_pages_where_nothing_is_closed_take_linear_time(spark, piece):
    page = piece * (1_000_000 // len(piece))
    start = time.time()
    rows = derive(responses_of(spark.createDataFrame([(1, "u", page)], SCHEMA))).collect()
    assert len(rows) == 2 and time.time() - start < 15


def parsed(record):
    head, block = record.split(CRLF * 2, 1)
    version, *lines = head.split(CRLF)
    return version, dict(line.split(": ", 1) for line in lines), block


def test_records(spark, tmp_path):
    page = "<html lang='x' lang=\"fr\"><title> A\n b </title><body>Hi <b>you</b><br>é</body></html>"
    rows = [(1, "http://a/", page), (2, None, None), (3, "http://c/", ""), (None, "http://d/", "x"), (1, "http://a/", page)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({"record": F.lit("clash"), "text": F.lit(1), "source": F.lit(2)})
    records = derive(responses_of(pages))
    got = records.collect()
    assert len(got) == 2 * len(rows)
    first = {r.warc_type: r for r in got if r.page_id == 1}
    assert first["conversion"].record.endswith(CRLF * 2 + "A\nb\nHi you\né")
    assert "title: A b" in first["metadata"].record and "language: fr" in first["metadata"].record
    assert len({r.record_id for r in got if r.page_id == 1}) == 2  # a repeated row has the same ids
    for r in got:
        version, head, block = parsed(r.record)
        assert version == "WARC/1.1" and head["WARC-Type"] == r.warc_type
        assert head["WARC-Refers-To"] == r.refers_to and head["WARC-Concurrent-To"] == r.concurrent_to != r.record_id
        assert int(head["Content-Length"]) == len(block.encode()) == r.content_length
        assert head["WARC-Block-Digest"] == r.block_digest == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        assert ("WARC-Target-URI" in head) == (r.target_uri is not None)
    empty = next(r for r in got if r.page_id == 2 and r.warc_type == "conversion")
    assert empty.content_length == 0 and parsed(empty.record)[2] == ""
    write_warc(records.coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    assert file.read_bytes().decode().count("WARC/1.1" + CRLF) == 2 * len(rows)


def test_source_headers_and_digest_are_carried(spark):
    responses = responses_of(spark.createDataFrame([(1, "u", "text"), (2, "u", "text")], SCHEMA)).withColumns({
        "payload_digest": F.when(F.col("page_id") == 1, "sha1:ABC"), "warc_headers": F.lit(f"WARC-IP-Address: 192.0.2.1{CRLF}WARC-Date: 2020-01-01T00:00:00Z{CRLF}"),
        "date": F.lit("2020-01-01T00:00:00Z"),
    })
    got = {(r.page_id, r.warc_type): r for r in derive(responses).collect()}
    about = got[1, "metadata"].record
    assert "source-payload-digest: sha1:ABC" in about and "source-warc-header: WARC-IP-Address: 192.0.2.1" in about
    assert "source-http-header: HTTP/1.1 200 OK" in about and "WARC-Date: 2020-01-01T00:00:00Z" in about.split(CRLF * 2)[0]
    assert got[2, "conversion"].source_digest == "sha256:" + hashlib.sha256(b"text").hexdigest()


def test_empty_table(spark):
    assert derive(responses_of(spark.createDataFrame([], SCHEMA))).count() == 0


def test_ids_and_digests_are_worked_out_before_the_explode(spark):
    pages = spark.sql("SELECT 1L AS page_id, 'u' AS url, '<p>x</p>' AS html")
    plan = warc.derive(warc.responses_of(pages))._jdf.queryExecution().optimizedPlan().toString()
    generate = plan[plan.index("Generate") : plan.index("Project", plan.index("Generate"))]
    assert "explode" in generate and "sha2(" not in generate


def test_patterns_with_fewer_steps_find_the_same(spark):
    parts = ["<", ">", "</", "br", "BR", "hr", "p", "h1", "h7", "title", "nav", "script", "<script", "</Script", "<STYLE", "</style", "\n", " ", "\t", "x", "é", "<html lang=\"a\""]
    rng = random.Random(1)
    rows = [("".join(rng.choices(parts, k=rng.randrange(25))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string")
    pairs = {"line": (F.regexp_replace("t", warc.LINE_END, "\n"), F.regexp_replace("t", warc._LINE_END, "\n"))}
    for name in warc.UNSEEN:
        pairs[name] = (F.regexp_replace("t", f"(?is)<{name}.*?</{name}[^>]*>", " "), warc._without_element(F.col("t"), name))
    text = F.col("t")
    for by, pattern in ((" ", "(?s)<!--.*?-->"), *((" ", f"(?is)<{n}.*?</{n}[^>]*>") for n in warc.UNSEEN), ("\n", warc.LINE_END), ("", "<[^>]*>"), (" ", r"[\t\r\x0b\x0c ]+"), ("\n", r" ?\n[ \n]*")):
        text = F.regexp_replace(text, pattern, by)
    pairs["text"] = (F.trim(text, F.lit(" \n")), warc.plain_text(F.col("t")))
    found = df.agg(*[F.count_if(a != b).alias(n) for n, (a, b) in pairs.items()], *[F.count_if(a != F.col("t")).alias(f"{n}_hit") for n, (a, b) in pairs.items()]).first()
    assert all(found[n] == 0 and found[f"{n}_hit"] > 9 for n in pairs), found


def test_title_and_language_of_the_first_tag(spark):
    cases = {
        "<HTML x lang=\"de\"><Title a='1'> a\n b </TITLE><title>c</title>": ("a b", "de"),
        "<title>open <html": ("", ""),
        "<title": ("", ""),
        "<title no end </title> x": ("", ""),
        "<html lang=\"a\" lang=\"b\" <title>t</title": ("t", "b"),
        "": ("", ""),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = df.select("t", warc._title(F.col("t")).alias("a"), warc._language(F.col("t")).alias("b")).collect()
    assert {r.t: (r.a, r.b) for r in got} == cases
    many = spark.range(1).select(F.repeat(F.lit("<title><html "), 100_000).alias("t"))
    assert tuple(many.select(warc._title(F.col("t")), warc._language(F.col("t"))).first()) == ("", "")


def test_text_is_found_without_a_lower_cased_copy_of_the_page(spark):
    page = spark.sql("SELECT uuid() AS html")
    plan = page.select(plain_text(F.col("html")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan and plan.count("regexp_replace(") + plan.count("regexp_extract(") <= 10


def test_blanks_and_lines_equal_patterns(spark):
    r = random.Random(9)
    parts = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", " ", "a", "é", "<br>", "&nbsp;", "<!---->", "<script></script>"]
    pages = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(1000)]
    for page, got in zip(pages, texts_of(spark, pages)):
        assert got == plainly(page), repr(page)


def test_elements_opened_and_not_closed_behind_closed_ones(spark):
    many = 100_000
    pages = ["<script>x</script>a" + "<script>" * many, "<style>" * many + "<script></style></script>", "<style></script></style>" + "<STYLE </style" * many]
    start = time.time()
    a, b, c = texts_of(spark, pages)
    assert time.time() - start < 15 and (a, b) == ("a", "") and c == "<STYLE </style" * many
