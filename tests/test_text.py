"""Text functions and sections, against plain models written for these tests."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from twinrun import functions as fn
from twinrun.functions.strings import WHITESPACE
from twinrun.operators import definitions, sections
from twinrun.plans import context


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_white_space_is_the_set_python_strips():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@pytest.mark.parametrize(
    "html, expected",
    [
        ("a<BR />b<br>c", "a\nb\nc"),
        ("<p>a</p><div>b</DIV><h3>c</h3><ul><li>d</li></ul><tr>e</tr>f", "a\nb\nc\nd\ne\nf"),
        ("&amp;lt;b&gt; &quot;x&quot;&nbsp;&#65;", '<b> "x" &#65;'),
        ("\u00a0\u2003 x \u3000\n\x1f", "x"),
        ("a</p></p></p></p>b", "a\n\nb"),
        ("<script>var a;</script>x", "var a;x"),
        ("a < b", "a < b"),
        ("", ""),
    ],
)
def test_html_to_text(spark, html, expected):
    assert one(spark, fn.html_to_text(F.lit(html))) == expected


def test_tags_go_as_by_pattern(spark):
    """Against the patterns that say what a tag is, on texts made of what tags are made of."""
    r = random.Random(6)
    cases = ["".join(r.choices(["<", ">", "<b", "/", "</p>", "<br />", "a", " ", "\n", "é"], k=r.randint(0, 25))) for _ in range(400)]
    got = {x.t: x.g for x in spark.createDataFrame([(c,) for c in cases], "t string").select("t", fn.html_to_text("t").alias("g")).collect()}
    for case in cases:
        text = re.sub(r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr)>", "\n", case)
        assert got[case] == re.sub(r"\n{3,}", "\n\n", re.sub(r"<[^>]+>", "", text)).strip(), repr(case)


@pytest.mark.parametrize("piece", ["<", "<a ", "< <b", "<!-- x ", "a>"])
def test_tags_that_never_end_take_linear_time(spark, piece):
    html = piece * (1_000_000 // len(piece))
    start = time.time()
    assert one(spark, fn.html_to_text(F.lit(html))).startswith(piece.strip()[:1])
    assert time.time() - start < 10


def test_html_to_text_without_scripts(spark):
    html = "<script type='x'>a</b>\n</script>keep<STYLE>p{}</STYLE>"
    assert one(spark, fn.html_to_text(F.lit(html), drop_scripts=True)) == "keep"


def test_html_to_text_of_a_large_page(spark):
    html = "<p>" + "word &amp; " * 200_000 + "</p>" + " " * 300_000 + "end"
    text = one(spark, fn.html_to_text(F.lit(html)))
    assert text.endswith("end") and text.count("&") == 200_000


@pytest.mark.parametrize(
    "ref, expected",
    [
        ("https://w.example.org/spaces/X/pages/123/T", "123"),
        ("https://w.example.org/pages/45", "45"),
        (" 678 ", "678"),
        ("/pages/12a/", None),
        ("x9", None),
        ("", None),
    ],
)
def test_page_ref_id(spark, ref, expected):
    assert one(spark, fn.page_ref_id(F.lit(ref))) == expected


def test_page_ref_struct(spark):
    row = spark.sql("SELECT struct('' AS page_id, '7' AS id) AS r, struct('5' AS page_id, '7' AS id) AS s")
    assert tuple(row.select(fn.page_ref_id_of("r"), fn.page_ref_id_of("s")).first()) == ("7", "5")


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://github.com/a/b", "a/b"),
        ("https://github.com/a/b.git/", "a/b"),
        ("http://www.github.com/a/b/tree/x?y#z", "a/b"),
        ("git@github.com:a/b.git", "a/b"),
        ("git@github.com:a/b/c", None),
        ("git@example.org:a/b", None),
        ("github.com/a/b", None),
        ("https://example.org/github.com/a", None),
        ("https://github.com/a", None),
        ("https://github.com.evil.org/a/b", None),
        ("https://github.com", None),
    ],
)
def test_repo_slug(spark, url, expected):
    assert one(spark, fn.repo_slug(F.lit(url))) == expected


@pytest.mark.parametrize(
    "path, expected",
    [
        ("x/pre_etl_scope.py", "scope"),
        ("scope.py", "scope"),
        ("a.b/c.d.py", "c.d"),
        ("/x/y/", "y"),
        (".hidden", ".hidden"),
        ("pre_etl_pre_etl_a", "pre_etl_a"),
    ],
)
def test_pipeline_name(spark, path, expected):
    assert one(spark, fn.pipeline_name(F.lit(path))) == expected
    assert one(spark, fn.output_table(fn.pipeline_name(F.lit(path)))) == expected + "_feed"


def test_redact(spark):
    rows = spark.sql(
        "VALUES ('api_key', 'v'), ('API_KEY', ''), ('Token', NULL), ('region', 'x'), ('region', NULL), ('MONKEY', 'b') AS t(k, v)"
    )
    got = [r[0] for r in rows.select(fn.redact("k", "v")).collect()]
    assert got == ["(redacted)", "(not set)", "(not set)", "x", None, "(redacted)"]
    words = [r[0] for r in rows.select(fn.is_secret("k", whole_words=True)).collect()]
    assert words == [True, True, True, False, False, False]
    m = spark.sql("SELECT map('db_password', 'p', 'host', 'h') AS m").select(fn.redact_map("m")).first()[0]
    assert m == {"db_password": "(redacted)", "host": "h"}


def test_section_between(spark):
    cut = lambda text: one(spark, sections.section_between(F.lit(text), "Start +Here", "Stop"))
    assert cut("x start  here A stop B stop") == " A "
    assert cut("START HERE\nA\nB") == "\nA\nB"
    assert cut("nothing") is None
    assert cut("start here") == ""
    assert len(cut("start here" + "a\n" * 1_000_000)) == 2_000_000


# ---------------------------------------------------------------- sections against models


def pages(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")


def names_of(spark, names, n_pages):
    return spark.createDataFrame([(p, n) for p in range(n_pages) for n in names], "page_id long, name string")


def blocks(df):
    return {(r.page_id, r.name): r.block for r in df.collect()}


def random_texts(lines, seed, n=120, longest=9):
    rnd = random.Random(seed)
    return ["\n".join(rnd.choice(lines) for _ in range(rnd.randrange(longest))) for _ in range(n)]


def model_named(text, names):
    """Line by line: where is each name first a heading, and where does another name head a line after that."""
    rows = text.split("\n")
    heads = []
    for i, row in enumerate(rows):
        word = row.split(":")[0].strip().lower()
        if ":" in row or i < len(rows) - 1:
            heads += [(i, n) for n in names if n.lower() == word]
    out = {}
    for name in names:
        starts = [i for i, n in heads if n == name]
        if starts:
            stops = [i for i, n in heads if n != name and i > starts[0]]
            block = "\n".join(rows[starts[0] : min(stops, default=len(rows))]).strip()
            out[name] = block
    return out


def test_named_blocks(spark):
    names = ["alpha", "Beta.x", "c"]
    lines = ["alpha:", "  ALPHA ", "beta.x", "Beta.x : text", "betaXx:", "c", "c:", "body c", "", "  ", "x: alpha"]
    texts = random_texts(lines, 1)
    got = blocks(sections.named_blocks(pages(spark, texts), names_of(spark, names, len(texts))))
    want = {(i, n): b for i, t in enumerate(texts) for n, b in model_named(t, names).items()}
    assert got == want and len(want) > 100
    shared = spark.createDataFrame([(n,) for n in names], "name string")
    assert blocks(sections.named_blocks(pages(spark, texts), shared)) == want


def test_named_blocks_groups_know_only_their_own_names(spark):
    page = pages(spark, ["a:\n1\nb:\n2\nc:\n3"])
    rows = [("p", 0, "a"), ("p", 0, "c"), ("q", 0, "a"), ("q", 0, "b")]
    names = spark.createDataFrame(rows, "pipeline string, page_id long, name string")
    got = {(r.pipeline, r.name): r.block for r in sections.named_blocks(page, names, groups=["pipeline"]).collect()}
    assert got == {
        ("p", "a"): "a:\n1\nb:\n2",
        ("p", "c"): "c:\n3",
        ("q", "a"): "a:\n1",
        ("q", "b"): "b:\n2\nc:\n3",
    }


def test_names_with_colons(spark):
    pages = spark.createDataFrame([(1, "a:\nfirst\na: b:\nsecond\nc: d\nthird\nnot a: b\nA: B : c\nlast")], "page_id int, text string")
    names = spark.createDataFrame([("a",), ("a: b",), ("c: d",), ("x\ny",)], "name string")
    got = {r.name: r.block for r in sections.named_blocks(pages, names).collect()}
    assert got == {"a": "a:\nfirst", "a: b": "a: b:\nsecond", "c: d": "c: d\nthird\nnot a: b"}
    asked = names.select(F.lit(1).alias("page_id"), "name")
    assert sections.marker_blocks(pages, asked).count() == 0 and sections.heading_blocks(pages, asked).count() == 0


def model_marked(text, name):
    """Cut at the marker lines (the last line is none: it has no end) and read each section's first words."""
    rows = text.split("\n")
    marks = [i for i, row in enumerate(rows[:-1]) if row.strip() == "****"]
    for at, start in enumerate(marks):
        end = marks[at + 1] if at + 1 < len(marks) else len(rows)
        body = rows[start + 1 : end]
        while body and not body[0].strip():
            body = body[1:]
        closed = start + 1 < len(rows) and (end < len(rows) or len(body) > 1)
        if body and closed and body[0].rstrip().endswith(":") and body[0].strip()[:-1].strip().lower() == name:
            found = "\n".join(body[1:]).strip()
            if found:
                return found
    return None


def test_marker_blocks(spark):
    lines = ["****", " **** ", "scope:", "Scope :", "scope: x", "other:", "text", "", "*****"]
    texts = random_texts(lines, 2, 200, 12)
    got = blocks(sections.marker_blocks(pages(spark, texts), names_of(spark, ["scope", "other"], len(texts))))
    want = {(i, n): model_marked(t, n) for i, t in enumerate(texts) for n in ("scope", "other")}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 20


def test_an_empty_marker_section_takes_nothing_from_the_next(spark):
    text = "****\na:\n****\nb:\nbody\n****\n"
    assert blocks(sections.marker_blocks(pages(spark, [text]), names_of(spark, ["a", "b"], 1))) == {(0, "b"): "body"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("# scope\nbody\n# other\nx", "body"),
        ("x\n  #Scope: one\ntwo\n## deeper\nx", "one\ntwo"),
        ("## scope\nbody", None),
        ("# scope\n\n\nbody\n#tag\nmore\n### end\n", "body\n#tag\nmore"),
        ("# scope:\n# other\nx", ""),
        ("# scope\n# other\nx\n# third\ny", "# other\nx"),
        ("#tag\nx\n#scope\ny\n# end", "y"),
        ("# scopes\nx", None),
        ("# scope", None),
        ("# scope\n", ""),
        ("# scope\none\n# scope\ntwo", "one"),
    ],
)
def test_heading_blocks(spark, text, expected):
    got = blocks(sections.heading_blocks(pages(spark, [text]), names_of(spark, ["scope"], 1)))
    assert got.get((0, "scope")) == expected


def test_logic_prefers_the_marker_form(spark):
    texts = ["# a\nold\n****\na:\nnew\n****\n", "# a\nold", "nothing", "****\na:\n****\n# a\nold"]
    got = blocks(sections.logic_blocks(pages(spark, texts), names_of(spark, ["a"], 4)))
    assert got == {(0, "a"): "new", (1, "a"): "old", (2, "a"): "", (3, "a"): "old"}


def model_key(content, key):
    rows = content.split("\n")
    for i, row in enumerate(rows):
        if row.strip() == key + ":":
            stop = [j for j in range(i + 1, len(rows)) if re.fullmatch(r"[^\s#]\w*\s*:\s*", rows[j])]
            return "\n".join(rows[i : min(stop, default=len(rows))]).strip()
    return None


def test_key_blocks(spark):
    lines = ["a_feed:", "  a_feed:", "b_feed: ", "b_feed: x", "blocked_a_feed:", "  schema:", "    x: 1", "# a_feed:", "", "-y:"]
    texts = random_texts(lines, 3, 60, 10)
    corpus = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], "path string, content string")
    keys = spark.createDataFrame([("a_feed",), ("b_feed",), ("none_feed",)], "key string")
    for i in range(0, 60, 6):
        part = corpus.where(f"path >= '{i:03d}' AND path < '{i + 6:03d}'")
        got = {r.key: (r.path, r.block) for r in definitions.key_blocks(part, keys).collect()}
        want = {}
        for key in ("a_feed", "b_feed"):
            hits = [(f"{j:03d}", model_key(texts[j], key)) for j in range(i, i + 6)]
            hits = [h for h in hits if h[1] is not None]
            if hits:
                want[key] = hits[0]
        assert got == want


def test_pick_file_needs_the_exact_key(spark):
    rows = [("a", "blocked_x_feed:\n  d: 1"), ("b", "x_feed: inline"), ("c", "x_feed:\n  d: 1"), ("d", "x_feed:\n")]
    corpus = spark.createDataFrame(rows, "path string, content string")
    keys = spark.createDataFrame([("x_feed",)], "key string")
    assert [tuple(r) for r in definitions.pick_file(corpus, keys).collect()] == [("x_feed", "c")]


def test_strip_keys(spark):
    rows = spark.sql("""SELECT map('description', 'd', 'path', 'p', 'type', 't', 'control_list', 'c') AS attributes,
        map('x', map('type', 'int', 'description', 'dx'), 'y', map('type', 'int')) AS columns""")
    got = definitions.strip_keys(rows).first()
    assert got.attributes == {"description": "d", "type": "t"}
    assert got.columns == {"x": {"description": "dx"}, "y": {"type": "int"}}


def test_context_document(spark):
    config = spark.sql("""SELECT 'p' AS pipeline, 1L AS page_id,
        map('a', named_struct('table_name', 't1'), 'b', named_struct('table_name', 't2'),
            'c', named_struct('table_name', 'p_feed')) AS sources
        UNION ALL SELECT 'q', 9L, map()""")
    html = (
        "<h1>Input Data Explanations</h1><p>t1:</p><p>from page</p><p>t2</p><p>page two</p>"
        "<h1>Pre-ETL Business Logics</h1><p>****</p><p>p:</p><p>rules</p><p>****</p><p>end</p>"
    )
    pages_ = spark.createDataFrame([(1, html)], "page_id long, html string")
    corpus = spark.createDataFrame([("f", "t1:\n  description: from file\n")], "path string, content string")
    docs = context.assemble_context(context.build_context(config, pages_, corpus))
    got = {r.pipeline: r.document for r in docs.collect()}
    assert got["p"] == (
        "# Pre-ETL Business Logic\n## p\nrules\n\n# Output Table\n## p_feed\n(No definition found.)\n\n# Input Tables\n"
        "## t1\n\nt1:\n  description: from file\n\n## t2\n\nt2\npage two\n\n"
    )
    assert got["q"] == (
        "# Pre-ETL Business Logic\n## q\n(No business logic section found.)\n\n"
        "# Output Table\n## q_feed\n(No definition found.)\n\n# Input Tables\n"
    )


def test_many_hash_lines_in_one_large_page(spark):
    """Comment-like lines open sections without ending any; only the wanted ones are cut out."""
    lines = [f"#tag{i} x:" + "y" * 40 for i in range(20_000)]
    text = "# top\n" + "\n".join(lines) + "\n#scope: here\nbody\n# end\n"
    got = blocks(sections.heading_blocks(pages(spark, [text]), names_of(spark, ["scope", "end"], 1)))
    assert got == {(0, "scope"): "here\nbody", (0, "end"): ""}


def test_many_blocks_of_one_large_page(spark):
    text = "\n".join(f"name{i}:\nbody {i} " + "z" * 200 for i in range(4000))
    names = spark.range(4000).select(F.lit(0).cast("long").alias("page_id"), F.concat(F.lit("name"), "id").alias("name"))
    got = blocks(sections.named_blocks(pages(spark, [text]), names))
    assert len(got) == 4000 and got[(0, "name77")] == "name77:\nbody 77 " + "z" * 200


def test_one_page_shared_by_many_pipelines(spark):
    text = "\n".join(f"name{i}:\nbody {i}" for i in range(300))
    names = spark.range(20_000).select(
        F.concat(F.lit("p"), "id").alias("pipeline"), F.lit(0).cast("long").alias("page_id"),
        F.explode(F.array(F.concat(F.lit("name"), F.col("id") % 299), F.concat(F.lit("name"), F.col("id") % 299 + 1))).alias("name"),
    )
    got = sections.named_blocks(pages(spark, [text]), names, groups=["pipeline"])
    first = got.where("pipeline = 'p5'").orderBy("name").collect()
    assert got.count() == 40_000
    assert first[0].block == "name5:\nbody 5" and first[1].block.startswith("name6:\nbody 6\nname7:")


def test_context_goes_through_the_shared_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("twinrun.session.scratch_dir", lambda spark: str(tmp_path))
    config = spark.sql("SELECT 'p' AS pipeline, 1L AS page_id, map('a', named_struct('table_name', 't1')) AS sources")
    html = "<h1>Input Data Explanations</h1><p>t1:</p><p>from page</p>"
    pages_ = spark.createDataFrame([(1, html), (2, html)], "page_id long, html string")
    corpus = spark.createDataFrame([], "path string, content string")
    docs = context.assemble_context(context.build_context(config, pages_, corpus)).collect()
    assert "## t1\n\nt1:\nfrom page\n" in docs[0].document
    (written,) = tmp_path.glob("twinrun-pages-*")
    assert spark.read.parquet(str(written)).count() == 1  # pages nobody refers to are left out


def test_definition_text_is_stripped_by_its_lines(spark):
    from twinrun.operators.definitions import strip_definition_text

    text = (
        "t:\n    path: /x\n    description: of t\n    primary_key:\n    - a\n    - b: c\n    control_params:\n        path: kept with its parent: no\n"
        "    schema:\n        a:\n            type: int\n            description: |\n                two\n                lines\n            more: 1\n"
        "        b: string\n\n        c:\n            type: int\n            tags:\n            - x\n    storage_type: s\n    path_note: stays"
    )
    want = (
        "t:\n    description: of t\n    schema:\n        a:\n            description: |\n                two\n                lines\n"
        "        b: string\n        c:\n            type: int\n            tags:\n            - x\n    path_note: stays"
    )
    rows = spark.createDataFrame([(text, want), ("t:", "t:"), ("", ""), (None, None), ("t: {path: 1}", "t: {path: 1}")], "text string, want string")
    assert [r for r in rows.select(strip_definition_text("text").alias("got"), "want").collect() if r.got != r.want] == []


def _plain_strip(text):
    """Definitions line by line, with what is open kept in variables."""
    from twinrun.operators.definitions import DROPPED_ATTRIBUTES

    head, *lines = text.split("\n")
    out, attr, col, cattr, mode, every, told, telling = [head], None, None, None, "", [], [], False

    def close():
        nonlocal every, told
        out.extend([every[0], *told] if told else every)
        every, told = [], []

    for line in lines:
        if not line.strip(" "):
            continue
        indent, item = len(line) - len(line.lstrip(" ")), line.lstrip(" ").startswith("-")
        found = re.match(r"^[ \t]*([^:]+?)[ \t]*:", line)
        name = found[1].strip("'\"") if found else ""
        if attr is None or indent < attr or (indent == attr and not item):
            close()
            attr, col = indent if attr is None else attr, None
            mode = "drop" if name in DROPPED_ATTRIBUTES else "schema" if name == "schema" else "keep"
            if mode != "drop":
                out.append(line)
        elif mode == "keep":
            out.append(line)
        elif mode == "schema" and (col is None or (indent <= col and not item)):
            close()
            col, cattr, telling, every = indent if col is None else col, None, False, [line]
        elif mode == "schema":
            cattr = indent if cattr is None else cattr
            if indent <= cattr and not item:
                telling = name == "description"
            every.append(line)
            if telling:
                told.append(line)
    close()
    return "\n".join(out)


def test_definitions_are_stripped_as_by_a_plain_reader(spark):
    from twinrun.operators.definitions import strip_definition_text

    r = random.Random(8)
    keys = ["path:", "schema:", "description: x", "'description': y", "owner: z", "type: int", "- a: b", "- c", "", "  ", "primary_key:", "plain text"]
    cases = ["\n".join(["t:", *[" " * r.choice([0, 2, 2, 4, 4, 6, 8]) + r.choice(keys) for _ in range(r.randint(0, 30))]]) for _ in range(300)]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", strip_definition_text("t").alias("g")).collect()
    for row in rows:
        assert row.g == _plain_strip(row.t), row.t


def test_long_definitions_take_linear_time(spark):
    from twinrun.operators.definitions import strip_definition_text

    def seconds(n):
        column = "    c%d:\n      type: int\n      description: d\n"
        text = "t:\n  schema:\n" + "".join(column % i for i in range(n)) + "  owner: x\n" * n
        start = time.time()
        assert one(spark, strip_definition_text(F.lit(text))).count("\n") == 1 + 2 * n + n
        return time.time() - start

    seconds(10)
    assert seconds(20_000) < 20
