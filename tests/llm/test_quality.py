"""Quality rules on single texts, against plain Python."""

import re
from collections import Counter

from twinrun.llm.quality import RULES, Rule, quality
from pyspark.sql import functions as F


def measures(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 300, "a b c d e f " * 2 + "g " + "b c d e f ", "é\x0bü\n\né\x0bü\n#$ |<>", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 z 5 6 7 8 9"]
    texts += ["w " * 20_000 + "end"]
    df = spark.createDataFrame([(k, t, 3, True) for k, t in enumerate(texts)], "doc_id int, text string, n_words int, kept boolean")
    for r in df.select("doc_id", quality(F.col("text")).alias("q")).collect():
        q = r.q
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == measures(texts[r.doc_id]), texts[r.doc_id]
        assert q.base_failed == (q.n_words < 10 or 100 * q.n_repeat_words > 20 * q.n_words)
        assert not (q.base_failed and q.kept)
    assert df.where("false").select(quality(F.col("text"))).count() == 0


def test_rules(spark):
    clean = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) + " the end"
    cases = {
        "fine": (clean, []),
        "symbols": (clean + " ###" * 4, ["symbols"]),
        "stop words": (clean.replace(" the ", " xx "), ["stop words"]),
        "lengths": (" ".join(f"w{'o' * 20}{k}" for k in range(12)), ["word length"]),
        "lines": (clean + "\nab" * 4, ["repeated lines"]),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "name string, text string")
    for r in df.select("name", quality(F.col("text")).alias("q")).collect():
        assert r.q.failed_rules == cases[r.name][1] and r.q.kept == (not r.q.failed_rules), r
    own = (*RULES, Rule("at least 100", "n_words", low=100))
    assert df.where("name = 'fine'").select(quality(F.col("text"), own)["failed_rules"]).first()[0] == ["at least 100"]


def test_share_of_stop_words(spark):
    """A share of the words, in any case: one stop word does not carry a long text."""
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(1000)]
    cases = {"none": words, "few": [*words[:991], *["the"] * 9], "enough": [*words[:980], *[f"{x} filler" for x in ("The", "DER", "und", "de")] * 5], "short": words[:49]}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in cases.items()], "name string, text string")
    got = {r.name: (r.q.n_stop_words, "stop words" in r.q.failed_rules) for r in df.select("name", quality(F.col("text")).alias("q")).collect()}
    assert got == {"none": (0, True), "few": (9, True), "enough": (20, False), "short": (0, False)}
