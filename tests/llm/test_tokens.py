"""BPE, token counts and packing against the libraries whose results they have to give."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinrun.llm import counts, packing
from twinrun.llm.bpe import ByteBpe, Kept, Merges, PerfectHash, _Tables, op1_byte_bpe
from twinrun.llm.chunks import Memo, ids_by_chunk, slices

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "\n", "a  b", " a", "a ", "a \n b", "a\n b\n\n  c", "it's we'll 'S", "  x", "x y", "é ́",
    "ΑΣ ΟΔΟΣ ΣΑΣ", "İstanbul J̌ ﬁ ẞ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> <|x|>", "\x1c \x1f \x85  x", "🙂🙂 🇩🇪",
    "word" * 5000, "x " * 3000, "12 345 6७", "﻿​᠎ y",
]


@pytest.fixture(scope="module")
def ranks():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


@pytest.fixture(scope="module")
def texts():
    return [*ODD, *pd.read_parquet(f"{SF}/documents.parquet").text]


def every_character():
    """Every character of the planes in use, next to letters, digits and spaces."""
    return [f"a{chr(c)}B{chr(c)}1 {chr(c)}{chr(c)} x" for c in range(0x32400) if not 0xD800 <= c < 0xE000]


def test_perfect_hash(ranks):
    h = PerfectHash(ranks)
    assert sorted(h.ranks) == sorted(ranks.values()) and None not in h.keys
    assert all(h.rank(k) == v for k, v in ranks.items())
    assert h.rank(b"not in the vocabulary") == -1 and PerfectHash({}).rank(b"") == -1


def test_merges_of_random_pieces(ranks):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r, merges = random.Random(7), Merges(ranks)
    for _ in range(3000):
        piece = "".join(r.choices("aabcdeilnorstéü' 1.", k=r.randint(1, 30))).encode()
        assert merges.merged(piece) == library._encode_bytes(piece) or piece.count(b" ") or b"'" in piece or b"." in piece or b"1" in piece


def test_merges_together_equal_merges_one_by_one(ranks):
    """Also with a vocabulary where a merge makes a pair of lower rank than its own, and with repeated pairs."""
    r = random.Random(11)
    letters = [bytes([b]) for b in b"abc"]
    small = {b: n for n, b in enumerate(letters)}
    made = [a + b for a in letters for b in letters] + [b"aaa", b"aab", b"abab", b"caa", b"abc", b"bca", b"aaaa", b"cabc"]
    for vocabulary in (ranks, *[small | {t: n + 3 for n, t in enumerate(r.sample(made, len(made)))} for _ in range(20)]):
        merges = Merges(vocabulary)
        alphabet = "abc" if len(vocabulary) < 100 else "aabcdeilnorstéü'1.日"
        pieces = ["".join(r.choices(alphabet, k=r.randint(1, 24))).encode() for _ in range(1500)]
        pieces += [b"a" * n for n in range(1, 30)] + [b"abab" * 6]
        assert [np.frombuffer(x, "<u4").tolist() for x in merges.merged_together(pieces)] == [merges.merged(p) for p in pieces]
    assert Merges(ranks).merged_together([]) == []


def test_bpe_equals_library(spark, ranks, texts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = ByteBpe.load(spark, P.path("byte_bpe_multi_50k.tiktoken"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = bpe.encode(df, decoded=True).select("row.doc_id", "ids", "decoded", bpe.decode(F.col("ids")).alias("d")).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text), repr(text[:80])
        assert bytes(r.d) == bytes(r.decoded) == text.encode()


def test_texts_of_every_character(ranks):
    """Words that hold or end in white space of all kinds, next to each other in one slice."""
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tables = _Tables(ranks)
    texts = every_character() + [f"x{chr(c)}" for c in range(0x3100)] + [f"y {chr(c)}z {chr(c)}" for c in range(0x3100)] + [t or "" for t in ODD]
    got = [x for part in slices(pa.array(texts)) for x in tables.texts(part)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library.encode_ordinary_batch(texts, num_threads=2)


def test_memo_keeps_what_is_asked_for():
    asked = []
    known = Kept(lambda k: asked.append(k) or k.upper(), size=3, longest=4)
    for k in ["a", "b", "a", "c", "d", "a", "e", "f", "a", "longer", "longer"]:
        assert known[k] == k.upper()
    assert asked == ["a", "b", "c", "d", "e", "f", "longer", "longer"] and len(known) + len(known.older) <= 6


def test_chunks_of_every_character(ranks):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pack = lambda t: np.asarray(library.encode_ordinary(t), "<u4").tobytes()
    texts = every_character()
    got = [x for part in slices(pa.array(texts)) for x in ids_by_chunk(part, Memo(pack), pack)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library.encode_ordinary_batch(texts, num_threads=2)


def test_json_vocabulary_equals_library(texts):
    text = open(P.path("byte_bpe_50k.json")).read()
    v, library = packing.JsonVocabulary(text), Tokenizer.from_str(text)
    cases = [t or "" for t in texts] + every_character()[::7]
    got = [x for part in slices(pa.array(cases)) for x in ids_by_chunk(part, v.chunks, v.whole)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]


def test_split_of_every_character():
    text = open(P.path("word_bpe_49k.json")).read()
    v, library = counts.WordVocabulary(text), Tokenizer.from_str(text)
    cases = every_character() + [t or "" for t in ODD]
    expected = [len(e.ids) for e in library.encode_batch(cases, add_special_tokens=False)]
    known = Memo(v.count)
    got = [sum(known[p] for chunk in t.encode().split() for p in v.split(chunk.decode())) for t in cases]
    assert [c for c, a, b in zip(cases, got, expected) if a != b] == []


def test_counts_equal_library(spark, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [*enumerate(texts), (None, "a b"), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(i, t, 5, "b") for i, t in rows], "doc_id bigint, text string, n_tokens int, block string")
    got = counts.token_counts(df, P.path("word_bpe_49k.json"), block_bytes=50_000).collect()
    want = sorted(repr((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))) for i, t in rows)
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in got) == want


@pytest.mark.parametrize("query", ["op1", "op8", "op10"])
def test_empty_tables(spark, query):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    if query == "op1":
        bpe = ByteBpe.load(spark, P.path("byte_bpe_multi_50k.tiktoken"))
        assert bpe.encode(df, decoded=True).count() == 0
    elif query == "op8":
        assert counts.token_counts(df, P.path("word_bpe_49k.json")).count() == 0
    else:
        assert packing.pack_documents(df, P.path("byte_bpe_50k.json")).count() == 0


def test_op1_digests(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = dict(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].values)
    for r in op1_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_packing(spark, texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [*enumerate(texts), (None, "a b"), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id bigint, text string, g int, `order` string")
    got = packing.pack_documents(df, P.path("byte_bpe_50k.json")).toPandas()
    want = []
    for i, t in rows:
        ids = np.asarray(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert len(got) == len(want)
    assert sorted(zip(got.piece, got.start, got.length, got.ids_crc32)) == sorted(w[1:] for w in want)
    assert got.doc_id.isna().sum() == 1
    packs_well(got, slack=1.03)


def packs_well(got, slack):
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 1024
    assert got.sequence_id.nunique() <= slack * got.length.sum() / 1024 + 1


def test_place_follows_the_sums_of_squares():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 21, 400)
    at, offset = packing.place(lengths, 20)
    bins: list[int] = []
    for s, b, o in zip(lengths.tolist(), at.tolist(), offset.tolist()):
        def cost(gaps):
            return sum(v * v for v in np.bincount([g for g in gaps if g], minlength=1).tolist())

        options = [cost(bins[:i] + [g - s] + bins[i + 1 :]) for i, g in enumerate(bins) if g >= s] + [cost([*bins, 20 - s])]
        if b == len(bins):
            bins.append(20)
        assert o == 20 - bins[b] and bins[b] >= s
        bins[b] -= s
        assert cost(bins) == min(options)


def test_copies_of_a_row_spread_over_blocks(spark, tmp_path):
    from twinrun.llm.blocks import in_blocks
    from twinrun.llm.counts import file_place, op8_token_counts

    rows = [(7, "one row many times " * 5)] * 600 + [(None, "no id " * 9)] * 300 + [(k, f"text {k}") for k in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    blocks, n = in_blocks(docs, "text", block_bytes=4000, place=file_place())
    per_block = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert n > 10 and blocks.columns == ["doc_id", "text", "block"] and max(per_block) < 3 * len(rows) / n
    got = op8_token_counts(spark, str(tmp_path)).groupBy("doc_id").count().collect()
    want = {7: 601, None: 300} | {k: 1 for k in range(300) if k != 7}
    assert {r.doc_id: r["count"] for r in got} == want
