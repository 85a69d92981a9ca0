"""Encoding, counting and packing against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidyward.llm import queries
from tidyward.llm.bytepair import encode_texts, meeting_point
from tidyward.llm.counts import token_counts
from tidyward.llm.packing import pack_tokens
from tidyward.llm.words import Encoder

SF = "/root/testdata/sf0.001"
PIECES = ["'", "'s", "'re", "'ll", "'v", " ", "  ", "\n", "\t", "a", "re", "é", "Σ", "ß", "İ", "1", "½",
          "२", "!", "--", "<|endoftext|>", " ", "\x85", "日本", "😀", "á", "ſ", "the", "   ",
          "\r\n", "Ⅳ", "'D", "ǅ", "ẞ", "한국", "x" * 40]


def mixed(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(n)] + [
        "", " ", "a" * 3000, " " * 3000, "ab" * 2000, "'" * 99, "ns" * 50]


def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(name, texts):
    if name.endswith(".json"):
        coder = Tokenizer.from_file(P.path(name))
        return [coder.encode(t, add_special_tokens=False).ids for t in texts]
    coder = ranked()
    return [coder.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    texts = mixed(1500)
    coder = Encoder(P.path(name), most=200)   # forgets often
    ids, n = [], []
    for i in range(0, len(texts), 100):
        a, b = coder.encode(texts[i:i + 100])
        ids.append(a)
        n.extend(b)
        assert coder.count(texts[i:i + 100]).tolist() == b.tolist()
    got = np.split(np.concatenate(ids), np.cumsum(n)[:-1])
    assert [g.tolist() for g in got] == library(name, texts)


def test_meeting_point_is_a_border_of_the_whole():
    coder, text = ranked(), "".join(mixed(40, 5))
    borders = {0}
    for token in __import__("regex").finditer(P.PATTERN, text):
        borders.add(token.end())
    for size in range(5, 400, 7):
        point = meeting_point(text[:size + 64], size)
        assert point is None or (point in borders and point >= size)
    assert meeting_point("a" * 100, 50) is None and coder


def test_encode_long_texts_in_chunks(docs):
    texts = ["".join(mixed(60, s)) for s in range(6)] + ["", None, "short", "y" * 700, "a b\n\n" * 300]
    out = {r.doc_id: r for r in encode_texts(
        docs(texts), P.path("byte_bpe_50k.tiktoken"), chunk=100, overlap=24).collect()}
    for i, want in enumerate(library("byte_bpe_50k.tiktoken", [t or "" for t in texts])):
        assert out[i].n_tokens == len(want)
        assert np.frombuffer(out[i].ids, "<u4").tolist() == want
        assert bytes(out[i].decoded).decode() == (texts[i] or "")


def test_encode_odd_rows(docs):
    path = P.path("byte_bpe_50k.tiktoken")
    assert encode_texts(docs([]), path).count() == 0
    rows = [(None, "one two"), (3, "one two"), (3, "one two")]
    assert sorted(r.n_tokens for r in encode_texts(docs(rows), path).collect()) == [2, 2, 2]


def test_counts_equal_the_library(docs):
    texts = mixed(300, 2) + [None]
    want = list(map(len, library("byte_bpe_50k.json", [t or "" for t in texts])))
    out = {r.doc_id: r for r in token_counts(docs(texts), P.path("byte_bpe_50k.json"), 10).collect()}
    assert [out[i].n_tokens for i in range(len(texts))] == want
    assert [out[i].over_limit for i in range(len(texts))] == [n > 10 for n in want]
    assert [out[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert token_counts(docs([]), P.path("byte_bpe_50k.json")).count() == 0


def packed_right(rows, texts, size):
    """Every id lies in one piece, windows are gapless, padding is as stated; returns padding."""
    want = {i: np.array([*ids, 2], "<u4") for i, ids in
            enumerate(library("word_bpe_49k.json", [t or "" for t in texts]))}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) == len(want[i]) == own[0].doc_tokens
        for r in own:
            assert zlib.crc32(want[i][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    padding = 0
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        used = sum(r.length for r in own)
        assert 0 < used <= size
        padding += 0 if used & (used - 1) == 0 else size - used
    return padding


@pytest.mark.parametrize("parts", [1, 5, 150])
def test_packing(docs, parts):
    texts = mixed(300, 3) + [None, "", "w " * 500]
    rows = pack_tokens(docs(texts).repartition(parts), P.path("word_bpe_49k.json"), size=64,
                       windows=4, least=4).collect()
    total = sum(r.length for r in rows)
    assert packed_right(rows, texts, 64) <= 0.07 * total


def test_packing_odd_rows(docs):
    path = P.path("word_bpe_49k.json")
    assert pack_tokens(docs([]), path).count() == 0
    rows = pack_tokens(docs([(None, "x"), (7, "x"), (7, "x"), (8, None)]), path).collect()
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == [1, 2, 2, 2]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_queries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    texts = [d.text for d in docs]
    six = {r.doc_id: r for r in queries.op6_byte_bpe(spark, SF).collect()}
    for d, ids in zip(docs, library("byte_bpe_50k.tiktoken", texts)):
        r = six[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(d.text.encode()).hexdigest())
    eight = {r.doc_id: r.n_tokens for r in queries.op8_token_counts(spark, SF).collect()}
    assert [eight[d.doc_id] for d in docs] == list(map(len, library("byte_bpe_50k.json", texts)))
    ten = queries.op10_packing(spark, SF).collect()
    assert packed_right(ten, texts, 4096) < 0.02 * sum(r.length for r in ten)
