"""The tree encoder against the library, exactly."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilframe.llm.bpe import Codec, encode_texts, vocabulary_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "it's  we'll\n\n x", "   \n\nword  z\x1c\x1d b", "\x85\x85a", "<|endoftext|>",
    "a<|endoftext|> b<|endo", "émoji 😀😀 ß", "x" * 3000, "ab" * 2000 + " " * 700 + "\t" * 300 + "end",
    "".join(random.Random(1).choices("abcdefghij,.'1é😀", k=6000)), "don't" * 400 + "'" + "re" * 500,
    "q" * 900 + "<|endoftext|>" + "z" * 900, "日本語" * 500,
]


@pytest.fixture(scope="module")
def coder():
    return Codec(vocabulary_of(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_trees_equal_the_library(coder, library):
    rng = random.Random(7)
    for text in TEXTS[1:]:
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(coder.encode(text)) == text
    for _ in range(200):
        token = "".join(rng.choices("etaoinshr", k=rng.randint(1, 900)))
        assert coder.tree(token.encode()) == library.encode(token, add_special_tokens=False).ids
    mixed = " ".join(
        "".join(rng.choices("etaoin'.,;!<|>éßñ12😀\xa0\x85\x1c", k=rng.randint(1, 12))) + rng.choice(["", "\n", " \n", "'s", "<|endoftext|>"])
        for _ in range(6000))
    assert coder.fast and coder.encode(mixed) == library.encode(mixed, add_special_tokens=False).ids
    assert coder.memo and coder.long_unit("x" * 3000) == coder.encode("x" * 3000)


@pytest.mark.parametrize("parallel", [64, 1000, 1 << 16])
def test_texts_in_pieces(spark, library, parallel):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0), (12, TEXTS[12], 0), (None, TEXTS[10], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = encode_texts(docs, "doc_id", "text", PATH, digest=True, parallel=parallel).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        want.append((i, len(ids), *sha))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_no_rows_and_full_results(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode_texts(docs, "doc_id", "text", PATH).collect() == []
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    row = encode_texts(docs, "doc_id", "text", PATH).first()
    assert (row.n_tokens, row.decoded) == (2, "hello world") and row.ids.count(",") == 1
