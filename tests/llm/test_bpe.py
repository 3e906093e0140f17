"""Byte-level BPE against the library."""

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from labelspark.llm import byte_bpe
from tests.llm.data import awkward, plain, table

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_boundaries_are_those_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    pick = random.Random(1)
    signs = list("ab's 're'll  \n\t'tmdv5!?é中  ½Ⅷ_-\x1c\x85") + [
        "don't", "''s", " 's", "\n's", "we'll", "'S", "\U0001f600",
    ]
    for _ in range(400):
        texts = ["".join(pick.choices(signs, k=pick.randint(1, 25))) for _ in range(20)]
        whole = "".join(texts)
        import numpy as np

        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(codes), bool)
        first[np.cumsum([0] + [len(t) for t in texts[:-1]])] = True
        cuts = np.flatnonzero(byte_bpe.boundaries(codes, first)).tolist() + [len(whole)]
        assert [whole[a:b] for a, b in zip(cuts, cuts[1:])] == [
            p for t in texts for p in pattern.findall(t)
        ]


def test_merges_equal_the_library(library):
    pick = random.Random(2)
    own = byte_bpe.Codec(PATH)
    texts = ["".join(pick.choices("abcdefghé", k=n)) for n in (1, 5, 50, 199, 201, 3000)]
    texts += ["a" * 1000, "!" * 777, "中" * 300]
    for text, ids in zip(texts, own.encode(pa.array(texts))[0]):
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text)


def test_query_equals_the_library(spark, library):
    want = []
    for doc_id, text in awkward():
        ids = library.encode_ordinary(text or "")
        want.append((
            doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        ))
    assert plain(byte_bpe.digests(table(spark, clashing=True), PATH)) == sorted(want, key=repr)
    assert byte_bpe.digests(table(spark, []), PATH).count() == 0


def test_encode_gives_ids_and_bytes(spark, library):
    for r in byte_bpe.encode(table(spark, [(1, "It's  so\n\n"), (2, None)]), PATH).collect():
        text = {1: "It's  so\n\n", 2: ""}[r.doc_id]
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_memo_may_start_anew():
    own = byte_bpe.Codec(PATH)
    own.memo.limit = 3
    once = own.encode(pa.array(["one two three four", "five"]))
    assert own.encode(pa.array(["one two three four", "five"])) == once
