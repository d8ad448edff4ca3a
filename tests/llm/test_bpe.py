import base64
import gc
import hashlib
import random
import weakref

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe
from tidemark.llm.common import table

RAW = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    char = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), 0x1F600 + rng.randrange(50), 32, 10]))
    return ["", "a" * 3000, "ab" * 700 + "the" * 500, " " * 1000, "你好世界" * 400, "\n\n \t x", "!!!???" * 200, "it's we'll 'S", "<|endoftext|>"] + ["".join(char() for _ in range(rng.randrange(1, 900))) for _ in range(150)]


@pytest.mark.parametrize("block, memo", [(1 << 18, 200_000), (50, 30)])
def test_ids_match_the_library(library, monkeypatch, block, memo):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
    monkeypatch.setattr(bpe, "MEMO_PIECES", memo)
    coder = bpe.ByteBPE(RAW, public_tokenizers.PATTERN)
    texts = odd_texts()
    for text, ids in zip(texts, coder.encode_many(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_documents(spark, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    vocabulary = bpe.public_vocabulary(spark)
    for r in bpe.token_digests(docs, vocabulary).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_edge_cases(spark, make_docs):
    vocabulary = bpe.public_vocabulary(spark)
    rows = [(1, None), (2, ""), (None, "x y"), (3, "r"), (3, "r"), (4, "long words " * 50_000)]
    got = {(r["doc_id"]): r for r in bpe.encode_documents(make_docs(rows), vocabulary).collect()}
    assert got[1]["ids"] == got[2]["ids"] == [] and bytes(got[1]["decoded"]) == b""
    assert bytes(got[4]["decoded"]) == b"long words " * 50_000
    assert bpe.token_digests(make_docs(rows), vocabulary).count() == len(rows)
    assert bpe.token_digests(make_docs([]), vocabulary).count() == 0


def test_an_encoder_goes_with_its_vocabulary(spark):
    vocabulary = bpe.public_vocabulary(spark)
    held = weakref.ref(vocabulary.encoder())
    assert vocabulary.encoder() is held()
    del vocabulary
    gc.collect()
    assert held() is None
