"""BPE encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from foldwise.llm.bpe import ByteBPE, encode_decode
from foldwise.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")
MIX = [*map(chr, range(0, 0x250)), "́", "՘", "࢏", "中", "😀", "​", "\x85", " ", "\x1c",
       *[" "] * 60, *["\n"] * 20, "'ll", "'S", "<|endoftext|>", "  ", "the ", "a" * 300, "\r\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, texts):
    return [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_match_the_library(library):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(MIX, k=rnd.randint(0, 50))) for _ in range(3000)]
    bpe = ByteBPE(PATH)
    got = bpe.encode(texts)
    assert got == expected(library, texts)
    for ids in got[:1000]:
        assert bpe.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_short_and_long_trees_agree():
    rnd = random.Random(9)
    bpe = ByteBPE(PATH)
    words = ["".join(rnd.choices("theranido", k=n)).encode() for n in (1, 2, 3, 31, 64, 200, 256)]
    assert bpe.merge(words) == [bpe._merge_long(w) for w in words]


def test_very_long_piece(library):
    text = "ab" * 20_000
    assert ByteBPE(PATH).encode([text]) == expected(library, [text])


def test_decode_of_broken_utf8(library):
    bpe = ByteBPE(PATH)
    ids = np.array([int(bpe.byte_id[0xE4]), int(bpe.byte_id[0x41]), int(bpe.byte_id[0xFF])], dtype="<u4")
    assert bpe.decode(ids.tobytes()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_rows_nulls_empties_repeats_and_clashing_names(spark):
    rows = [(1, None, "x", 7), (2, "", "y", 7), (2, "", "y", 7), (None, "Hello  world", "z", 7), (5, "a b", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_le string, decoded int")
    got = sorted(map(tuple, encode_decode(docs, PATH).collect()), key=str)
    want = [(i, bytearray(ByteBPE(PATH).encode([t])[0]), t or "") for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    assert encode_decode(docs.where("false"), PATH).count() == 0


def test_query_digests(spark, library):
    SF_SMALL = "/root/testdata/sf0.001"
    from foldwise.llm.queries import op1_bpe

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = op1_bpe(spark, SF_SMALL).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = expected(library, [docs[r.doc_id]])[0]
        assert r.n_tokens == len(ids) // 4
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
