"""Vector bin packing and its tokenised pieces."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldwise.llm.packing import MAX_LOSS_TOKENS, MAX_SEGMENTS, ChunkEncoder, pack, pack_documents, pack_items, tokenise
from foldwise.llm.queries import END_ID, op6_packing, tokenizer

PATH = tokenizer("word_bpe_49k.json")


def library_ids(texts):
    tok = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, END_ID], dtype="<u4").tobytes()
            for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_chunks_match_the_library():
    rnd = random.Random(3)
    mix = [*map(chr, range(0, 0x250)), "́", "Σ", "ς", "İ", "K", "가", "中", " ", *[" "] * 50, *["\n"] * 20,
           "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "Word. ", "Straße, ", "É", "x" * 300]
    texts = ["".join(rnd.choices(mix, k=rnd.randint(0, 50))) for _ in range(3000)]
    assert ChunkEncoder(PATH, END_ID)(texts) == library_ids(texts)


def test_new_latin_words_go_to_the_model_alone():
    texts = ["Zorfel blümig!! grün*** NAÏVE, x1 don't ß. ªµ~", "Zorfel. 中 ÀÉ!? <|endoftext|> blümig"]
    encode, slow = ChunkEncoder(PATH, END_ID), []
    plain = encode._encode
    encode._encode = lambda parts: slow.extend(parts) or plain(parts)
    assert encode(texts) == encode(texts) == library_ids(texts)
    assert sorted(slow) == sorted(["!!", "***", ",", ".", "!?", "~", "x1", "don't", "中", "<|endoftext|>"])
    encode = ChunkEncoder(PATH, END_ID)
    encode.last[:] = False  # as in a vocabulary that does not mark the ends of words
    assert encode(texts) == library_ids(texts)


def test_items_respect_every_limit():
    rng = np.random.default_rng(1)
    demand = np.stack([rng.integers(0, 50, 800), np.ones(800, int), rng.integers(0, 30, 800)], axis=1)
    demand[:, 2] = np.minimum(demand[:, 2], demand[:, 0])
    limits = np.array([100, 6, 40])
    seq, order = pack_items(demand, limits)
    for s in np.unique(seq):
        rows = seq == s
        assert (demand[rows].sum(axis=0) <= limits).all()
        assert sorted(order[rows]) == list(range(rows.sum()))


def test_pieces_tile_documents_and_sequences(spark):
    SF_MID = "/root/testdata/sf0.01"

    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(texts, library_ids(texts.values())))
    out = pack_documents(docs, PATH, END_ID).collect()
    at_doc, at_seq = {}, {}
    for r in out:
        at_doc.setdefault(r.doc_id, []).append(r)
        at_seq.setdefault(r.sequence_id, []).append(r)
    assert set(at_doc) == set(texts)
    for d, rows in at_doc.items():
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        assert sum(r.length for r in rows) == len(ids[d]) // 4 == rows[0].doc_tokens
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(ids[d][4 * r.start:4 * (r.start + r.length)])
    used = 0
    for rows in at_seq.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        assert sum(r.length for r in rows) <= 4096
        used += sum(r.length for r in rows)
    assert used / (4096 * len(at_seq)) > 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (2, "", 4), (None, "word " * 9000, 5)],
                                 "doc_id long, text string, sequence_id int")
    got = tokenise(docs, PATH, END_ID).collect()
    assert sorted(r.length for r in got) == [1, 1, 1, 809, 4096, 4096]
    sizes = {r.sequence_id: 0 for r in pack_documents(docs, PATH, END_ID).collect()}
    assert len(sizes) == 3
    out = pack_documents(docs, PATH, END_ID).collect()
    assert len(out) == 6 and sum(r.length for r in out) == 9004
    assert pack_documents(docs.where("false"), PATH, END_ID).count() == 0
    with pytest.raises(Exception, match="above the limits"):
        pack(spark.createDataFrame([(1, 5000)], "id int, length long")).collect()


def plain_packing(demand, limits):
    """The heuristic, item by item: sequences as sorted lists of demands."""
    left, out = [tuple(map(int, d)) for d in demand], []
    while left:
        room, here = list(map(int, limits)), []
        while True:
            fit = [d for d in left if all(a <= b for a, b in zip(d, room))]
            if not fit:
                break
            best = max(fit, key=lambda d: (sum(x / m * (r / m) for x, m, r in zip(d, limits, room)), [-x for x in d]))
            here.append(best)
            left.remove(best)
            room = [r - x for r, x in zip(room, best)]
        out.append(here)
    return out


def test_placement_is_the_dot_product_heuristic():
    rng = np.random.default_rng(5)
    limits = np.array([97, 6, 41])
    for n in (1, 30, 120):
        demand = np.stack([rng.integers(0, 60, n), np.ones(n, int), rng.integers(0, 41, n)], axis=1)
        seq, order = pack_items(demand, limits)
        got = [[tuple(map(int, demand[i])) for i in sorted(np.flatnonzero(seq == s), key=lambda i: order[i])] for s in range(seq.max() + 1)]
        assert got == plain_packing(demand, limits)


def test_equal_rows_are_dealt_evenly(spark):
    rows = spark.createDataFrame([(7, 3)] * 5000, "doc_id int, length long").repartition(5)
    out = pack(rows, group_size=100)
    sizes = [r["count"] for r in out.groupBy((F.col("sequence_id") / (1 << 24)).cast("long").alias("g")).count().collect()]
    assert len(sizes) == 50 and max(sizes) <= 100
    assert out.groupBy("sequence_id").agg(F.countDistinct("offset").alias("d"), F.count(F.lit(1)).alias("n")).where("d <> n").isEmpty()


def test_all_three_limits_bind_in_the_query(spark):
    out = op6_packing(spark, "/root/testdata/sf0.1").groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum(F.col("length") - 1).alias("loss")).collect()
    assert all(r.tokens <= 4096 and r.segments <= MAX_SEGMENTS and r.loss <= MAX_LOSS_TOKENS for r in out)
    assert any(r.tokens == 4096 for r in out)
    assert any(r.segments == MAX_SEGMENTS for r in out)
    assert any(r.loss == MAX_LOSS_TOKENS and r.tokens < 4096 for r in out)
    assert sum(r.tokens for r in out) > 0.985 * 4096 * len(out)


def test_loss_column_and_segments_bind(spark):
    items = spark.createDataFrame([(i, 10, 4) for i in range(100)], "id int, length long, loss long")
    out = pack(items, loss_col="loss", max_tokens=1000, max_segments=7, max_loss=20).collect()
    sizes = {}
    for r in out:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + 1
    assert max(sizes.values()) == 5 and len(sizes) == 20
