"""Sentence spans against a plain implementation."""

import random
import re

import pytest

from foldwise.llm import spans as S

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sentences(text):
    """[(begin, end, words)] over the bytes of the text."""
    raw = text.encode()
    words = [(m.start(), m.end()) for m in WORD.finditer(raw)]
    out, hard, own, first = [], 0, 0, 0
    for k, (a, b) in enumerate(words):
        end = k + 1 == len(words) or raw[b - 1:b] in (b".", b"!", b"?") or b"\n" in raw[b:words[k + 1][0]]
        inner = raw[b - 1:b] in (b",", b";", b":") and hard >= S.INNER_FROM - 1
        hard = 0 if end else hard + 1
        own += 1
        if end or inner or own % S.MAX_WORDS == 0:
            out.append((first, k + 1))
            first = k + 1
            own = 0
    begin = [0 if i == 0 else words[f][0] for i, (f, _) in enumerate(out)]
    stop = begin[1:] + [len(raw)]
    low = [tuple(raw[a:b].lower() if raw[a:b].isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in raw[a:b])
                 for a, b in words[f:t]) for f, t in out]
    return raw, list(zip(begin, stop, low))


def brute(rows):
    """{(key, text): cleaned text}, documents in the order of their keys."""
    seen, out = set(), {}
    for k, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw, cut = sentences(t)
        gone = set()
        for i in range(len(cut)):
            e = i + S.SPAN
            while e < len(cut) and sum(len(c[2]) for c in cut[i:e]) < S.MIN_WORDS:
                e += 1
            w = tuple(c[2] for c in cut[i:e])
            if e <= len(cut) and sum(map(len, w)) >= S.MIN_WORDS:
                if w in seen:
                    gone.update(range(i, e))
                seen.add(w)
        keep = bytearray()
        at = 0
        for i, (a, b, _) in enumerate(cut):
            if i not in gone:
                keep += raw[a:b]
            at = b
        out[(k, t)] = (bytes(keep) + raw[at:]).decode()
    return out


def random_rows(seed):
    rnd = random.Random(seed)
    word = ["the", "cat", "Sat", "é", "über", "on", "a", "mat.", "end!", "why?", "so,", "then;", "\n", "  ", "\t", "x" * 40]
    bank = [" ".join(rnd.choices(word, k=rnd.randint(5, 60))) for _ in range(25)]
    return [(i, " ".join(rnd.choices(bank, k=rnd.randint(1, 4)))) for i in range(80)] + [
        (200, None), (201, ""), (202, " \n "), (None, bank[0] + " " + bank[1]), (5, "x"), (6, "y")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_documents(spark, seed):
    rows = random_rows(seed)
    rows = [r for r in rows if r not in ((5, "x"), (6, "y"))] + [rows[9]]  # one row twice
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_removed int, _gone string")
    out = S.dedup_spans(docs.repartition(4)).collect()
    assert len(out) == len(rows)
    want = brute(rows)
    for r in out:
        texts = [want[(k, t)] if t is not None else None for k, t in rows if k == r.doc_id]
        assert r.text in texts


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {k: v for (k, _), v in brute(rows).items()}
    out = S.dedup_spans(docs)
    assert out.columns == [*docs.columns, "n_sentences", "n_removed"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == want


def test_shared_passages_go_and_clean_documents_stay(spark):
    rnd = random.Random(12)
    make = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) + rnd.choice(["", "", "", "", ",", "."]) for _ in range(n))
    passage = make(60)
    rows = [(i, make(150)) for i in range(40)]
    rows += [(100 + i, f"{make(20)} {passage} {make(30)}") for i in range(30)]
    out = {r.doc_id: r for r in S.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].n_removed == 0 and out[i].text == t for i, t in rows[:41])
    middle = " ".join(passage.split()[20:40])
    assert all(middle not in out[i].text for i, _ in rows[41:])


def test_empty_table(spark):
    assert S.dedup_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_both_ends(rows):
    """``brute`` with the shortest runs that begin at and that end with each sentence."""
    seen, out = set(), {}
    for k, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw, cut = sentences(t)
        n = [len(c[2]) for c in cut]
        fits = lambda i, e: 0 <= i and e <= len(cut) and e - i >= S.SPAN and sum(n[i:e]) >= S.MIN_WORDS
        runs = {next(((i, e) for e in range(i + 1, len(cut) + 1) if fits(i, e)), None) for i in range(len(cut))}
        runs |= {next(((i, e) for i in range(e - 1, -1, -1) if fits(i, e)), None) for e in range(1, len(cut) + 1)}
        gone = set()
        for i, e in sorted(runs - {None}):
            w = tuple(c[2] for c in cut[i:e])
            if w in seen:
                gone.update(range(i, e))
            seen.add(w)
        keep = b"".join(raw[a:b] for i, (a, b, _) in enumerate(cut) if i not in gone)
        out[(k, t)] = (keep + raw[cut[-1][1] if cut else 0:]).decode()
    return out


def test_both_ends_match_brute_force(spark):
    rows = [r for r in random_rows(4) if r not in ((5, "x"), (6, "y"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_both_ends(rows)
    for r in S.dedup_spans(docs, both_ends=True).collect():
        assert r.text == want.get((r.doc_id, dict(rows)[r.doc_id]))


def test_query_removes_whole_passages_and_copies(spark, tmp_path):
    """Every sentence of a shared passage goes, short last ones too, and exact copies become empty."""
    from foldwise.llm.queries import op4_span_dedup

    rnd = random.Random(15)
    sentence = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=8)) for _ in range(n)) + "."
    shared = [[12, 12, 7], [13, 9, 4, 3], [7, 16, 16, 5], [11, 11]]
    passages = [[sentence(n) for n in sizes] for sizes in shared]
    own = [(sentence(9), sentence(14)) for _ in range(24)]
    rows = [(i, f"{a} {' '.join(passages[i % 4])} {b}") for i, (a, b) in enumerate(own)]
    rows += [(100 + i, t) for i, t in rows[:8]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.text for r in op4_span_dedup(spark, str(tmp_path)).collect()}
    for i, (a, b) in enumerate(own):
        assert out[i] == (rows[i][1] if i < 4 else f"{a} {b}")
    assert all(out[100 + i] == "" for i in range(8))
