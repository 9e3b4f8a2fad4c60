"""Line dedup against its SQL and a brute-force search for repeated runs."""

import random

import pytest

from foldwise.llm import queries as Q
from foldwise.llm.line_dedup import dedup_lines, suffix_intervals

SCHEMA = "doc_id long, text string, d int, t string, runs string"


def brute(rows, h, min_words=50):
    """Lines to delete: every window of h lines, or of fewer with min_words words, that an earlier place has too."""
    rows = sorted({(k, t) for k, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), {}
    for k, t in rows:
        lines = t.split("\n")
        for n in range(1, h + 1):
            for i in range(len(lines) - n + 1):
                w = tuple(lines[i:i + n])
                if n < h and sum(len(x.split()) for x in w) < min_words:
                    continue
                if w in seen:
                    gone.setdefault((k, t), set()).update(range(i, i + n))
                seen.add(w)
    return {(k, t): "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((k, t), ())) for k, t in rows}


@pytest.mark.parametrize("h", [1, 2, 3, 4, 5])
def test_random_documents(spark, h):
    rnd = random.Random(h)
    rows = [(i, "\n".join(rnd.choices("abcx", k=rnd.randint(0, 25)))) for i in range(60)]
    rows += [(100 + i, "\n".join(["same"] * 9 + [str(i)])) for i in range(5)] + [(None, rows[3][1]), (7, rows[7][1])]
    rows += [(200, "\n".join(map(str, range(40)))), (201, "\n".join(map(str, range(40)))), (202, None), (203, "")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    want = brute(rows, h)
    out = dedup_lines(docs, h)
    assert out.columns == ["doc_id", "text", "d", "t", "runs", "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append(r.text)
    for k, t in rows:
        assert texts[k].count(want[(k, t)] if t is not None else None) == sum(a == k for a, _ in rows)


@pytest.mark.parametrize("h", [1, 3, 4])
def test_long_runs_of_few_lines(spark, h):
    rnd = random.Random(30 + h)
    lines = [" ".join(rnd.choices("abc", k=rnd.randint(0, 9))) for _ in range(12)] + ["word " * 10, "word " * 9]
    rows = [(i, "\n".join(rnd.choices(lines, k=rnd.randint(1, 12)))) for i in range(80)]
    rows += [(100, "word " * 10), (101, "word " * 10), (102, "word " * 9), (103, "word " * 9), (104, None)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
    want = brute(rows, h, 10)
    assert {r.doc_id: r.text for r in dedup_lines(docs, h, min_words=10).collect()} == {
        k: want[(k, t)] if t is not None else None for k, t in rows}


def test_intervals_are_the_classes_of_the_next_lines(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choices("ab", k=30)) for i in range(8)]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    depths = []
    for h, members in suffix_intervals(docs, 3):
        depths.append(h)
        by_rank = {}
        for r in members.collect():
            by_rank.setdefault(r["rank"], set()).add((r.d, r.pos))
        by_run = {}
        for i, t in rows:
            for p in range(len(t) - h + 1):
                by_run.setdefault(tuple(t[p:p + h]), set()).add((i, p))
        assert sorted(map(sorted, by_rank.values())) == sorted(sorted(v) for v in by_run.values() if len(v) > 1)
        # ranks are the places of the intervals: they do not overlap
        order = sorted((k, len(v)) for k, v in by_rank.items())
        assert all(a + n <= b for (a, n), (b, _) in zip(order, order[1:]))
    assert depths[:2] == [3, 6]


def test_no_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.doc_id, r.text, r.n_removed) for r in dedup_lines(docs).collect()} == {(1, "a\nb", 0), (2, None, 0), (3, "", 0)}
    assert dedup_lines(docs.where("false")).count() == 0


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_chat", "op9_ngram_join", "op10_embedding_dedup"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    from oracle_check import compare, open_duckdb

    path = f"/root/testdata/{sf}"
    assert compare(Q.QUERIES[name](spark, path), open_duckdb(path), Q.ORACLES[name]) is None
