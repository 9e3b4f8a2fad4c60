"""The corpus pipeline, stage by stage and as a whole, against the operators' brute-force versions."""

import test_ngram_join
import test_spans
from test_line_dedup import brute as brute_lines
from test_packing import library_ids

import corpus_pipeline as P
from foldwise.llm import line_dedup

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def one_of_each(rows, n, num, den):
    comp = {d: c for d, k, c in test_ngram_join.brute(rows, n, num, den) if k}
    return sorted(r for r in rows if comp.get(r[0], r[0]) == r[0])


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    all_rows = rows_of(docs)

    now = docs
    for name, stage in P.STAGES[:4]:
        before = rows_of(now)
        now = P.stash(stage(spark, now, SF), "test-stage")
        assert now.columns == columns, name
        after = rows_of(now)
        if name == "quality classifier":
            kept = {d for d, _ in after}
            assert set(after) <= set(all_rows)
            good = [d for d, q in labels.items() if q == 1]
            bad = [d for d, q in labels.items() if q == 0]
            assert sum(d in kept for d in good) > 0.99 * len(good)
            assert sum(d in kept for d in bad) < 0.1 * len(bad)
        elif name == "line dedup":
            want = {d: t for (d, _), t in brute_lines(before, line_dedup.MIN_LINES).items()}
            assert after == sorted((d, want[d]) for d, t in before if want[d] == t or want[d].strip())
        elif name == "n-gram join":
            assert after == one_of_each(before, P.WORDS, P.NUM, P.DEN)
        else:
            want = {d: t for (d, _), t in test_spans.brute_both_ends(before).items()}
            assert after == sorted((d, want[d]) for d, t in before if want[d] == t or want[d].strip())
        assert all(r.n_chars == len(r.text) for r in now.collect())
    final = rows_of(now)
    out = P.run(spark, SF).collect()
    tokens = {}
    for r in out:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {d: len(x) // 4 for (d, _), x in zip(final, library_ids([t for _, t in final]))}


def test_near_duplicates_are_found_at_five_words(spark):
    rows = test_ngram_join.near_copies(21)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(P.near_deduped(spark, docs, SF)) == one_of_each(rows, 5, 80, 100)


def test_edges(spark):
    text = "some plain words that are here\nand a second line of it\nand a third one\nlast"
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (1, "other words for the same key", None, None, None), (2, None, "en", "s", None),
            (3, "", "en", "s", 0), (3, "", "en", "s", 0), (None, text, "en", "s", 1), (4, "x " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, score int, n_removed int")
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = rows_of(out.where("doc_id is not null"))
        assert stage(spark, docs.where("false"), SF).count() == 0
        if name == "n-gram join":  # one row of each text with words; both empty rows and the null text stay
            assert sorted(map(str, got)) == sorted(map(str, [(1, rows[2][1]), (1, text), (2, None), (3, ""), (3, ""), (4, rows[-1][1])]))
            assert out.where("doc_id is null").count() == 0
    assert P.packed(spark, docs, SF).where("doc_id = 3").count() == 2


def test_substring_stage_removes_passages_up_to_both_ends(spark):
    rows = [r for r in test_spans.random_rows(5) if r[0] is not None and r[1]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows if i != 5 and i != 6],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    before = rows_of(docs)
    want = {d: t for (d, _), t in test_spans.brute_both_ends(before).items()}
    assert want != {d: t for (d, _), t in test_spans.brute(before).items()}
    assert rows_of(P.spans_deduped(spark, docs, SF)) == sorted((d, want[d]) for d, t in before if want[d] == t or want[d].strip())
