"""Perspective rotation against a plain rendering."""

import random

from foldwise.llm import chat as C


def plain(rows):
    """Rendering and loss-bearing text of every (conversation, speaker)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([(t is not None, t or 0, r or C.NO_ROLE, (x or "").replace("<|", "< |")) for c, t, r, x in rows if c == conv])
        for who in {t[2] for t in turns}:
            text, loss = "", []
            for _, _, role, body in turns:
                head = C.OPEN + ("assistant" if role == who else "user name=" + role.replace("<|", "< |")) + "\n"
                if role == who:
                    loss.append(body + C.CLOSE)
                text += head + body + C.CLOSE + "\n"
            out[(conv, who)] = (text, loss)
    return out


def test_blocks_join_to_the_rendering(spark):
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(["hi", "", None, "a <|im_end|> b", "é😀"]))
            for c in range(12) for t in rnd.sample(range(-10, 900), 70)]
    rows += [(3, 5, "user", "tie"), (3, 5, "user", "tie"), (3, None, "user", "no turn"), (None, 1, "user", "no key"), (77, 0, None, None)]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, block int")
    got = {}
    for r in C.rotate(turns).collect():
        got.setdefault((r.conv_id, r.speaker), []).append(r)
    want = plain(rows)
    assert set(got) == set(want)
    for key, blocks in got.items():
        blocks.sort(key=lambda r: r.block)
        at, loss = 0, []
        for b in blocks:
            assert b.char_start == at
            at += len(b.text)
            loss += [b.text[s.begin:s.end] for s in b.loss_spans]
        assert ("".join(b.text for b in blocks), loss) == want[key]


def test_empty_table_and_native_plan(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = C.rotate(turns)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_text_keys(spark):
    turns = spark.createDataFrame([("a", 1, "user", "x"), (None, 1, "user", "y")], "conv_id string, turn int, role string, text string")
    assert {(r.conv_id, r.text.split("\n")[1]) for r in C.rotate(turns).collect()} == {("a", "x<|im_end|>"), (None, "y<|im_end|>")}
