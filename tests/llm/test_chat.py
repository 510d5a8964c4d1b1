"""Views, masks and parts of dialogues."""

from tessera.llm import chat


def test_views_of_every_participant(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", "Hello"), (1, 2, "bob", "Hello"), (1, 3, "ann", None), (2, None, None, "alone"), (None, 5, "z", "lost"), (3, 0, "system", "no one")]
    got = {(r.conv_id, r.perspective): r for r in chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("conv_id", "conv_id")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "z")}
    ann = got[1, "ann"]
    assert ann.text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi <|im_end|><|im_end|>\n<|im_start|>user name=bob\nHello<|im_end|>\n<|im_start|>user name=bob\nHello<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [ann.text[s.start : s.end] for s in ann.mask] == ["Hi <|im_end|><|im_end|>", "<|im_end|>"]
    bob = got[1, "bob"]
    assert [bob.text[s.start : s.end] for s in bob.mask] == ["Hello<|im_end|>"] * 2 and bob.n_turns == 5


def plain(rows):
    """Text and masks of each whole view, from all rows at once."""
    out = {}
    rows = [(c, t, r or "unknown", s or "") for c, t, r, s in rows]
    for conv, who in {(c, r) for c, _, r, _ in rows if r != "system"}:
        text, spans = "", []
        for _, _, role, said in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode())):
            text += chat.OPEN + ("assistant" if role == who else role if role == "system" else f"user name={role}") + "\n"
            spans += [(len(text), len(text) + len(said + chat.CLOSE))] if role == who else []
            text += said + chat.CLOSE + "\n"
        out[conv, who] = text, spans
    return out


def test_long_dialogues_come_in_ordered_parts(spark):
    rows = [(1, t, "ab"[t % 2], f"t{t}" * (t % 9)) for t in range(25)] + [(1, 30, "a", f"same{k}é\U0001f600") for k in range(40)] + [(1, 31, "b", "copy")] * 35 + [(1, 40, "system", "end"), (1, None, None, None)]
    rows += [(None, k % 4, "xyz"[k % 3], f"lost {k % 7}") for k in range(60)] + [(2, k, "a", "ten rows") for k in range(10)] + [(3, k, "a", "eleven rows") for k in range(11)]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7), part_rows=10).collect()
    assert max(r.n_turns for r in got) == 10 and sum(r.n_turns for r in got if r.conv_id == 1 and r.perspective == "a") == sum(r[0] == 1 for r in rows)
    views = {}
    for r in sorted(got, key=lambda r: r.part):
        text, spans = views.get((r.conv_id, r.perspective), ("", []))
        assert r.start == len(text)
        views[r.conv_id, r.perspective] = text + r.text, spans + [(s.start, s.end) for s in r.mask]
    assert views == plain(rows)


def test_no_rows(spark):
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
