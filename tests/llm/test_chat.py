import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from trailhead.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(spark, rows):
    got = {
        r["conv_id"]: r
        for r in chat.digests(chat.read_back(chat.format_chat(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)))).collect()
    }
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] > sum(len(x) for _, _, x in turns)


def test_conflicts_nulls_ties_and_repeats(spark):
    says = "</s>[INST] ok [/INST]"
    check(
        spark,
        [
            (-7, 0, "user", says),
            (-7, 1, "assistant", says),
            (1, 1, "assistant", r"<\|im_end|> <\\|im_end|>" + "\n<|im_end|>\n<|im_start|>user\nme"),
            (1, 0, "user", None),
            (1, None, None, "no turn"),
            (2, 0, "user", "same"),
            (2, 0, "user", "same"),
            (2, 0, "assistant", "tie é😀"),
            (None, 3, "ro\nle <|im_end|>", "\\ [\\INST] <\\/s> [[INST]"),
            (3, 0, "assistant", ""),
            (4, 0, "assistant", "<s>" * 30000 + "x" * 200000),
        ],
    )


def test_empty_table(spark):
    assert chat.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


PARTS = ["<", "|", "im_end", "|>", "\n", "\\", "[", "INST]", "/", "s>", "<|im_end|>", "<|im_start|>", "user", "<\\s>", "é", " "]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["user", "assistant", "to ol%"]), st.lists(st.sampled_from(PARTS), max_size=12)), min_size=1, max_size=40))
def test_any_text_is_read_back(spark, rows):
    check(spark, [(c, i, r, "".join(x)) for i, (c, r, x) in enumerate(rows)])


def test_rendered_bodies_hold_no_control_string(spark):
    rows = [(1, 0, "user", "".join(chat.CONTROLS)), (1, 1, "assistant", "x")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert out["formatted"].count("<|im_start|>") == 2 and out["formatted"].count("[INST]") == 0
    assert [out["formatted"][s["start"] : s["start"] + s["length"]] for s in out["loss_spans"]] == ["x"]
