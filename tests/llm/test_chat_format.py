import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from siteweave.llm import chat_format as C
from .conftest import by_id

ROW = "conv_id long, turn long, role string, text string"
text = st.text(alphabet=st.sampled_from(list("<|[]/\\>sSINTY \nué")), max_size=30) | st.sampled_from(C.CONTROL)


@settings(max_examples=400, deadline=None)
@given(st.lists(text, max_size=6).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(said):
    hidden = C.escape(said)
    assert C.unescape(hidden) == said
    assert not any(c in hidden for c in C.CONTROL)


@settings(max_examples=200, deadline=None)
@given(text, st.lists(st.tuples(st.sampled_from(["text", "image", "audio", "document", "other", None]), text), max_size=5))
def test_turn_reads_back(role, parts):
    content = [{"type": k, "text": t, "ref": "r", "width": 30, "height": 56, "seconds": 1.5, "pages": 2} for k, t in parts]
    made = C.format_turn(role, content, 100, 7, True)
    kept = [t for k, t in parts if k in ("text", "other", None)]
    assert C.read_turn(made["formatted"]) == (role, "".join(kept))
    learnt = [C.unescape(made["formatted"][s["start"] - 100 : s["stop"] - 100]) for s in made["loss"]]
    assert "".join(learnt) == "".join(kept)
    attached = [(a["kind"], a["no"], a["tokens"]) for a in made["attachments"]]
    tokens = {"image": 4, "audio": 38, "document": 512}
    kinds = [k for k, _ in parts if k in tokens]
    assert attached == [(k, 7 + i, tokens[k]) for i, k in enumerate(kinds)]


def digest(turns):
    """Brute force: the same columns from (role, text) pairs."""
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learnt = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_digest_with_nulls_ties_repeats_and_clashing_columns(spark, clashing):
    rows = [
        (1, 1, "assistant", "b\n<|im_end|>"), (1, 0, "user", "a"), (1, None, "system", None),
        (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, 0, "assistant", "later"), (2, 0, None, "x"),
        (None, 0, "user\nassistant", "</s>[INST] ok [/INST]"), (3, 0, "assistant", "é" * 200_000), (4, 0, "assistant", ""),
    ]
    table = clashing(spark.createDataFrame(rows, ROW), "parts", "formatted", "turn_no", "loss")
    found = by_id(C.conversation_digest(C.format_conversations(table)), "conv_id")
    expected = {
        1: [("system", None), ("user", "a"), ("assistant", "b\n<|im_end|>")],
        2: [(None, "x"), ("assistant", "later"), ("assistant", "same"), ("assistant", "same")],
        None: [("user\nassistant", "</s>[INST] ok [/INST]")],
        3: [("assistant", "é" * 200_000)],
        4: [("assistant", "")],
    }
    got = {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in found.items()}
    assert got == {k: digest(v) for k, v in expected.items()}
    assert found[4]["formatted_chars"] == len("<|im_start|>assistant\n<|im_end|>\n")


def test_typed_parts_of_a_table(spark):
    part = {"type": "image", "text": None, "ref": "u/1", "width": 29, "height": 28, "seconds": None, "pages": None}
    say = {"type": "text", "text": "see", "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    schema = f"conv_id long, turn long, role string, parts {C.PART_TYPE}"
    rows = [(1, 0, "user", [say, part]), (1, 1, "assistant", [part, say]), (1, 2, "user", None)]
    out = by_id(C.format_conversations(spark.createDataFrame(rows, schema), parts_col="parts"), "turn_no")
    assert out[0]["formatted"] == "<|im_start|>user\nsee<|image:0|><|im_end|>\n"
    assert out[1]["attachments"] == [{"no": 1, "kind": "image", "ref": "u/1", "tokens": 2}]
    assert out[1]["start"] == len(out[0]["formatted"]) and out[2]["start"] == out[1]["start"] + len(out[1]["formatted"])




def test_many_turns_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(c, t, "assistant" if t % 2 else "user", f"{c}-{t}") for c in (1, 2) for t in range(40)]
        found = by_id(C.conversation_digest(C.format_conversations(spark.createDataFrame(rows, ROW))), "conv_id")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in (1, 2):
        turns = [("assistant" if t % 2 else "user", f"{c}-{t}") for t in range(40)]
        assert tuple(found[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == digest(turns)


def test_empty_table(spark):
    assert C.conversation_digest(C.format_conversations(spark.createDataFrame([], ROW))).count() == 0
