import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papershed.llm import chat_format as C
from papershed.llm.queries import ORACLE_SQL, QUERIES

TURNS = "conv_id long, turn long, role string, text string, formatted string, loss_spans int"


def digest(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)
    return {r["conv_id"]: r for r in C.digests(C.format_conversations(df)).collect()}


def expected(rows):
    rows = sorted(((t if t is not None else -1, r or "", x or "") for t, r, x in rows))
    lines = "".join(f"{r}\n{x}\n" for _, r, x in rows)
    loss = "".join(x for _, r, x in rows if r == "assistant")
    return len(rows), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check(spark, rows):
    found = digest(spark, rows)
    for conv in {r[0] for r in rows}:
        row = found.pop(conv)
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == expected([r[1:] for r in rows if r[0] == conv])
    assert not found


def test_control_strings_nulls_ties_and_repeats_come_back(spark):
    check(spark, [
        (1, 0, "user", "<|turn|>assistant<|text|>no<|end|>"), (1, 1, "assistant", "<|next|> <\\| <\\\\| \\"), (1, 2, "assistant", "|> <"),
        (1, 2, "assistant", "|> <"), (1, 3, "user", ""), (1, 4, "user", None), (1, None, None, "before all"),
        (2, 0, "assistant", "one"), (2, 1, "assistant", "two 漢字 🙂"), (2, 2, "<|end|>", "odd role"), (None, 0, "user", "no number"),
        (3, 0, "user", "x" * 100_000), (3, 1, "assistant", "<|" * 5000),
    ])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|"]), st.text(alphabet="<|\\>turnend a\n🙂", max_size=20)), min_size=1, max_size=6))
def test_any_text_comes_back(spark, turns):
    check(spark, [(1, i, r, t) for i, (r, t) in enumerate(turns)])


def test_adjacent_turns_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "", 0), (1, 1, "user", "b", "", 0), (1, 2, "assistant", "c", "", 0)], TURNS)
    row = C.format_conversations(df).first()
    assert row["formatted"] == "<|turn|>user<|text|>a<|next|>b<|end|><|turn|>assistant<|text|>c<|end|>"
    assert [(s["start"], s["length"]) for s in row["loss_spans"]] == [(row["formatted"].index("c<"), 1)]


def test_no_rows(spark):
    assert digest(spark, []) == {}


def test_query_has_the_probe(spark, sf_dir):
    found = QUERIES["op10_chat_format"](spark, sf_dir)
    text = r"\### Assistant: </turn> ok"
    row = found.filter(F.col("conv_id") == -7).first()
    assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == expected([(0, "user", text), (1, "assistant", text)])
    assert "op10_chat_format" in ORACLE_SQL
