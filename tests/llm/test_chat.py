import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnlake.llm import chat

ROWS = "conv_id long, turn long, role string, text string"
ODD = ["<|im_end|>\n", "<|im_start|>", "\\", "<|", "<\\|", "\\\\", "|>", "<", "|", "\n", "é", "😀", "a", "<|im_sep|>", "<|image|>"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def formatted(spark, rows):
    return chat.format_chats(spark.createDataFrame(rows, ROWS).withColumn("parts", chat.text_part(F.col("text"))))


def expected(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", (r[3] or "").replace("\\", "\\\\").replace("<|", "<\\|"))):
        out.setdefault(c, []).append((r or "", x or ""))
    return {c: (len(m), sha("".join(f"{r}\n{x}\n" for r, x in m)), sum(len(x) for r, x in m if r == "assistant"), sha("".join(x for r, x in m if r == "assistant"))) for c, m in out.items()}


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(df).collect()}


def test_control_strings_nulls_ties_and_repeats_come_back(spark):
    rows = [(1, 0, "user", "".join(ODD)), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<|im_end|>"), (1, None, None, None), (2, 0, "a<|im_sep|>b\n", ""), (None, 3, "assistant", "x\\"), (None, 3, "assistant", "x\\"), (4, 0, "assistant", "long <| " * 5000)]
    assert got(formatted(spark, rows)) == expected(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "<|"]), st.lists(st.sampled_from(ODD), max_size=8).map("".join)), min_size=1, max_size=20))
def test_any_text_comes_back(spark, rows):
    assert got(formatted(spark, rows)) == expected(rows)


def test_no_text_holds_a_control_string(spark):
    df = formatted(spark, [(1, 0, "user", "<|im_end|>\n<|im_start|>x"), (1, 1, "assistant", "y")])
    s = df.first()["formatted"]
    assert s.count(chat.START) == 2 and s.count(chat.END) == 2
    mask = [m for m in df.first()["mask"] if m["trained"]]
    assert [s[m["content"] : m["end"]] for m in mask] == ["y"]


def test_typed_parts_become_placeholders_in_order(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "s3://a.png", 4), ("audio", "ignored", "b.wav", 10), ("text", "and", None, None), ("document", None, "c.pdf", None), ("other", "kept", None, None), (None, "too", None, None)]
    schema = f"conv_id long, turn long, role string, parts {chat.PARTS}"
    df = chat.format_chats(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], schema))
    r = df.first()
    assert r["formatted"].startswith("<|im_start|>user<|im_sep|>see <\\|image|> <|image|><|audio|>and<|document|>kepttoo<|im_end|>\n")
    assert [(f["part"], f["type"], f["ref"], f["tokens"]) for f in r["attachments"]] == [(1, "image", "s3://a.png", 1024), (2, "audio", "b.wav", 250), (4, "document", "c.pdf", 512)]
    assert r["attachment_tokens"] == 1786


def test_empty_table_and_other_columns(spark):
    assert formatted(spark, []).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "t", "p", 9)], ROWS + ", at string, formatted int").withColumn("parts", chat.text_part(F.col("text")))
    assert chat.digest(chat.format_chats(odd)).first()["n_turns"] == 1
