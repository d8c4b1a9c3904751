import random

from pyspark.sql import functions as F

from ashlar.llm import chat


def test_round_trip_of_hostile_conversations(spark):
    random.seed(9)
    bits = ["</s>", "<s> ", "[INST] ", " [/INST]", "<<SYS>> ", " <</SYS>>", "<|role|> ", " <|text|> ", " <|end|>", "\\", "\\B", "\\L", "\\A", "<", "[", "a", " ", "\n", "é😀", ""]
    rows, want = [], {}
    for c in range(150):
        turns = [(t, random.choice(["user", "assistant", "system", "tool", "", " <|text|> ", "[INST] "]), "".join(random.choice(bits) for _ in range(random.randint(0, 6)))) for t in range(random.randint(1, 6))]
        want[c] = [(r, t) for _, r, t in turns]
        rows += [(c, t, r, x, "extra") for t, r, x in turns]
    rows += [(500, 0, "user", None, ""), (500, 1, None, "x", ""), (501, 0, "assistant", "z" * 3_000_000 + " </s>", "")]
    want |= {500: [("user", ""), ("", "x")], 501: [("assistant", "z" * 3_000_000 + " </s>")]}
    random.shuffle(rows)
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    got = got.withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
    assert {r.escape_level for r in got} >= {0, 1}


def test_the_mask_of_long_conversations(spark):
    sizes = {1: 1, 2: 255, 3: 256, 4: 257, 5: 3000}
    rows = [(c, t, ("user", "assistant", "system", "tool")[t * 7 % 4], "é< x"[: t % 5] + str(t)) for c, n in sizes.items() for t in range(n)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = got.withColumn("cut", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).withColumn("read", chat.assistants_text(F.col("turns"))).collect()
    for r in got:
        want = [text for c, _, role, text in rows if c == r.conv_id and role == "assistant"]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_mask]
        assert [s.replace("\\A", "<") for s in spans] == want and r.cut == r.read == "".join(want)
    assert len(got) == len(sizes)
    assert spark.createDataFrame([("",)], "f string").select(chat.loss_mask(F.col("f")).alias("m")).first().m == []


def test_plain_text_is_not_escaped(spark):
    got = chat.format_chats(spark.createDataFrame([(1, 0, "user", "a < b [1]"), (1, 1, "assistant", "ok \\n")], "conv_id long, turn long, role string, text string")).first()
    assert got.formatted == "[INST] a < b [1] [/INST]<s> ok \\n </s>" and got.escape_level == 0


def test_ties_repeats_and_null_ids(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a"), (None, None, "user", "c")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 1 and [t.text for t in got[0].turns] == ["c", "a", "a", "b"]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_the_query_takes_its_loss_from_the_mask(spark, sf_dir, monkeypatch):
    from ashlar.llm import queries

    whole = {r.conv_id: r.loss_chars for r in queries.op4_chat_formatting(spark, sf_dir).collect()}
    first, mask = lambda spans: F.slice(spans, 1, 1), chat.loss_mask
    monkeypatch.setattr(chat, "loss_mask", lambda formatted: first(mask(formatted)))
    cut = {r.conv_id: r.loss_chars for r in queries.op4_chat_formatting(spark, sf_dir).collect()}
    assert whole.keys() == cut.keys() and all(cut[c] <= whole[c] for c in cut) and cut != whole
