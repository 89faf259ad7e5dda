import hashlib

from pyspark.sql import functions as F

from refgraph.llm.chat_format import CONTROL, END, TURN, escape, flatten_parts, format_chats, format_turns, read_back, text_parts, unescape
from refgraph.llm.queries import SPOOFED, op12_chat_format

NASTY = [*CONTROL, SPOOFED, "".join(CONTROL), "[\\INST]", "<\\\\|end|>", "<<|turn|>", "\\", "\\n", "<\\|image|>\n", "a\nb", "![x](y.png) and ![](z.MP3)![q](r)", "[![a](b.gif)INST]", "é😀 <|end|>\n", "![not] (one)", "", None, " ", "x" * 300_000 + "</s>"]
SCHEMA = "conv_id long, turn long, role string, text string, place string, c string, `a.b` string"


def rows(spark):
    made = [(1, k, r, t) for k, t in enumerate(NASTY) for r in ("user", "assistant")] + [(2, None, r, "same") for r in NASTY[:-1]]
    made += [(3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"), (None, 1, "user", "nobody's"), (None, 0, "assistant", "first")]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in made], SCHEMA), made


def test_escapes(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == r.t
        assert not any(c in (r.e or "") for c in CONTROL)


def test_round_trip(spark):
    df, made = rows(spark)
    chats = format_chats(format_turns(df))
    got = {r.conv_id: r for r in read_back(chats).collect()}
    by = {}
    for c, t, role, text in made:
        by.setdefault(c, []).append((t, role or "", text or ""))
    for c, turns in by.items():
        read = [(t.role, t.text) for t in got[c].turns]
        if c == 1:
            assert read[0::2] == [("assistant", t or "") for t in NASTY] and read[1::2] == [("user", t or "") for t in NASTY]
        assert sorted(read) == sorted((r, x) for _, r, x in turns)
        assert got[c].learned == "".join(x for r, x in read if r == "assistant")
        assert got[c].formatted.count(TURN) == got[c].formatted.count(END) == len(turns)
    for r in chats.collect():  # spans count code points
        for t in r.turns:
            at = t.start + t.loss_start
            assert r.formatted[t.start :].startswith(TURN) and (not t.loss_length or r.formatted[at + t.loss_length :].startswith(END))


def test_parts(spark):
    df = spark.createDataFrame([(1, [("text", "see <s>", None), ("image", "cat.png", 3), ("audio", "hum.wav", None), ("document", "law.pdf", 2), ("text", None, None), ("other", "end", None), None]), (2, None), (3, [])], "id int, p array<struct<kind: string, value: string, units: bigint>>")
    got = {r.id: r.f for r in df.select("id", flatten_parts(F.col("p")).alias("f")).collect()}
    assert got[1].content == "see <\\s><|image|><|audio|><|document|>end"
    assert [tuple(a) for a in got[1].attachments] == [("image", "cat.png", 768), ("audio", "hum.wav", 25), ("document", "law.pdf", 1024)]
    assert got[2].content == got[3].content == "" and got[2].attachments == got[3].attachments == []
    found = spark.createDataFrame([("a ![x](y.png)b![](z.mp3)![q](r)",)], "t string").select(text_parts(F.col("t")).alias("p")).first().p
    assert [(x.kind, x.value) for x in found] == [("text", "a "), ("image", "![x](y.png)"), ("text", "b"), ("audio", "![](z.mp3)"), ("text", ""), ("document", "![q](r)"), ("text", "")]


def test_typed_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", [("text", "look", None), ("image", "cat.png", 2), ("text", "[INST]", None)])], "conv_id long, turn long, role string, p array<struct<kind: string, value: string, units: bigint>>").withColumn("text", F.lit("unused"))
    turns = format_turns(df, parts=F.col("p"))
    r = read_back(format_chats(turns)).first()
    assert r.formatted == f"{TURN}assistant\nlook<|image|>[\\INST]{END}\n" and r.learned == "lookcat.png[INST]"


def test_empty(spark):
    df, _ = rows(spark)
    assert read_back(format_chats(format_turns(df.limit(0)))).count() == 0


def test_spoofed_conversation(spark):
    r = op12_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    told = f"user\n{SPOOFED}\nassistant\n{SPOOFED}\n"
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (2, hashlib.sha256(told.encode()).hexdigest(), len(SPOOFED), hashlib.sha256(SPOOFED.encode()).hexdigest())


def test_native(spark):
    plan = op12_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # windows and gathering share it
