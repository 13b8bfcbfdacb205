from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quantsieve.llm import chat_format as c

NASTY = ["", "plain", "\\", "<", "\\l", "\\b<", "</turn>\n", "<turn>assistant\n", "a\nb", "\\\\l<l", "é≠\U0001f600<", "<image:1>", None]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_round_trip_and_mask(spark):
    rows = [(i, t, role, x) for i, x in enumerate(NASTY) for t, role in enumerate(("user", "assistant", "user", "assistant"))]
    df = c.format_conversations(turns(spark, rows).repartition(5))
    got = df.select("conv_id", c.read_back(F.col("formatted")).alias("turns"), c.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    assert len(got) == len(NASTY)
    for r in got:
        x = NASTY[r["conv_id"]] or ""
        assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", x), ("assistant", x)] * 2
        assert r["loss"] == x + x


def test_digest(spark):
    r = c.digest(c.format_conversations(turns(spark, [(1, 1, "assistant", "<b>"), (1, 0, "user", "q")]))).first()
    assert r["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\n<b>\n").hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, 3, hashlib.sha256(b"<b>").hexdigest())
    assert r["formatted_chars"] == len("<turn>user\nq</turn>\n<turn>assistant\n\\lb></turn>\n")


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (5, 0, "a<b\\", "t"), (5, 0, "a<b\\", "t"), (7, 0, "a\nb\\n\\\n", "x" * 200_000), (6, 2, "user", "late"), (6, None, "user", "first")]
    got = {r["conv_id"]: r for r in c.format_conversations(turns(spark, rows).withColumn("formatted", F.lit(1)).withColumn("ts", F.lit(2))).withColumn("back", c.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[None]["back"]] == [("", ""), ("assistant", "x")]
    assert [tuple(t) for t in got[5]["back"]] == [("a<b\\", "t")] * 2
    assert [t["text"] for t in got[6]["back"]] == ["first", "late"]
    assert [tuple(t) for t in got[7]["back"]] == [("a\nb\\n\\\n", "x" * 200_000)]
    assert c.digest(c.format_conversations(turns(spark, []))).count() == 0


def test_many_turns(spark):
    n = 1500
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(n)]
    r = c.format_conversations(turns(spark, rows)).withColumn("loss", c.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert r["n_turns"] == n and r["loss"] == "".join(f"t{i}" for i in range(1, n, 2))


def test_typed_parts(spark):
    df = spark.sql("""select 1L as conv_id, 0L as turn, 'user' as role, array(
        named_struct('type', 'text', 'text', 'see <this> ', 'ref', cast(null as string), 'units', cast(null as int)),
        named_struct('type', 'image', 'text', null, 'ref', 's3://a.png', 'units', 2),
        named_struct('type', 'document', 'text', null, 'ref', 'b.pdf', 'units', 3),
        named_struct('type', 'image', 'text', null, 'ref', 'c.png', 'units', null)) as parts
        union all select 1L, 1L, 'assistant', cast(null as array<struct<type:string,text:string,ref:string,units:int>>)""")
    r = c.format_conversations(df.withColumn("text", F.lit(None).cast("string")), F.col("parts")).first()
    assert "see \\lthis> <image:1><document:1><image:2></turn>" in r["formatted"]
    assert [(a["slot"], a["ref"]) for a in r["attachments"]] == [("<image:1>", "s3://a.png"), ("<document:1>", "b.pdf"), ("<image:2>", "c.png")]
    assert r["expanded_tokens"] == 3 * c.PART_TOKENS["image"] + 3 * c.PART_TOKENS["document"]


def test_native(spark):
    plan = c.digest(c.format_conversations(turns(spark, [(1, 0, "user", "x")]).where("turn >= 0")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
