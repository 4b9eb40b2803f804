import hashlib

from pyspark.sql import functions as F

from fieldweave.llm import chat

HARD = [
    (1, 0, "system", "be nice"),
    (1, 1, "user", "a <|turn|> b <\\|end|> [INST] <\\\\|x <</s>"),
    (1, 2, "user", None),
    (1, 3, "assistant", "one\ntwo <|end|>\n"),
    (1, 4, "assistant", "three <"),
    (1, 5, "user", "|end|>"),
    (2, None, None, ""),
    (2, 0, "assistant", "😀é"),
    (2, 0, "assistant", "😀é"),
    (2, 0, "a role\nof\\lines", "x"),
    (3, 1, "assistant", ""),
    (None, 0, "user", "no id"),
    (4, 0, "user", "</s>[INST] ok [/INST]"),
    (4, 1, "assistant", "</s>[INST] ok [/INST]"),
    (5, 0, "user", "y" * 100_000),
]


def expected(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def test_round_trip_and_mask(spark):
    df = spark.createDataFrame(HARD, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("messages", F.lit(1)).repartition(3)
    out = chat.format_conversations(df)
    got = out.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = expected(HARD)
    assert {r["conv_id"] for r in got} == set(want)
    for r in got:
        turns = want[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss"] == "".join(x for role, x in turns if role == "assistant")
        merged = []
        for role, x in turns:
            if merged and merged[-1][0] == role:
                merged[-1][1].append(x)
            else:
                merged.append((role, [x]))
        assert [(m["role"], list(m["texts"])) for m in r["messages"]] == merged
        assert r["formatted"].count("<|turn|>") == len(merged) and r["formatted"].count("</s>") == 0


def test_query_on_table(spark):
    from fieldweave.llm.queries import op2_chat_formatting

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = expected(rows)
    got = {r["conv_id"]: r for r in op2_chat_formatting(spark, sf).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    from fieldweave.llm.queries import op2_chat_formatting

    plan = op2_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_conversations(df).collect() == []
