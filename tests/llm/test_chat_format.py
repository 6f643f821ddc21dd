from pyspark.sql import functions as F

from strandlake.llm.chat_format import preference_format, preference_pairs

TURNS = "conv_id long, turn long, role string, text string"


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def mask(turns):
    at, out = 0, []
    for r, t in turns:
        start = at + len(f"<|{r}|>\n")
        at = start + len(t) + len("<|end|>\n")
        if r == "assistant":
            out.append(f"{start}:{at}")
    return ",".join(out)


def test_pairs_against_python(spark):
    convs = {
        0: [("user", "hi"), ("assistant", "good é日"), ("user", "more"), ("assistant", "yes")],
        1: [("user", "hi"), ("assistant", "good é日"), ("user", "more"), ("assistant", "no")],
        2: [("user", "a")],
        3: [("user", "b"), ("assistant", "")],
        4: [("user", "alone"), ("assistant", "x")],
        6: [("user", "s"), ("assistant", "t")],
        7: [("user", "s"), ("assistant", "t")],
        8: [("user", "s"), ("assistant", "t")],
        9: [("user", "s"), ("assistant", "t"), ("user", "longer"), ("assistant", "z")],
    }
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    out = {r.pair_id: r for r in preference_pairs(spark.createDataFrame(rows[::-1], TURNS)).collect()}
    assert set(out) == {0, 1, 2, 3, 4}
    for p, r in out.items():
        a, b = convs.get(2 * p), convs.get(2 * p + 1)
        n = 0
        while a and b and n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert r.n_prompt_turns == n and r.prompt == render((a or [])[:n])
        for side, done, masked in ((a, r.chosen_completion, r.chosen_mask), (b, r.rejected_completion, r.rejected_mask)):
            assert done == (None if side is None else render(side[n:]))
            assert masked == (None if side is None else mask(side[n:]))


def test_nulls_ties_and_empty(spark):
    rows = [(0, None, None, None), (0, 1, "assistant", "x"), (0, 1, "assistant", "x"), (None, 0, "user", "lost"), (1, 0, "user", None)]
    out = {r.pair_id: r for r in preference_pairs(spark.createDataFrame(rows, TURNS)).collect()}
    assert out[0].n_prompt_turns == 1 and out[0].prompt == render([("user", "")])
    assert out[0].chosen_completion == render([("assistant", "x")] * 2) and out[0].rejected_completion == ""
    assert out[None].chosen_completion == render([("user", "lost")])
    assert preference_pairs(spark.createDataFrame([], TURNS)).count() == 0


def test_clashing_columns(spark):
    turn = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([([("user", "q")], [("user", "q")], "old")], f"chosen {turn}, rejected {turn}, prompt string")
    assert preference_format(df).select("prompt").first()[0] == render([("user", "q")])


def test_hot_first_turn_stays_linear(spark):
    rows = spark.range(2000).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    assert preference_pairs(rows).count() == 1000
