from lattica.llm import chat_perspectives as C


def test_every_participant_in_turn(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé"), (1, 3, "ann", "bye"), (2, 0, "system", "alone")]
    got = {(r.conv_id, r.perspective): r for r in C.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob")}
    ann = got[1, "ann"]
    assert ann.rendered == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nhé<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in ann.mask.split(",")]
    assert [ann.rendered[a:b] for a, b in spans] == ["hi", "bye"] and ann.n_turns == 4 and ann.n_trained == 2 and ann.trained_chars == 5
    bob = got[1, "bob"]
    a, b = map(int, bob.mask.split(":"))
    assert bob.rendered[a:b] == "hé" and "user name=ann" in bob.rendered


def test_awkward_turns(spark):
    rows = [(1, None, None, None), (1, 2, "b", ""), (1, 2, "b", ""), (None, 0, "x", "y"), (3, 0, "a", "w " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as perspective", "2 as own", "3 as head", "4 as no", "5 as _c")
    got = {(r.conv_id, r.perspective): r for r in C.perspectives(df).collect()}
    assert set(got) == {(1, "unknown"), (1, "b"), (None, "x"), (3, "a")}
    assert got[1, "b"].n_turns == 3 and got[1, "b"].n_trained == 2 and got[1, "b"].rendered.startswith("<|im_start|>user name=unknown\n<|im_end|>")
    assert got[3, "a"].trained_chars == 100_000
    assert C.perspectives(df.limit(0)).collect() == []
