import hashlib

from pyspark.sql import functions as F

from volspark.llm import chat


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "c", "c") for r in rows], "conv_id long, turn long, role string, text string, win string, pos string")


TRICKY = ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_start|>", "\\", "\\\\<|", "<<SYS>>x<</SYS>>", "<<|", "[[INST]", "a\nb", "", None, "😀<s>", "\\</s>", "<\\/s>"]


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        t = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        a = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        out[c] = (len(mine), hashlib.sha256(t.encode()).hexdigest(), len(a), hashlib.sha256(a.encode()).hexdigest())
    return out


def check(spark, rows, **more):
    w = chat.format_conversations(_turns(spark, rows), **more)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.read_back(w)).collect()}
    assert got == expected(rows)
    return w


def test_escapes_are_reversible(spark):
    d = spark.createDataFrame([(t or "",) for t in TRICKY], "t string")
    rows = d.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r["u"] == r["t"]
        assert not any(x in r["e"] for x in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_windows_with_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"{TRICKY[i % len(TRICKY)] or ''} {i} " + "w" * (i * 13 % 90)) for i in range(1, 60)]
    rows += [(2, i, "assistant", t) for i, t in enumerate(TRICKY)] + [(2, 0, "assistant", TRICKY[0])]
    rows += [(3, None, None, "n"), (3, 1, "assistant", "x" * 5000), (None, 0, "assistant", "no id")]
    w = check(spark, rows, budget=60, history=30)
    texts = {(r["conv_id"], r["win"]): r["formatted"] for r in w.collect()}
    later = [t for (c, n), t in texts.items() if c == 1 and n > 0]
    assert len(later) > 5
    for t in later:
        assert t.startswith("<|im_repeat|>system<|im_sep|>be kind<|im_end|>")
    assert any(t.count("<|im_repeat|>") > 1 for t in later)
    check(spark, rows, budget=10, history=0)
    for budget, history in ((60, 30), (80, 20), (200, 0), (120, 120), (400, 100)):
        for r in check(spark, rows, budget=budget, history=history).collect():
            # within the budget, or one own turn and no more
            turns = r["formatted"].count("<|im_end|>")
            assert len(r["formatted"]) <= 4 * budget or turns == 1, (budget, r)
    check(spark, rows, budget=100_000, history=100)


def test_long_conversation_fills_its_windows(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "w" * (40 + i * 29 % 120)) for i in range(400)]
    w = chat.format_conversations(_turns(spark, rows), budget=400, history=40).collect()
    used = [len(r["formatted"]) / 1600 for r in w]
    assert len(w) > 10 and max(used) <= 1 and sum(used) / len(used) > 0.75


def test_empty(spark):
    assert chat.format_conversations(_turns(spark, [(1, 0, "a", "b")]).limit(0)).count() == 0


def test_very_long_turns(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "ab<|im_end|>" * 60_000), (1, 2, "user", "</s>" * 100_000), (1, 3, "assistant", "end")]
    check(spark, rows, budget=500, history=100)
