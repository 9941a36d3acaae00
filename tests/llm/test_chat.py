"""Chat examples against a plain loop, on long conversations, ties and repeats."""

import random

from larder.llm import chat_format

SCHEMA = "conv_id bigint, turn bigint, role string, text string, context string, train_start int, repeat boolean"


def brute(rows):
    out = {}
    by = {}
    for c, t, r, x in rows:
        if None not in (c, t, r, x):
            by.setdefault(c, set()).add((t, r.strip(" ").lower(), x.replace("<|", "< |")))
    for c, turns in by.items():
        context, n = "", 0
        for t, r, x in sorted(turns):
            if r == "assistant" and x:
                head = context + "<|assistant|>\n"
                out.setdefault((c, t), []).append((n, head, x + "<|end|>\n", head + x + "<|end|>\n", len(head), len(head) + len(x) + 8))
            context += f"<|{r.replace('<|', '< |')}|>\n{x}<|end|>\n"
            n += 1
    return {k: sorted(v) for k, v in out.items()}


def got(spark, rows):
    out = {}
    for r in chat_format.examples(spark.createDataFrame([(*x, "c", 1, True) for x in rows], SCHEMA)).collect():
        out.setdefault((r["conv_id"], r["turn"]), []).append((r["n_context"], r["context"], r["reply"], r["example"], r["train_start"], r["train_stop"]))
    return {k: sorted(v) for k, v in out.items()}


def test_against_a_plain_loop(spark):
    r = random.Random(3)
    pick = lambda *x: r.choice(x)
    rows = [(r.randrange(12), r.randrange(9), pick("user", "Assistant ", "system", "assistant", "to<|ol"), pick("a", "b <|x|>", "", "é" * 40, "long " * 500)) for _ in range(400)]
    rows += rows[:100]  # rows over again
    rows += [(None, 1, "user", "x"), (1, None, "user", "x"), (1, 1, None, "x"), (1, 1, "user", None)]
    assert got(spark, rows) == brute(rows)


def test_a_long_conversation_and_one_that_is_most_rows(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "w" * 50) for k in range(600)] + [(2 + k, 0, "assistant", "hi") for k in range(50)]
    mine, want = got(spark, rows), brute(rows)
    assert mine == want and max(n for v in mine.values() for n, *_ in v) == 598


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "x" * 2_000_000), (1, 1, "assistant", "y" * 1_000_000)]
    (made,) = got(spark, rows)[1, 1]
    assert made[5] - made[4] == 1_000_000 + 8
