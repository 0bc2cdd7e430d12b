import hashlib

from wayflux.llm import chat

HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>[user]\nhi</s>\n", "", None, "[", "]\n", "a\\<b", "plain é 🙂"]


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "q") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, span int, loss string")


def check(spark, rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    wins = chat.windows(frame(spark, rows), window=60, history=20)
    got = {r.conv_id: r for r in chat.read_back(wins).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return wins.collect()


def test_everything_reads_back(spark):
    rows = [(c, i, ("system", "user", "assistant")[min(i, 1 + i % 2)], HARD[(c + i) % len(HARD)]) for c in range(8) for i in range(9)]
    rows += [(50, 0, "system", "only"), (51, 0, None, None), (None, 0, "user", "lost"), (None, None, "assistant", "found"), (52, 1, "assistant", "twice"), (52, 1, "assistant", "twice")]
    check(spark, rows)


def test_windows_keep_to_the_budget(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "x" * (i % 30)) for i in range(1, 3000)]
    wins = check(spark, rows)
    assert len(wins) > 100
    for w in wins:
        turns = chat.parse(w.formatted)
        assert turns[0] == ("system", "be brief")
        assert sum(-(-len(f"<s>[{r}]\n{x}</s>\n") // 4) for r, x in turns) <= 60
    assert any(w.n_context > 1 for w in wins)


def test_empty(spark):
    assert chat.read_back(chat.windows(frame(spark, [(1, 1, "a", "b")]).filter("false"))).count() == 0
