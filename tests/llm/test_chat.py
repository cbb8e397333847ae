from collections import defaultdict

from optara.llm import chat


def brute(rows, part_turns):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t, (r if r is not None else "unknown").replace("<|", "< |"), (x or "").replace("<|", "< |")))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
        for me in {r for _, r, _ in turns if r != "system"}:
            whole, parts = 0, {}
            for at, (_, r, x) in enumerate(turns):
                p = at // part_turns
                text, mask = parts.setdefault(p, ["", [], 0, whole])[:2]
                head = "assistant" if r == me else r if r == "system" else f"user name={r}"
                opened = f"<|im_start|>{head}\n"
                shown = f"{opened}{x}<|im_end|>\n"
                if r == me:
                    mask.append(f"{len(text) + len(opened)}:{len(text) + len(shown) - 1}")
                parts[p][0] += shown
                parts[p][2] += 1
                whole += len(shown)
            out += [(c, me, p, at, n, len(mask), text, ",".join(mask)) for p, (text, mask, n, at) in parts.items()]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    for n in (256, 2):
        assert result(chat.perspectives(df, part_turns=n)) == brute(rows, n)


def test_awkward_rows(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "bob", None), (1, 1, "bob", None), (1, None, None, "x"), (1, 300, "system", "late"), (None, 0, "a", ""), (2, 0, "system", "alone"), (3, 1, "é<|", "日本"), (3, 0, "user", "y" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "p", "s") for r in rows], "conv_id long, turn long, role string, text string, part int, speaker string, name string")
    assert result(chat.perspectives(df)) == brute(rows, 256)
    assert chat.perspectives(df.limit(0)).count() == 0
    assert not any(r["conv_id"] == 2 for r in chat.perspectives(df).collect())


def test_turns_without_numbers_come_in_parts(spark):
    rows = [(1, None, "ab"[i % 2], f"said {i:04d}") for i in range(600)] + [(1, 7, "a", f"again {i:03d}") for i in range(300)]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    assert result(got) == brute(rows, 256) and max(r["n_turns"] for r in got.collect()) == 256


def test_main_path_is_native(spark, sf_dir):
    df = chat.perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "MapIn"))
