import random
import re

from hearthline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    """The counted values, said plainly."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_match_plain_python(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "a b c", "a b c a b c", "x x x x", "x x x", "ä#ö |é|\x0b\x1f b\r\nline\nline\n\n \nline", "\n a b\n a b\na b"]
    texts += ["".join(rng.choice(["a ", "b ", "c ", "dd\n", "é#\t", " "]) for _ in range(rng.randrange(150))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    rows = quality.features(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]
        assert got == counts(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_estimation_finds_planted_accuracies():
    rng = random.Random(2)
    truth = [0.95, 0.9, 0.85, 0.75]
    patterns = {}
    for _ in range(40_000):
        good = rng.random() < 0.5
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in truth)
        patterns[votes] = patterns.get(votes, 0) + 1
    found = quality.estimate(list(patterns.items()), 4)
    assert all(abs(a - b) < 0.03 for a, b in zip(truth, found))
    assert quality.posterior((1, 1, 1, 1), found) > 0.95 > 0.05 > quality.posterior((-1, -1, -1, -1), found)


def test_a_rule_alone_keeps_its_start_value():
    assert abs(quality.estimate([((-1, 0), 9), ((0, 1), 90)], 2)[0] - quality.ACCURACY) < 1e-9


def test_posterior_is_the_column(spark):
    text = "This is a plain sentence of words that nobody repeats in any other place of it. "
    texts = [text + " ".join(f"word{i}x{k}" for k in range(90)) for i in range(40)]
    junk = [" ".join(f"A{i}B{k}##" for k in range(70)) for i in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + junk)], "doc_id long, text string")
    rows = sorted(quality.judge(df).collect())
    assert all(r["kept"] for r in rows[:40]) and not any(r["kept"] for r in rows[40:])
    accuracy = quality.learn(quality.features(df))
    votes = quality.features(df).select("doc_id", *[quality.vote(r).alias(r.name) for r in quality.RULES]).collect()
    by_id = {r[0]: quality.posterior(tuple(r[1:]), accuracy) for r in votes}
    assert all(abs(by_id[r["doc_id"]] - r["quality"]) < 1e-9 for r in rows)


def test_empty_table_and_repeats(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = quality.judge(spark.createDataFrame([(None, None), (1, "x"), (1, "x")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and all(r["base_failed"] and r["kept"] is False for r in rows)
