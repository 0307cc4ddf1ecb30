import random
import zlib

import pytest

from hearthline.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_what_all_comparisons_find():
    rng = random.Random(1)
    terms = [("idiot", True), ("worthless", True), ("scum", True), ("disgusting", True), ("lostra", False), ("vequ", False), ("abcdefgh", False), ("idiom", True)]
    lexicon = tox.Lexicon(terms)
    letters = "abcdeghiloqrstuvw"
    for _ in range(6000):
        word = rng.choice(terms)[0] + rng.choice(["", "", "x", "ing"])
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(word) + 1)
            word = rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i + 1 :]])
        best = []
        for i, (term, whole) in enumerate(terms):
            e = distance(word, term) if whole else min(distance(word[:k], term) for k in range(len(word) + 1))
            if e <= tox.edits(term, whole):
                best.append((e, -len(term), i))
        want = (min(best)[2], min(best)[0]) if best and word else None
        assert lexicon.match(word) == want, word


def test_context_tells_quotation_from_abuse():
    words = lambda s: tox.tokens(s)
    assert tox.context(words("they said that idiot left"), 3) == tox.QUOTED
    assert tox.context(words('the sign "an idiot here" was old'), 3) == tox.QUOTED
    assert tox.context(words("you utter idiot go"), 2) == tox.ADDRESSED
    assert tox.context(words("what an idiot of them"), 2) == 1.0


def corpus(rng, n):
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice("anen the thoin over whri ofand renti leone stira mout".split()) + str(rng.randrange(40)) for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = rng.choice(["idiot", "worthless", "lostraxa", "lostrabe", "lostrage"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_learns_terms_and_scores_held_out_rows(spark):
    rows = corpus(random.Random(3), 900)
    df = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = tox.learn(df, labels)
    assert {"idiot", "worthless", "lostra"} <= {t[:9] for t, _ in model.lexicon.terms} | {t[:6] for t, _ in model.lexicon.terms}
    out = {r["doc_id"]: r["score"] for r in tox.with_score(df, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {r["doc_id"] for r in df.where(tox.held_out("doc_id")).collect()} == set(held)
    assert sum((out[i] >= 0.7) == bool(rows[i][2]) for i in held) / len(held) > 0.99
    odd = [(1, None), (2, ""), (3, "what a wortless thoin"), (4, "the and " * 60_000 + "idiot"), (None, "idiot")]
    scores = {r["doc_id"]: r["score"] for r in tox.with_score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert scores[1] == scores[2] < 0.3 and scores[4] > 0.7 and scores[None] > 0.7 and scores[3] > scores[1]


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus(random.Random(4), 300)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, b: 1 - b if zlib.crc32(str(i).encode()) % 3 == 1 else b
    a = tox.learn(df, spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int"))
    b = tox.learn(df, spark.createDataFrame([(i, flip(i, b)) for i, _, b in rows], "doc_id long, toxic int"))
    assert a.lexicon.terms == b.lexicon.terms and a.weights == pytest.approx(b.weights)


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    model = tox.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] < 0.5 for r in tox.with_score(df, model).collect()] == [True, True]
    assert tox.with_score(df.limit(0), model).count() == 0
