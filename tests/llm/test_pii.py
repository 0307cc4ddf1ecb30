import random
import re

import numpy as np

from hearthline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PLAIN = (
    EMAIL,
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain(text):
    """The patterns as they are written, all matches by the plain engine."""
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            good = True
            if kind == 1:
                good = all(int(p) <= 255 for p in m[0].split("."))
            if kind == 2:
                good = 12 <= len(digits) <= 19 and pii.luhn(digits)
            if kind == 3:
                good = 9 <= len(digits) <= 15
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(4)
    pieces = ["4111 1111 1111 1111", "4111111111111111", "a.b@c.d-e.fg", "@", ".", "1.2.3.4", "256.1.1.1", "+1 (705) 555-6638", "00012.1.1.001", " ", "x", "-", "5", "é", "+", "@a.b", "(", "9 9"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == plain(text), text


def test_base_spans_are_linear_in_odd_texts():
    for text in ("a" * 400_000, "1" * 400_000, "+1" + "(" * 400_000, "1." * 200_000, "a@" * 200_000, "@" * 400_000):
        pii.base_spans(text)


def test_gradients_are_those_of_the_loss():
    net = pii.Network.fresh(1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    codes = pii.encode(["call +1 (705) 555-6638 now", "x@y.com is 1.2.3.4"])
    tags = np.zeros((2, pii.WINDOW), np.int64)
    tags[0, 5:22], tags[0, 5], tags[1, :7], tags[1, 0] = 8, 7, 2, 1
    _, grads = net.loss(codes, tags)
    for k, at in {"move": (0, 0), "out_w": (3, 2), "f_w": (1, 7), "b_w": (20, 40), "f_b": (30,), "embed": (int(codes[0, 6]), 2)}.items():
        kept = net.weights[k][at]
        net.weights[k][at] = kept + 1e-4
        above = net.loss(codes, tags)[0]
        net.weights[k][at] = kept - 1e-4
        below = net.loss(codes, tags)[0]
        net.weights[k][at] = kept
        assert abs((above - below) / 2e-4 - grads[k][at]) < 1e-3, k


def test_windows_hold_every_digit_twice():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("abc 1@") if rng.random() < 0.05 else "x" for _ in range(rng.randrange(700)))
        starts = pii.window_starts(text)
        assert starts == sorted(set(starts))
        for m in pii.TRIGGER.finditer(text):
            held = sum(s <= m.start() < s + pii.WINDOW for s in starts)
            assert held == (1 if m.start() < pii.STRIDE else 2)


def test_reconcile_takes_the_best_disjoint_spans():
    found = [(0, 3, 30, 0.9), (0, 3, 17, 0.95), (0, 3, 17, 0.95), (18, 1, 30, 0.9), (18, 1, 30, 0.9), (25, 1, 28, 0.99)]
    assert pii.reconcile(found) == [(0, 3, 17), (18, 1, 30)]
    assert pii.reconcile([]) == []


def make(rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.randrange(6)
    body = (
        f"n{digits(2)}.{digits(2)}@mail{digits(1)}.example.com",
        ".".join(str(rng.randrange(256)) for _ in range(4)),
        "4" + digits(15),
        f"+1 ({rng.randrange(200, 999)}) 555-{digits(4)}",
        f"password={digits(5)}ab{digits(3)}",
        f"in {digits(4)}",
    )[kind]
    words = lambda: " ".join(rng.choice(["the", "of", "over", "and", "un"]) for _ in range(rng.randrange(2, 9)))
    return f"{words()} {body} {words()}."


def test_network_learns_and_adds_what_a_pattern_lost(spark):
    rng = random.Random(8)
    texts = [make(rng) for _ in range(900)]
    net = pii.train(texts[:700], [pii.base_spans(t) for t in texts[:700]], rounds=160)
    right = wrong = missed = 0
    tags, sure = net.decode(pii.encode(texts[700:]))
    for t, row, p in zip(texts[700:], tags, sure):
        got, want = {s[:3] for s in pii.window_spans(row, p)}, {s for s in pii.base_spans(t) if s[1] != 2}
        got = {s for s in got if s[1] != 2}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9
    lost = "the of over +1 (705) 555-6638 10.20.30.40 and the of."
    rows = [(1, lost, "a"), (2, None, "b"), (2, "", "c"), (3, "x" * 3000 + " " + texts[0] + "y" * 3000, "d"), (None, lost, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    out = {r["doc_id"]: r for r in pii.with_spans(df, net=net).collect()}
    assert [(s["kind"], s["base"]) for s in out[1]["pii"]] in ([("phone", False), ("ip", True)], [("ip", True)])
    assert out[2]["pii"] == [] and out[None]["pii"] == out[1]["pii"]
    for r in out.values():
        assert [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in r["pii"] if s["base"]] == plain(r["text"] or "")
    hidden = {r["doc_id"]: r["text"] for r in pii.masked(pii.with_spans(df, net=net)).collect()}
    assert "10.20.30.40" not in hidden[1] and "[IP]" in hidden[1] and hidden[2] in (None, "")


def test_learning_from_a_table(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, make(rng)) for i in range(300)] + [(-1, None)], "doc_id long, text string")
    assert pii.labelled_windows(df, limit=50).count() == 50
    assert pii.with_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hidden_equals_masked_spans(spark):
    texts = ["write a.b@c.org or +49 (30) 1234-5678 now", None, "", "10.0.0.1 10.0.0.1", "no data", "no data"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    net = pii.Network.fresh()
    one = {r["doc_id"]: r["text"] for r in pii.hidden(docs, net=net).collect()}
    two = {r["doc_id"]: r["text"] for r in pii.masked(pii.with_spans(docs, net=net)).collect()}
    assert one == two and one[1] is None and one[2] == "" and "[EMAIL]" in one[0] and "[IP]" in one[3]
