import hashlib
import random
import re

from hearthline.llm import fim
from pyspark.sql import functions as F

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    u, v = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:u]), "".join(units[u:v]), "".join(units[v:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(4)
    out = [None, "", " ", "a", "é", "😀x😀", "a<P>b", "x<M", "<S", "<<P", "P>", "one <S> two", "\x00\n\tÅngström KK"]
    out += ["".join(rng.choice("abZ é😀<PSM>\n.") for _ in range(rng.randrange(200))) for _ in range(150)]
    out += ["w" * 100_000, " ".join("abc" for _ in range(60_000)), "." * 50_000]
    return out


def test_every_rank_is_reached_exactly():
    for text in texts()[1:60] + ["ab. " * 700]:
        units = UNIT.findall(text)
        skip, at = fim.SkipList(text), 0
        assert skip.units == len(units) and skip.points == len(text)
        for rank, unit in enumerate(units):
            assert skip.seek(rank) == at
            at += len(unit)
        assert skip.seek(len(units)) == len(text)


def test_a_search_takes_few_links():
    skip = fim.SkipList("." * 200_000)
    assert len(skip.lanes) >= 4
    # Every lane is a part of the lane below and their widths sum to the same.
    for units, points in skip.lanes:
        assert units.sum() == 200_000 and points.sum() == 200_000
    taken = 0
    for lane, (units, _) in enumerate(skip.lanes[:-1]):
        taken = max(taken, max(len(x) for x in [units]) / max(1, len(skip.lanes[lane + 1][0])))
    assert taken < 16


def test_rows_match_brute_force_and_restore(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())]
    rows += [rows[30], rows[30], (None, rows[40][1], "x", "y"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, _h1 string").repartition(5)
    out = fim.transform(df)
    out = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = sorted((r["doc_id"] or -1, r["n"], r["form"], r["prefix_chars"] or -1, r["middle_chars"] or -1, r["output"], r["back"]) for r in out)
    want = []
    for i, t, *_ in rows:
        n, form, p, m, o = brute(i, t)
        want.append((i or -1, n, form, p or -1, m or -1, o, t or ""))
    assert got == sorted(want)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
