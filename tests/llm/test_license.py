import duckdb

from hearthline.llm import license

PROSE = "and the other words of a long file go on and on without an end in sight for all of us here today indeed. " * 3
MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."


def result(df):
    return {r["doc_id"]: (r["license"], r["basis"], r["directory"]) for r in license.scan(df).collect()}


def rows():
    return [
        (1, MIT, "a/LICENSE", "x"),
        (2, PROSE, "a/b/c/one.txt", "x"),
        (3, PROSE + "\n" + GPL + "\n" + PROSE, "a/b/two.txt", "x"),
        (4, "licensed under the gnu general public license version 3", "a/d/COPYING", "x"),
        (5, PROSE, "a/d/e/f.txt", "x"),
        (6, PROSE, "z/one.txt", "x"),
        (7, None, "a/null.txt", "x"),
        (8, "", "top.txt", "x"),
        (9, "a driver license is what a person needs to drive a car on the road in some town", "z/two.txt", "x"),
        (10, PROSE, None, "x"),
        (11, MIT + "\n" + MIT, "q/LICENSE", "x"),
        (12, PROSE + "\nLicensed under CC BY-NC 4.0.", "q/r.txt", "x"),
    ]


def test_own_and_inherited(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, path string, license string").repartition(3)
    got = result(df)
    assert got[1] == ("MIT", "own", None) and got[2] == ("MIT", "inherited", "a") and got[3] == ("GPL-3.0", "own", None)
    assert got[4] == ("GPL-3.0", "own", None) and got[5] == ("GPL-3.0", "inherited", "a/d") and got[7] == ("MIT", "inherited", "a")
    assert got[11] == ("MIT", "own", None) and got[12] == ("CC-BY-NC-4.0", "own", None)
    assert all(got[i] == (None, "none", None) for i in (6, 8, 9, 10))


def test_same_as_sql(spark):
    df = spark.createDataFrame([r for r in rows() if r[2]], "doc_id long, text string, path string, license string")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, path VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r[:3]) for r in rows() if r[2]])
    names = ["doc_id", "path", "license", "basis", "similarity", "directory"]
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({license.sql('path')})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in license.scan(df).collect())


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, MIT, "k/LICENSE"), (1, PROSE, "k/a"), (1, PROSE, "k/a")], "doc_id long, text string, path string")
    assert sorted((r["doc_id"] or 0, r["license"], r["basis"]) for r in license.scan(df).collect()) == [(0, "MIT", "own"), (1, "MIT", "inherited"), (1, "MIT", "inherited")]
    assert license.scan(df.limit(0)).count() == 0
