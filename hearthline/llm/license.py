"""Licence scan: TF-IDF cosine of statements to templates, then inheritance from the nearest ancestor directory.

A statement is a line that names a licence.  Equal statements are counted first, so one line in a third of all files
is one row from then on; inverse document frequencies are those of all statements.  A file's own licence is the best
template over its statements.  A licence file is one whose best statement makes up a third of its words or more; it
speaks for its directory, and files without a licence of their own take that of the nearest directory above them.
Everything is a DataFrame expression or a join; only the fixed templates are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.storage import materialize

#: Licences and the statement that stands for each.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under the CC0 1.0 Universal public domain dedication license.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
}
#: A line that names a licence; longer lines are prose that speaks of one, and are read like any other.
NAMES_LICENCE = "(?i)licen[cs]e|copyright|spdx"
TERM = "[a-z0-9]+"
LEAST, SHARE = 0.6, 3


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0))


def statements(df: DataFrame, id_column: str, text: str, path: str) -> DataFrame:
    """``(id, path, line, share)`` of lines that name a licence; share: a file's words by the line's words."""
    some = df.select(id_column, path, F.col(text).alias("_text")).where(F.col("_text").rlike(NAMES_LICENCE))
    lines = some.select(id_column, path, F.size(_terms(F.col("_text"))).alias("_all"), F.explode(F.split("_text", "\n")).alias("line"))
    lines = lines.where(F.col("line").rlike(NAMES_LICENCE))
    return lines.select(id_column, path, "line", (SHARE * F.size(_terms(F.col("line"))) >= F.col("_all")).alias("fills"))


def similar(lines: DataFrame) -> DataFrame:
    """``(line, license, similarity)``: the best template of each distinct statement at or above the limit."""
    spark = lines.sparkSession
    distinct = materialize(lines.groupBy("line").agg(F.count("*").alias("n")), "statements")
    terms = distinct.select("line", "n", F.explode(_terms(F.col("line"))).alias("term")).groupBy("line", "n", "term").agg(F.count("*").alias("tf"))
    known = spark.createDataFrame(sorted(TEMPLATES.items()), "license string, statement string")
    given = known.select("license", F.explode(_terms(F.col("statement"))).alias("term")).groupBy("license", "term").agg(F.count("*").alias("tf"))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    found = terms.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    # One row per term; the single row with the total goes along with each.
    idf = found.join(given.select("term").distinct(), "term", "full").join(F.broadcast(total), F.lit(True)).select("term", weight.alias("idf"))
    idf = materialize(idf, "idf")
    own = terms.join(idf, "term").select("line", "term", (F.col("tf") * F.col("idf")).alias("w"))
    theirs = given.join(idf, "term").select("license", "term", (F.col("tf") * F.col("idf")).alias("v"))
    size = own.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    their_size = theirs.groupBy("license").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("their_length"))
    # As many rows as the templates have terms.
    theirs = F.broadcast(theirs.join(their_size, "license"))
    dots = own.join(theirs, "term").groupBy("line", "license").agg(F.sum(F.col("w") * F.col("v") / F.col("their_length")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("length"), 6).alias("similarity")
    scored = dots.join(size, "line").select("line", "license", cosine).where(F.col("similarity") >= LEAST)
    best = F.max_by(F.struct("license", "similarity"), F.struct("similarity", _last_first("license")))
    return materialize(scored.groupBy("line").agg(best.alias("best")).select("line", "best.*"), "similar")


def _last_first(name: str) -> Column:
    """An order in which the alphabetically first licence is the greatest."""
    names = sorted(TEMPLATES, reverse=True)
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(name))


def directory(path: Column) -> Column:
    """The directory of a path; null for a path without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def scan(df: DataFrame, id_column: str = "doc_id", text: str = "text", path: str = "path") -> DataFrame:
    """``(id, path, license, basis, similarity, directory)``, one row per input row.

    ``basis`` is ``own``, ``inherited`` (``directory`` says from where) or ``none``.  Rows that share id and path are
    one file and get one result each.  A null text has no statement; a file with a null path inherits nothing.  Of
    several best statements or licence files the highest similarity wins, then the first licence in the alphabet.
    """
    lines = materialize(statements(df, id_column, text, path), "lines")
    matched = lines.join(similar(lines), "line")
    order = F.struct("similarity", _last_first("license"))
    own = matched.groupBy(id_column, path).agg(F.max_by(F.struct("license", "similarity", "fills"), order).alias("own"))
    own = materialize(own, "own")
    files = own.where("own.fills").select(directory(F.col(path)).alias("directory"), "own.license", "own.similarity").where("directory is not null")
    speaks = files.groupBy("directory").agg(F.max_by(F.struct("license", "similarity"), order).alias("given"))
    speaks = materialize(speaks, "directories")
    rows = df.select(id_column, path)
    mine = own.select(F.col(id_column).alias("_id"), F.col(path).alias("_path"), "own")
    rows = rows.join(mine, rows[id_column].eqNullSafe(mine["_id"]) & rows[path].eqNullSafe(mine["_path"]), "left").select(id_column, path, "own")
    has = rows.where("own is not null").select(
        id_column, path, "own.license", F.lit("own").alias("basis"), "own.similarity", F.lit(None).cast("string").alias("directory")
    )
    # Directories above a path, nearest first; a directory's licence is looked up once for all files below it.
    lacks = rows.where("own is null").select(id_column, path, directory(F.col(path)).alias("_dir"))
    names = lacks.select("_dir").where("_dir is not null").distinct()
    steps = F.split("_dir", "/")
    above = F.transform(F.sequence(F.size(steps), F.lit(1), F.lit(-1)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("directory")))
    placed = names.select("_dir", F.inline(above)).join(speaks, "directory")
    nearest = placed.groupBy("_dir").agg(F.max_by(F.struct("given", "directory"), "depth").alias("near"))
    taken = lacks.join(materialize(nearest, "nearest"), "_dir", "left")
    rest = taken.select(
        id_column, path, F.col("near.given.license").alias("license"),
        F.when(F.col("near").isNull(), "none").otherwise("inherited").alias("basis"),
        F.col("near.given.similarity").alias("similarity"), F.col("near.directory").alias("directory"),
    )
    return has.unionByName(rest)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(path: str, documents: str = "documents") -> str:
    """The same in DuckDB SQL for ``doc_id``, ``text`` and an expression for the path."""
    given = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))
    terms = lambda x: f"regexp_extract_all(lower({x}), '{TERM}')"
    return f"""
WITH docs AS (SELECT doc_id, {path} AS path, text FROM {documents}),
lines AS (
  SELECT doc_id, path, line, {SHARE} * len({terms('line')}) >= words AS fills
  FROM (SELECT doc_id, path, len({terms('text')}) AS words, unnest(string_split(text, chr(10))) AS line FROM docs
        WHERE regexp_matches(text, '{NAMES_LICENCE}'))
  WHERE regexp_matches(line, '{NAMES_LICENCE}')),
kinds AS (SELECT line, count(*) AS n FROM lines GROUP BY line),
terms AS (SELECT line, n, term, count(*) AS tf FROM (SELECT line, n, unnest({terms('line')}) AS term FROM kinds) GROUP BY ALL),
given AS (SELECT license, term, count(*) AS tf FROM (SELECT license, unnest({terms('statement')}) AS term
          FROM (VALUES {given}) AS t(license, statement)) GROUP BY ALL),
found AS (SELECT term, sum(n) AS df FROM terms GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT coalesce(sum(n), 0) FROM kinds)) / (1 + coalesce(df, 0))) + 1 AS idf
        FROM found FULL JOIN (SELECT DISTINCT term FROM given) USING (term)),
own AS (SELECT line, term, tf * idf AS w FROM terms JOIN idf USING (term)),
theirs AS (SELECT license, term, tf * idf AS v FROM given JOIN idf USING (term)),
scored AS (
  SELECT line, license, round(sum(w * v) / any_value(a.s) / any_value(b.s), 6) AS similarity
  FROM own JOIN theirs USING (term) JOIN (SELECT line, sqrt(sum(w * w)) AS s FROM own GROUP BY line) a USING (line)
  JOIN (SELECT license, sqrt(sum(v * v)) AS s FROM theirs GROUP BY license) b USING (license) GROUP BY line, license),
best AS (SELECT * FROM scored WHERE similarity >= {LEAST}
         QUALIFY row_number() OVER (PARTITION BY line ORDER BY similarity DESC, license) = 1),
mine AS (SELECT doc_id, path, license, similarity, fills FROM lines JOIN best USING (line)
         QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY similarity DESC, license) = 1),
speaks AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory, license, similarity FROM mine WHERE fills AND contains(path, '/')
           QUALIFY row_number() OVER (PARTITION BY directory ORDER BY similarity DESC, license) = 1),
lacks AS (SELECT doc_id, path FROM docs WHERE (doc_id, path) NOT IN (SELECT (doc_id, path) FROM mine)),
above AS (SELECT DISTINCT path, array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS directory, k
          FROM lacks, generate_series(1, 20) AS g(k) WHERE k < len(string_split(path, '/'))),
near AS (SELECT path, directory, license, similarity FROM above JOIN speaks USING (directory)
         QUALIFY row_number() OVER (PARTITION BY path ORDER BY k DESC) = 1)
SELECT doc_id, path, license, 'own' AS basis, similarity, NULL::VARCHAR AS directory FROM mine
UNION ALL
SELECT doc_id, path, license, CASE WHEN directory IS NULL THEN 'none' ELSE 'inherited' END, similarity, directory
FROM lacks LEFT JOIN near USING (path)"""
