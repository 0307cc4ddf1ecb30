"""Fill-in-middle transformation: two cut ranks of a text are found by descending an indexable skip list.

A text is a row of units: runs of ASCII letters, and every other code point alone.  Lane 0 of the list has one node
per unit; an express lane keeps every node whose tower reaches it.  Each link of a lane carries two widths: the units
and the code points it jumps over.  Descending from the highest lane, a search follows links while the units passed
stay within the wanted rank, and the code points summed on the way are the place of the cut.

The pieces between the cuts are put in another order behind the markers ``<P>``, ``<S>`` and ``<M>``.  A text with a
marker in it stays as it is, so an output can always be read back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many are transformed; of 100 transformed ones, so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1
#: A tower is one lane higher with chance 1 / 2**LIFT.
LIFT = 3
STEP = np.uint64(0x9E3779B97F4A7C15)


class SkipList:
    """Units of one text under express lanes of widths."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        low = points | 32
        letter = (low >= 97) & (low <= 122) & (points < 128)
        first = ~letter
        first[1:] |= ~letter[:-1]
        first[:1] = True
        starts = np.flatnonzero(first)
        self.units, self.points = len(starts), len(points)
        ends = np.append(starts, self.points)
        #: Lanes from the lowest to the highest: node ranks, and per link its two widths.
        self.lanes: list[tuple[np.ndarray, np.ndarray]] = []
        self.below: list[np.ndarray] = []
        nodes = np.arange(self.units, dtype=np.int64)
        towers = (nodes.astype(np.uint64) + np.uint64(SEED)) * STEP
        towers = (towers ^ (towers >> np.uint64(31))) * STEP >> np.uint64(16)
        at = nodes
        while True:
            stops = np.append(nodes, self.units)
            self.lanes.append((np.diff(stops), np.diff(ends[stops])))
            self.below.append(at)
            if len(nodes) <= 1 << LIFT:
                break
            mask = np.uint64((1 << LIFT * len(self.lanes)) - 1)
            tall = (towers[nodes] & mask) == 0
            tall[0] = True
            at = np.flatnonzero(tall)
            if len(at) == len(nodes):
                break
            nodes = nodes[at]

    def seek(self, rank: int) -> int:
        """Code points before the unit of this rank; all of them for the rank after the last."""
        node = passed = points = 0
        for lane in range(len(self.lanes) - 1, -1, -1):
            units, width = self.lanes[lane]
            while node < len(units) and passed + units[node] <= rank:
                passed += int(units[node])
                points += int(width[node])
                node += 1
            if node == len(units):
                break
            # The same node, one lane down.
            node = int(self.below[lane][node])
        return points


def draws(id_column: str, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document, from its id alone; a null id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cuts(text: Column, h1: Column, h2: Column) -> Column:
    def each(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, first, second in batches:
            rows = []
            for t, x, y in zip(texts, first, second):
                units = SkipList(t)
                ranks = int(x) % (units.units + 1), int(y) % (units.units + 1)
                rows.append((units.units, units.seek(min(ranks)), units.seek(max(ranks))))
            yield pd.DataFrame(rows, columns=["n", "start", "stop"], dtype="int64")

    return F.pandas_udf(each, "n long, start long, stop long")(text, h1, h2)


def transform(df: DataFrame, id_column: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """One row per input row: id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` text.

    A null text counts as empty; an empty text, a text with a marker and one that is not drawn are ``plain``: their
    output is the text and their counts are null.  Rows with a null id take the draws of the empty id.  Equal rows
    come back as often as they are there.  Other columns play no part and may have any name.
    """
    rows = df.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("*", *[h.alias(f"_h{i}") for i, h in enumerate(draws("_id", seed), 1)])
    rows = rows.select("*", _cuts(F.col("_text"), F.col("_h1"), F.col("_h2")).alias("_at"))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("_text", F.lit(marker))
    plain = (F.col("_text") == "") | marked | (F.col("_h3") % 100 >= RATE)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"))
    start, stop = F.col("_at.start").cast("int"), F.col("_at.stop").cast("int")
    prefix = F.substring("_text", F.lit(1), start)
    middle = F.substring("_text", start + 1, stop - start)
    suffix = F.substring("_text", stop + 1, F.length("_text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))
    counted = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return rows.select(
        F.col("_id").alias(id_column),
        F.col("_at.n").alias("n"),
        "form",
        counted(start).alias("prefix_chars"),
        counted(stop - start).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text a transformed ``output`` was made of.

    No piece holds a marker and a marker cannot begin inside another, so the first occurrence of each is its own.
    """

    def after(text: Column, marker: str) -> Column:
        return F.substring(text, F.instr(text, marker) + len(marker), F.length(text))

    def before(text: Column, marker: str) -> Column:
        return F.substring(text, F.lit(1), F.instr(text, marker) - 1)

    outer, middle = before(output, MIDDLE), after(output, MIDDLE)
    body = F.substring(outer, F.lit(len(PREFIX) + 1), F.length(outer))
    psm = F.concat(before(body, SUFFIX), middle, after(body, SUFFIX))
    spm = F.concat(after(body, PREFIX), middle, before(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
