"""Ranks of many draws over blocks of units."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthline.operators import draws


def test_ranks_of_blocks_equal_those_of_whole_draws(spark, monkeypatch):
    monkeypatch.setattr(draws, "BLOCK", 16)
    rng = np.random.default_rng(3)
    values = rng.integers(0, 5, (90, 2)).astype(float)
    weights = rng.random((21, 2)).round(1)
    rows = [(f"{u:05d}", v.tolist(), float(u + 1)) for u, v in enumerate(values)]
    units = spark.createDataFrame(rows, "fips string, values array<double>, place double")
    blocks = draws.blocks_of(units, "fips", 90).withColumn("k", F.lit(2.0)).cache()
    assert blocks.count() > 1 and blocks.agg(F.max(F.size("units"))).first()[0] < 90
    ranked = draws.ranked(draws.scored(blocks, weights)).cache()
    scores = pd.DataFrame(100.0 + 2.0 * (weights[:, :1] * values[:, 0] + weights[:, 1:] * values[:, 1]))
    low, mean = scores.rank(axis=1, method="min"), scores.rank(axis=1, method="average")
    place = blocks.select("block", F.posexplode("units").alias("position", "u")).select("block", "position", "u.fips")
    got = draws.spread(ranked).join(place, ["block", "position"]).toPandas().set_index("fips").sort_index()
    assert len(got) == 90 and (got.n == 21).all()
    assert got.total.tolist() == low.sum().tolist() and got.squares.tolist() == (low**2).sum().tolist()
    assert got["p05"].tolist() == pytest.approx(low.quantile(0.05).tolist())
    assert got["p95"].tolist() == pytest.approx(low.quantile(0.95).tolist())
    assert got["shift"].tolist() == (low.max() - low.min()).tolist()
    r = {x["iteration"]: x["r"] for x in ranked.where("r is not null").collect()}
    want = mean.T.corrwith(pd.Series(range(1, 91)).astype(float))
    assert [r[i] for i in range(21) if i in r] == pytest.approx(want.dropna().tolist())
