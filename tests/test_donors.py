"""Donors of imputed values against brute force over all known rows."""

import random

import pytest
from pyspark.sql import functions as F

from aerogrid.operators import models as M


@pytest.mark.parametrize("decimals", [6, 0])
def test_donors_are_the_nearest_predictions(spark, decimals):
    r, k = random.Random(decimals), 3
    rows = [(i, round(r.uniform(0, 9) ** 2, decimals), i % 4 != 0, 1000.0 + i) for i in range(400)]
    rows += [(1000, 500.0, False, None), (1001, -500.0, False, None), (1002, 40.5, False, None)]
    rows = [(i, p, known, v if known else None) for i, p, known, v in rows]
    df = spark.createDataFrame(rows, "id int, _p double, known boolean, v double")
    asked = F.when(~F.col("known"), F.pmod(F.xxhash64("id"), F.lit(k))).alias("pick")
    pick = {x["id"]: x["pick"] for x in df.select("id", asked).collect()}
    got = {x["id"]: x["_p"] for x in M._nearest_donors(df, "v", "known", "id", k).collect()}
    assert len(got) == len(rows)
    for i, p, known, _ in rows:
        nearest = sorted((abs(q - p), o, v) for o, q, has, v in rows if has)[:k]
        assert got[i] == (p if known else nearest[pick[i]][2])


def test_fewer_known_rows_than_donors(spark):
    df = spark.createDataFrame([(1, 2.0, True, 7.0), (2, 9.0, False, None), (3, -9.0, False, None)], "id int, _p double, known boolean, v double")
    assert {x["id"]: x["_p"] for x in M._nearest_donors(df, "v", "known", "id", 3).collect()} == {1: 2.0, 2: 7.0, 3: 7.0}
