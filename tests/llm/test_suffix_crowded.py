"""A passage that very many different documents hold, of which no task may get more than `hot` suffixes."""

import numpy as np
from pyspark.sql import functions as F

from aerogrid.llm import suffix_dedup


def test_no_part_of_a_crowded_gram_is_larger_than_hot(spark, monkeypatch):
    passage = [f"p{j}" for j in range(60)]
    words = {i: [f"a{i}.{j}" for j in range(i % 70)] + passage + [f"b{i}.{j}" for j in range((7 * i) % 60)] for i in range(120)}
    words[500] = passage[5:58]
    words[501] = [*passage[:49], "other", *passage[50:]]
    words[502] = ["before", *passage[30:], *[f"c{j}" for j in range(60)]]
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in words.items()], "doc_id int, text string")
    largest, deal = [], suffix_dedup.map_batches

    def watched(rows, fn, schema):
        if "part" in rows.columns:
            largest.append(rows.groupBy("part").count().agg(F.max("count")).first()[0] or 0)
        return deal(rows, fn, schema)

    monkeypatch.setattr(suffix_dedup, "map_batches", watched)
    got = {r["doc_id"]: [(s["begin"], s["end"]) for s in r["spans"]] for r in suffix_dedup.find_repeats(df, hot=20).collect()}
    assert largest and largest[0] <= 20
    windows = {}
    for i, ws in words.items():
        for j in range(len(ws) - 49):
            windows.setdefault(tuple(ws[j : j + 50]), set()).add(i)
    for i, ws in words.items():
        mask = np.zeros(len(ws) + 2, np.int8)
        for j in range(len(ws) - 49):
            if len(windows[tuple(ws[j : j + 50])]) > 1:
                mask[j + 1 : j + 51] = 1
        turns = np.flatnonzero(np.diff(mask))
        assert got[i] == list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def test_one_gram_of_many_batches_is_sorted_whole(spark):
    """2,600 different suffixes of one k-gram: sorted together, over several Arrow batches, between smaller groups."""
    passage = [f"p{j}" for j in range(60)]
    words = {i: [f"a{i}.{j}" for j in range(i % 70)] + passage + [f"b{i}.{j}" for j in range((7 * i) % 60)] for i in range(2600)}
    for i in range(300):  # pairs of their own
        words[10_000 + 2 * i] = [f"c{i}.{j}" for j in range(55)] + ["end"]
        words[10_001 + 2 * i] = ["start", *[f"c{i}.{j}" for j in range(55)]]
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in words.items()], "doc_id int, text string")
    got = {r["doc_id"]: [(s["begin"], s["end"]) for s in r["spans"]] for r in suffix_dedup.find_repeats(df).collect()}
    for i in words:
        at = i % 70 if i < 2600 else i % 2
        assert got[i] == [(at, at + (60 if i < 2600 else 55))]
