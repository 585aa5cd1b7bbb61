"""The text queries on a small table: against SQL, the library itself, brute force, or held-out labels."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aerogrid.llm import queries as Q
from tests_llm_brute import ascii_lower, components, shingle_sets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(small):
    return pd.read_parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return dict(zip(docs["doc_id"], docs["text"].fillna(""), strict=True))


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_against_sql(name, spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    mine = Q.queries()[name](spark, small).toPandas().sort_values("doc_id", ignore_index=True)
    theirs = con.execute(Q.oracle_sql()[name]).df().sort_values("doc_id", ignore_index=True)[list(mine.columns)]
    for c in mine.columns:
        assert [None if pd.isna(x) else x for x in mine[c]] == [None if pd.isna(x) else x for x in theirs[c]], c


def test_repeats_against_all_windows(spark, small, texts):
    words = {i: ascii_lower(t).split() for i, t in texts.items()}
    count = Counter(w for ws in words.values() for w in {tuple(ws[j : j + 50]) for j in range(len(ws) - 49)})
    got = {i: np.zeros(len(ws), bool) for i, ws in words.items()}
    for r in Q.op2_suffix_dedup(spark, small).collect():
        assert r["n_words"] == r["end"] - r["begin"] >= 50
        assert not got[r["doc_id"]][max(0, r["begin"] - 1) : r["end"] + 1].any()
        got[r["doc_id"]][r["begin"] : r["end"]] = True
    for i, ws in words.items():
        mask = np.zeros(len(ws), bool)
        for j in range(len(ws) - 49):
            if count[tuple(ws[j : j + 50])] > 1:
                mask[j : j + 50] = True
        assert np.array_equal(got[i], mask)


def test_packing_round_trip(spark, small, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = Q.op4_packing(spark, small).toPandas()
    for i, g in got.groupby("doc_id"):
        ids, at = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in g.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert set(got["doc_id"]) == set(texts)
    for _, g in got.groupby("sequence_id"):
        ends = g.sort_values("offset")
        assert list(ends["offset"]) == [0, *np.cumsum(ends["length"])[:-1]] and ends["length"].sum() <= 2048
    assert got["length"].sum() / (got["sequence_id"].nunique() * 2048) > 0.95


def test_language_on_held_out(spark, small, docs):
    got = Q.op5_language_id(spark, small).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"] & got["lang"].notna()]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all() and len(got) == len(docs)


def test_neighbours_recall(spark, small):
    e = pd.read_parquet(f"{small}/embeddings.parquet")
    m, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    got = Q.op6_hilbert_ann(spark, small).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        sims = unit @ unit[q]
        sims[q] = -9
        true = set(ids[np.lexsort((ids, -sims))[:5]])
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and mine["score"].is_monotonic_decreasing
        hits, total = hits + len(true & set(mine["vec_id"])), total + 5
    assert hits / total >= 0.9


def test_quality_on_held_out(spark, small, docs):
    labels = pd.read_parquet(f"{small}/labels.parquet")
    got = Q.op7_quality(spark, small).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all() and len(got) == len(docs)
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.85


def test_contamination_by_all_windows(spark, small, texts):
    items = pd.read_parquet(f"{small}/benchmark.parquet")
    windows: dict = {}
    for i, t in zip(items["item_id"], items["text"].fillna(""), strict=True):
        ws = WORD.findall(ascii_lower(t))
        n = min(10, len(ws))
        for j in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[j : j + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    for r in Q.op8_decontaminate(spark, small).collect():
        ws = WORD.findall(ascii_lower(texts[r["doc_id"]]))
        hit, found = np.zeros(len(ws), bool), set()
        for n in sizes:
            for j in range(len(ws) - n + 1):
                if tuple(ws[j : j + n]) in windows:
                    hit[j : j + n] = True
                    found |= windows[tuple(ws[j : j + n])]
        names = ",".join(sorted(map(str, found)))
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(ws), hit.sum(), len(found))
        assert r["items_sha256"] == hashlib.sha256(names.encode()).hexdigest() and r["contaminated"] == (hit.sum() > 0)


def test_token_counts_are_the_library_s(spark, small, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in Q.op9_token_count(spark, small).collect():
        t = texts[r["doc_id"]]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)


def test_links_against_all_pairs(spark, small, texts):
    sets = shingle_sets(texts, 3)
    want = components(sets, 90)
    for r in Q.op10_jaccard_join(spark, small).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
