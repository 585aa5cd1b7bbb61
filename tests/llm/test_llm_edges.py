"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing names, for every text operator and stage."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from aerogrid.llm import bpe, hilbert_ann, jaccard_join, language_id, line_dedup, packing, quality, suffix_dedup, token_count
from aerogrid.llm.components import connected_components
from aerogrid.llm.decontaminate import decontaminate
from aerogrid.llm.license_scan import scan_licenses

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASH = ["n_words", "score", "row", "site", "kept", "sid", "n", "token", "root", "spans", "words", "hits", "place", "v", "key", "label", "part", "n_lines", "n_dropped", "n_pages", "line", "rank"]


def _long(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["river", "stone", "cloud", "moss", "Ünder", "lamp", "of"]) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage = " ".join(f"p{i}" for i in range(60))
    return [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", "s", 4),
        (4, _long(60_000, 1), "en", "s", None),
        (5, "Released under the MIT License.\nMIT license and mit LICENSE", "en", "s", 3),
        (6, "alpha beta gamma delta <|endoftext|> \U0001d504 'll it's x", None, "s", 3),
        (7, f"one two {passage} three", "en", "s", 3),
        (8, f"four {passage} five six", "en", None, 3),
        (9, "the same text of some words for all of us", "en", "s", 3),
        (9, "the same text of some words for all of us", "en", "s", 3),
        (10, "the same text of some words for all of us", "en", "t", 3),
        (None, "the same text of some words for all of us", "en", "t", 3),
        (None, None, "en", "t", 3),
        (11, "la la la la la la la la la la la la", "fr", "t", 3),
        (12, "1234 !!! ???", "fr", "t", 3),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_licenses(docs, none):
    out = scan_licenses(docs)
    got = by_id(out)
    assert out.count() == 15 and scan_licenses(none).count() == 0
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (0, 0, None, "", 0.0)
    assert (got[5]["n_base"], got[5]["first_word"], got[5]["last_word"], got[5]["base_labels"], got[5]["score"]) == (3, 3, 8, "mit", 1.0)


def test_license_templates(spark):
    text = "Redistribution and use in source and binary forms, with or without modification, are permitted. Licensed under the GNU General Public License version 3"
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (r["labels"], r["base_labels"]) == ("bsd,gpl,gpl-3.0", "gpl")


def test_repeats(docs, none):
    out = suffix_dedup.find_repeats(docs)
    got = by_id(out)
    assert out.count() == 15 and suffix_dedup.find_repeats(none).count() == 0
    assert [(s["begin"], s["end"]) for s in got[7]["spans"]] == [(2, 62)]
    assert [(s["begin"], s["end"]) for s in got[8]["spans"]] == [(1, 61)]
    assert got[1]["n_words"] == 0 and got[9]["spans"] == [] and got[4]["n_repeated"] == 0


def test_repeats_of_periodic_and_crowded_texts(spark):
    rows = [(i, " ".join(["x"] * 80)) for i in range(3)] + [(9, " ".join(["y"] * 200))]
    rows += [(20 + i, " ".join(f"w{j if j != 37 + i % 5 else -i}" for j in range(75))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for hot in (2, 1000):
        got = {r["doc_id"]: r["n_repeated"] for r in suffix_dedup.find_repeats(df, hot=hot).collect()}
        words = {i: t.split() for i, t in rows}
        for i, ws in words.items():
            mask = np.zeros(len(ws), bool)
            for j in range(len(ws) - 49):
                if any(o != i and any(ws[j : j + 50] == os[k : k + 50] for k in range(len(os) - 49)) for o, os in words.items()):
                    mask[j : j + 50] = True
            assert got[i] == mask.sum()


def test_lines(docs, none, spark):
    out = line_dedup.dedupe_lines(docs)
    assert out.count() == 15 and line_dedup.dedupe_lines(none).count() == 0
    assert set(docs.columns) | {"n_lines", "n_dropped"} == set(out.columns)
    rows = [(i, f"menu\n\nown line {i}", "h") for i in range(10)] + [(10, None, "h"), (11, "menu", None)]
    got = line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id int, text string, source string"), ratio=0.5)
    got = {r["doc_id"]: r for r in got.collect()}
    assert (got[3]["text"], got[3]["n_lines"], got[3]["n_dropped"]) == ("\nown line 3", 2, 1)
    assert (got[10]["text"], got[10]["n_lines"]) == (None, 0) and got[11]["text"] == "menu"
    plain = line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id int, text string, source string"), ratio=0.5, broadcast_lines=0)
    assert {r["doc_id"]: r["text"] for r in plain.collect()} == {i: r["text"] for i, r in got.items()}


def test_exact_copies_are_one_page(spark):
    df = spark.createDataFrame([(i, "a copied page\nof two lines", "h") for i in range(8)], "doc_id int, text string, source string")
    assert line_dedup.dedupe_lines(df).agg(F.sum("n_dropped")).first()[0] == 0


def test_packing(docs, none, rows):
    out = packing.pack(docs, WORDS)
    assert packing.pack(none, WORDS).count() == 0
    library = Tokenizer.from_file(WORDS)
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    pieces = out.collect()
    assert sorted(r["doc_tokens"] for r in pieces if r["start"] == 0) == want
    assert sum(r["length"] for r in pieces) == sum(want)


def test_window_fill_is_the_best_subset():
    rng = random.Random(4)
    for _ in range(60):
        cap = rng.randrange(20, 60)
        lengths = [rng.randrange(1, cap) for _ in range(rng.randrange(1, 9))]
        counts = [0] * (cap + 1)
        for n in lengths:
            counts[n] += 1
        taken = dict(packing.fill_window(counts, sorted(set(lengths), reverse=True), cap))
        assert all(counts[n] >= c for n, c in taken.items())
        rest = list(lengths)
        rest.remove(max(lengths))
        sums = {0}
        for n in rest:
            sums |= {s + n for s in sums}
        assert sum(n * c for n, c in taken.items()) == max(s for s in sums if s <= cap - max(lengths)) + max(lengths)


def test_language(docs, none):
    model = language_id.fit(docs)
    assert model.languages == ["en", "fr"]
    got = by_id(language_id.identify(docs, model))
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 12)] == ["und"] * 4 and got[1]["score"] == 0.0
    assert language_id.identify(none, model).count() == 0
    empty = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_mixed_language_spans(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs)
    one = {lang: docs.filter((F.col("lang") == lang) & (F.length("text") > 600)).orderBy("doc_id").first()["text"] for lang in ("de", "fr")}
    mixed = f"{one['de'][:600]} {one['fr'][:600]}"
    _, _, spans = language_id.label(model, mixed.encode())
    assert [s[0] for s in spans] == ["de", "fr"]


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, k, p = int(rng.integers(1, 30)), int(rng.integers(2, 4)), float(rng.choice([1.0, 3.0, 15.0]))
        scores = -rng.exponential(1.5, (n, k))
        best = scores[0].copy()
        for s in scores[1:]:
            best = np.maximum(best, best.max() - p) + s
        path = language_id.viterbi(scores, p)
        assert scores[np.arange(n), path].sum() - p * (np.diff(path) != 0).sum() == pytest.approx(best.max())


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("добрый день мир", "ru"), ("good day world", "en"), ("καλημέρα κόσμε", "el")] * 3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert [language_id.label(model, t.encode())[0] for t in ("зима и лето", "winter and", "θάλασσα")] == ["ru", "en", "el"]
    assert language_id.label(model, "冬".encode())[0] in model.languages


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (50, [1.0, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"query": F.lit(1), "v": F.lit(2), "curve": F.lit(3)})
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in hilbert_ann.search(df, curves=2).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 1.0), (0, 4, 3, 0.0)]
    assert [g[2] for g in got if g[0] == 50] == [0, 1, 2, 3]
    assert hilbert_ann.search(df.limit(0)).count() == 0


def test_many_equal_vectors_go_to_the_smallest_ids(spark):
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.col("id") * 1.0)).alias("embedding"))
    got = [r["vec_id"] for r in hilbert_ann.search(df).filter("query_id = 100").orderBy("rank").collect()]
    assert got == [1, 2, 4, 5, 7]


def test_hilbert_curve_fills_space():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * axes)).reshape(axes, -1).T
        keys = hilbert_ann.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(2, 0), (5, 1), (7, 1), (9, 1), (11, 0), (None, 1), (3, None)], "doc_id bigint, quality int").withColumn("text", F.lit("clash"))
    model = quality.fit(docs, labels)
    out = quality.score_quality(docs, model)
    assert out.count() == 15 and out.filter("score < 0 OR score > 1").count() == 0 and quality.score_quality(none, model).count() == 0
    blank = quality.fit(docs, labels.limit(0))
    assert {(r["score"], r["predicted"]) for r in quality.score_quality(docs, blank).collect()} == {(0.5, 1)}


def test_decontamination(docs, none, spark, monkeypatch):
    items = spark.createDataFrame([(1, "p0 p1 P2! p3 p4 p5 p6 p7 p8 p9 p10"), (2, "la la"), (3, None), (4, "!!"), (None, "three"), (2, "same text of some")], "item_id bigint, text string")
    for most in (0, 10_000_000):  # by shuffle, by broadcast
        monkeypatch.setattr("aerogrid.scratch.BROADCAST_BYTES", most)
        out = decontaminate(docs, items)
        got = by_id(out)
        assert out.count() == 15 and (got[1]["n_words"], got[1]["n_hit"], got[1]["contaminated"]) == (0, 0, False)
        assert (got[7]["n_hit"], got[7]["n_items"]) == (12, 1) and (got[8]["n_hit"], got[11]["n_hit"], got[9]["n_hit"]) == (11, 12, 4)
        assert [tuple(x) for x in got[11]["spans"]] == [(i, i + 2) for i in range(11)] and got[1]["spans"] == []
    assert decontaminate(none, items).count() == 0
    assert decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("bytes_", [None, 0])
def test_a_window_of_very_many_items(spark, monkeypatch, bytes_):
    """4,000 items open with one window; some share their id, some have none; texts hit that window, others, or both."""
    if bytes_ is not None:
        monkeypatch.setattr("aerogrid.scratch.BROADCAST_BYTES", bytes_)
    shared, other = [f"w{j}" for j in range(10)], [f"v{j}" for j in range(12)]
    items = [(f"i{n % 3990}" if n % 100 else None, " ".join([*shared, *[f"n{n}.{j}" for j in range(n % 4)]])) for n in range(4000)]
    items += [("", " ".join(other)), ("i7", " ".join(other[1:])), (None, "only by none at all here it is ten words")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = {0: shared, 1: ["a", *shared, "b", *other], 2: other[:11], 3: other, 4: shared[1:], 5: "x only by none at all here it is ten words y".split()}
    df = spark.createDataFrame([(n + 10 * copy, " ".join(ws)) for n, ws in texts.items() for copy in range(3)], "doc_id int, text string")
    of = {}
    for item, text in items:
        ws = text.split()
        size = min(10, len(ws))
        for s in range(len(ws) - size + 1):
            of.setdefault(tuple(ws[s : s + size]), set()).add(item)
    for r in decontaminate(df, bench).collect():
        ws, names, hit = texts[r["doc_id"] % 10], set(), set()
        for size in (9, 10):
            for s in range(len(ws) - size + 1):
                if found := of.get(tuple(ws[s : s + size])):
                    names |= found - {None}
                    hit |= set(range(s, s + size))
        assert (r["n_hit"], r["n_items"]) == (len(hit), len(names)), r["doc_id"]
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_token_counts(docs, none, rows):
    library = Tokenizer.from_file(BYTES)
    got = sorted(r["n_tokens"] for r in token_count.count_tokens(docs, BYTES).collect())
    assert got == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows)
    assert token_count.count_tokens(none, BYTES).count() == 0


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_kept_pieces_are_the_library_s(path):
    code, rng = bpe.coder(path), random.Random(6)
    alphabet = "aé'sdßLl 12 \n\t.,!-_ñÇ İıſ́ͅΣςZz日本語  \x1c\x85ﬁ\U0001f600"
    words, costs = packing.WordIds(code), token_count.Costs(code, token_count.whole_tokens(code))
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25)))
        want = code.whole(text)
        if path == WORDS:
            assert packing.text_ids(code, words, text.encode()) == np.array(want, "<u4").tobytes(), repr(text)
        elif code.plain(text):
            assert sum(costs[p] for p in code.pattern.findall(text)) == len(want), repr(text)


def test_links(docs, none):
    out = jaccard_join.link_documents(docs)
    got = by_id(out)
    assert out.count() == 15 and jaccard_join.link_documents(none).count() == 0
    assert (got[9]["component_id"], got[10]["component_id"]) == (9, 9)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert sorted(str(r["component_id"]) for r in out.filter("doc_id IS NULL").collect()) == ["9", "None"]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 50)])
def test_links_of_edited_copies(spark, n, percent):
    rng = random.Random(n)
    rows, bases = [], [[f"w{rng.randrange(4000)}" for _ in range(rng.choice([12, 40, 90, 200]))] for _ in range(12)]
    for i in range(260):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, max(2, len(words) // 12))):
            words[rng.randrange(len(words))] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    from tests_llm_brute import components, shingle_sets

    want = components(shingle_sets(dict(rows), n), percent)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id int, text string"), n, percent).collect()}
    assert got == want


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 6)} | {8: 8, 9: 8} | {i: 100 for i in range(100, 141)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_on_odd_rows(spark, docs, none, small):
    for table in (docs, none):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, small)
            assert now.columns == docs.columns, name
            assert now.select(*CLASH).distinct().collect() == ([] if table is none else [tuple(["clash"] * len(CLASH))]), name
        last = corpus_pipeline.STAGES[-1][1](spark, now, small)
        packed = last.filter("start = 0").groupBy("doc_id").count().collect()
        assert sorted(map(str, packed)) == sorted(map(str, now.groupBy("doc_id").count().collect()))
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, small).collect()}
    assert {5, 7, 8, 9} <= kept and not kept & {1, 2, 3, 12}
    near = corpus_pipeline.STAGES[2][1](spark, docs.filter("doc_id IN (9, 10)"), small)
    assert [r["doc_id"] for r in near.collect()] == [9]


def test_pipeline_by_stage(spark, small):
    from tests_llm_brute import components, shingle_sets

    docs = spark.read.parquet(f"{small}/documents.parquet")
    said = corpus_pipeline.STAGES[0][1](spark, docs, small)
    assert said.count() == docs.count()  # all are prose
    lined = corpus_pipeline.STAGES[1][1](spark, said, small)
    before = {r["doc_id"]: r["text"] for r in said.collect()}
    texts = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert all(set(t.split("\n")) <= set(before[i].split("\n")) for i, t in texts.items())
    near = corpus_pipeline.STAGES[2][1](spark, lined, small)
    want = components(shingle_sets(texts, 5), 80)
    assert {r["doc_id"] for r in near.collect()} == {i for i, c in want.items() if i == c}
    clean = corpus_pipeline.STAGES[3][1](spark, near, small)
    hit = {r["doc_id"] for r in decontaminate(near, spark.read.parquet(f"{small}/benchmark.parquet")).filter("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - hit
    packed = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in clean.collect()}
