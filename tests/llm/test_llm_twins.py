"""Language identification and the quality model against plain-Python versions; rows that repeat ids or have none."""

import bisect
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from aerogrid.llm import hilbert_ann, language_id, line_dedup, quality, token_count
from aerogrid.llm import queries as Q

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


# --- language -----------------------------------------------------------------------------------------------------
def split(text):
    """Maximal runs of letters."""
    words, now = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            now += c
        elif now:
            words.append(now)
            now = ""
    return words


def bucket(a, b, c):
    m = (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA77 ^ ord(c) * 0xC2B2AE3D) & 0xFFFFFFFF
    return ((m ^ m >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17


def grams(word):
    padded = f" {word} "
    return [bucket(*padded[i : i + 3]) for i in range(len(word))]


def script(word):
    return language_id.SCRIPTS[bisect.bisect([s for s, _ in language_id.SCRIPTS], ord(word[0])) - 1][1]


class Twin:
    """The model by counting in dictionaries, and the best of all paths."""

    def __init__(self, rows):
        self.languages = sorted({lang for _, lang in rows if lang is not None})
        self.counts = {lang: {} for lang in self.languages}
        self.scripts = {lang: {} for lang in self.languages}
        for text, lang in rows:
            for w in split(text) if lang is not None and text is not None else ():
                self.scripts[lang][script(w)] = self.scripts[lang].get(script(w), 0) + len(w)
                for g in grams(w):
                    self.counts[lang][g] = self.counts[lang].get(g, 0) + 1

    def allowed(self, lang, word):
        return self.scripts[lang].get(script(word), 0) > language_id.SCRIPT_SHARE * max(1, sum(self.scripts[lang].values()))

    def word(self, w):
        sums = {}
        for lang in self.languages:
            total = sum(self.counts[lang].values()) + 0.1 * language_id.BUCKETS
            sums[lang] = sum(math.log((self.counts[lang].get(g, 0) + 0.1) / total) for g in grams(w))
        open_ = [lang for lang in self.languages if self.allowed(lang, w)]
        if not open_:
            return dict.fromkeys(self.languages, 0.0)
        best = max(sums[lang] for lang in open_)
        return {lang: max(sums[lang] - best, language_id.FLOOR) if lang in open_ else language_id.WRONG_SCRIPT for lang in self.languages}

    def label(self, text):
        words = split(text)
        if not words:
            return "und", 0.0, -math.inf
        scores = [self.word(w) for w in words]

        def value(path):
            return sum(s[p] for s, p in zip(scores, path, strict=True)) - language_id.PENALTY * sum(a != b for a, b in itertools.pairwise(path))

        ranked = sorted(itertools.product(self.languages, repeat=len(words)), key=value, reverse=True)
        gap = value(ranked[0]) - value(ranked[1]) if len(ranked) > 1 else math.inf
        path, letters = ranked[0], dict.fromkeys(self.languages, 0)
        for w, lang in zip(words, path, strict=True):
            letters[lang] += len(w)
        total = {lang: sum(s[lang] for s in scores) for lang in self.languages}
        best = max(self.languages, key=lambda lang: (letters[lang], total[lang]))
        share = letters[best] / sum(letters.values())
        sure = 1 / sum(math.exp(min(t - total[best], 50)) for t in total.values())
        return best, share * (sure if len(set(path)) == 1 else 1.0), gap


def test_languages_are_those_of_the_best_of_all_paths(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet").dropna(subset=["text", "lang"]).head(120)
    rows = [(i, t[:800], lang) for i, (t, lang) in enumerate(zip(docs["text"], docs["lang"], strict=True))] + [(900, "добрый день", "ru"), (901, "спокойной ночи", "ru")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model, twin = language_id.fit(df), Twin([(t, lang) for _, t, lang in rows])
    assert model.languages == twin.languages
    r = random.Random(8)
    pieces = [w for _, t, _ in rows for w in t.split()]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randrange(1, 5))) for _ in range(60)]
    texts += ["", "12 !!", "день and night", "καλημέρα κόσμε", "冬 and day", "x" * 300, *[" ".join(t.split()[:5]) for _, t, _ in rows[:40]]]
    got = {x["doc_id"]: x for x in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    sure = 0
    for i, t in enumerate(texts):
        lang, score, gap = twin.label(t)
        if gap > 1e-6 or lang == "und":  # of equally good paths either is right
            sure += 1
            assert (got[i]["lang_pred"], got[i]["score"]) == (lang, pytest.approx(score, abs=1e-9)), t
    assert sure > 60


def test_one_script_leaves_one_candidate(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("добрый день мир", "ru"), ("good day world", "en"), ("guten tag welt", "de")] * 3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    names = lambda t: [model.languages[i] for i in language_id.candidates(model, language_id.split_words(t.encode()))]
    assert (names("день"), names("welt"), names("день welt"), names("冬")) == (["ru"], ["de", "en"], ["de", "en", "ru"], ["de", "en", "ru"])


# --- quality ------------------------------------------------------------------------------------------------------
def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 5] + rng.normal(0, 0.3, 300) > 0).astype(float)
    model = quality.train(x, y)
    got = model.score(x)
    for row, p in zip(x[:60], got[:60], strict=True):
        total = model.base + sum(model.tables[j][sum(e <= v for e in model.edges[j])] for j, v in enumerate(row))
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[sum(e <= row[a] for e in model.pair_edges[a])][sum(e <= row[b] for e in model.pair_edges[b])]
        assert p == pytest.approx(1 / (1 + math.exp(-total)))
    assert (3, 5) in model.pairs and ((got > 0.5) == y).mean() > 0.95


def gain(g, h):
    return g * g / (h + 1)


@pytest.mark.parametrize("seed", range(20))
def test_trees_take_the_best_cuts(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    g, h = rng.normal(size=n), rng.uniform(0.05, 0.25, n)

    def best(a, b):
        cuts = [(gain(g[a:c].sum(), h[a:c].sum()) + gain(g[c:b].sum(), h[c:b].sum()), c) for c in range(a + 1, b)]
        top = max(cuts, default=(0.0, b))
        return [top[1]] if cuts and top[0] > gain(g[a:b].sum(), h[a:b].sum()) + 1e-9 else []

    middle = best(0, n)
    edges = sorted({0, n, *middle, *[c for a, b in itertools.pairwise([0, *middle, n]) for c in (best(a, b) if middle else [])]})
    want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in itertools.pairwise(edges)])
    assert quality._tree(g, h) == pytest.approx(want)


@pytest.mark.parametrize("seed", range(10))
def test_pairs_take_the_best_cross(seed):
    rng = np.random.default_rng(seed)
    shape = (int(rng.integers(2, 5)), int(rng.integers(2, 5)))
    g, h = rng.normal(size=shape), rng.uniform(0.05, 0.25, shape)
    top = max(
        sum(gain(g[r, c].sum(), h[r, c].sum()) for r in (np.s_[:i], np.s_[i:]) for c in (np.s_[:j], np.s_[j:]))
        for i in range(1, shape[0]) for j in range(1, shape[1])
    )
    out, more = quality._pair_tree(g, h)
    assert more == pytest.approx(top - gain(g.sum(), h.sum()))
    assert len(np.unique(out.round(12))) <= 4


def test_boosting_lowers_the_loss_on_ten_rows():
    x = np.arange(10.0)[:, None] * np.ones(len(quality.FEATURES))
    y = np.array([0, 0, 0, 1, 0, 1, 1, 1, 1, 1.0])
    p = quality.train(x, y).score(x)
    base = (y.sum() + 1) / (len(y) + 2)
    loss = lambda q: -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()
    assert loss(p) < 0.5 * loss(np.full(10, base))


def test_quality_ranks_held_out_rows(spark, small):
    labels = pd.read_parquet(f"{small}/labels.parquet")
    got = Q.op7_quality(spark, small).toPandas()
    held = got[got["held_out"]].merge(labels, on="doc_id").dropna(subset=["quality"])
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert len(good) and len(bad)
    auc = ((good[:, None] > bad) + 0.5 * (good[:, None] == bad)).mean()
    assert auc > 0.95


def test_an_id_of_very_many_rows_is_fitted_on_once(spark, monkeypatch):
    docs = spark.range(3000).select(F.when(F.col("id") < 2900, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (2950, 0)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append((len(x), sorted(y))))
    quality.fit(docs, labels)
    assert seen == [(2, [0.0, 1.0])]


# --- others -------------------------------------------------------------------------------------------------------
def test_files_that_normalise_are_refused(spark):
    with pytest.raises(ValueError, match="normaliser"):
        token_count.count_tokens(spark.createDataFrame([(1, "A b")], "doc_id int, text string"), WORDS)


def test_hosts_by_column_and_clashing_counts(spark):
    rows = [(i, f"top\nown {i}", f"http://a.org/{i}") for i in range(5)] + [(9, "top\nown 9", "http://b.org/x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, url string").withColumns({"n_lines": F.lit("x"), "n_dropped": F.lit("y")})
    got = {r["doc_id"]: r for r in line_dedup.dedupe_lines(df, host=F.parse_url("url", F.lit("HOST")), ratio=0.5).collect()}
    assert {i: got[i]["n_dropped"] for i in got} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 9: 0} and got[0]["text"] == "own 0" and got[9]["n_lines"] == 2


def test_an_id_with_several_vectors_takes_its_largest_cosine(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0])]
    got = hilbert_ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), curves=2).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 3), (0, 4)]
    assert [r["score"] for r in got] == pytest.approx([math.sqrt(0.5), -1.0])


def test_single_precision_is_searched_as_it_is(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(120, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "vec_id bigint, embedding array<float>")
    report = {}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in hilbert_ann.search(df, report=report).collect()}
    assert report["candidates"] == 120 and report["reach"] >= 20
    wide = m.astype(float)
    for q in (0, 50, 100):
        cos = (wide * wide[q]).sum(1) / np.sqrt((wide**2).sum(1)) / np.sqrt((wide[q] ** 2).sum())
        order = [i for i in np.argsort(-cos) if i != q][:5]
        assert [got[q, k + 1][0] for k in range(5)] == order
        assert [got[q, k + 1][1] for k in range(5)] == pytest.approx(cos[order])


def test_windows_are_as_few_as_can_be(spark, small):
    got = Q.op4_packing(spark, small)
    filled, windows = got.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert windows <= -(-filled // 2048) + 2


# --- pipeline -----------------------------------------------------------------------------------------------------
def test_rows_without_an_id_are_judged_by_their_text(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").filter(F.size(F.split("text", " ")) > 12).orderBy("item_id").first()["text"]
    own = " ".join(f"word{i} of the text" for i in range(20))
    rows = [(None, f"some words before {item}", "en", "s", 1), (None, own, "en", "s", 1), (4, own, "en", "s", 1), (4, own, "en", "s", 1), (None, own + " and", "en", "s", 1), (None, "!!", None, "s", 1), (8, None, "en", "s", 1), (4, "quite another text than the one before it here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stage = dict(corpus_pipeline.STAGES)
    said = stage["language_id"](spark, docs, small)
    assert sorted(r["text"] for r in said.collect()) == sorted(r[1] for r in rows if r[1] not in (None, "!!"))
    near = stage["jaccard_join"](spark, docs, small)
    left = sorted((str(r["doc_id"]), str(r["text"])) for r in near.collect())
    assert left == sorted((str(i), str(t)) for i, t in {(i, t) for i, t, *_ in rows} if t not in (own, own + " and") or i == 4)
    clean = stage["decontaminate"](spark, docs, small)
    assert clean.count() == len(rows) - 1 and clean.filter(F.col("text").contains(item)).count() == 0


def test_only_numbers_of_a_language_go_and_packing_keeps_all_ids(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit("12 + 30 = 42")).otherwise(F.col("text")))
    said = corpus_pipeline.STAGES[0][1](spark, docs, small)
    model = language_id.fit(docs)
    want = {r["doc_id"] for r in docs.collect() if (lambda x: x[0] != "und" and x[1] >= 0.5)(language_id.label(model, (r["text"] or "").encode())[:2])}
    kept = {r["doc_id"] for r in said.collect()}
    assert kept == want and not any(i % 7 == 0 for i in kept)
    library, few = Tokenizer.from_file(WORDS), said.filter("doc_id < 60")
    pieces = corpus_pipeline.STAGES[-1][1](spark, few, small).toPandas()
    for r in few.collect():
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        mine = pieces[pieces["doc_id"] == r["doc_id"]].sort_values("start")
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine["start"], mine["length"], strict=True)] == list(mine["ids_crc32"]) and mine["length"].sum() == len(ids)


# --- licences -----------------------------------------------------------------------------------------------------
def test_licence_words_in_any_order_against_sql(spark, tmp_path):
    import duckdb

    from aerogrid.llm import license_scan

    r = random.Random(17)
    phrases = [t.text for t in license_scan.TEMPLATES] + [t.key for t in license_scan.TEMPLATES]
    words = sorted({w for p in phrases for w in p.lower().split()})
    texts = ["", None, "license " * 400 + "mit license", "MIT License MIT license", "public license general public license general"]
    for _ in range(150):
        parts = [r.choice(phrases) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(1, 6))]
        text = " ".join(parts).split()
        for _ in range(r.randrange(0, 3)):  # a word changed
            text[r.randrange(len(text))] = r.choice(words)
        texts.append(r.choice([" ", ", ", "\n"]).join(text))
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    rows.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for rare in (1, 3, 99):
        mine = license_scan.scan_licenses(df, rare=rare).toPandas().sort_values("doc_id", ignore_index=True)
        theirs = con.execute(license_scan.scan_licenses_sql()).df().sort_values("doc_id", ignore_index=True)[list(mine.columns)]
        for c in mine.columns:
            assert [None if pd.isna(x) else x for x in mine[c]] == [None if pd.isna(x) else x for x in theirs[c]], c
    assert (mine["labels"] != "").sum() > 60


def test_templates_of_ones_own(spark):
    from aerogrid.llm import license_scan

    docs = spark.createDataFrame([(1, "All rights are kept by the owner of this house"), (2, "kept by the owner")], "doc_id int, text string")
    own = spark.createDataFrame([("house", "rights are kept by the owner of this house", "kept by the owner", False)] * 2, "label string, text string, key string, base boolean")
    got = {r["doc_id"]: (r["labels"], r["score"], r["n_base"]) for r in license_scan.scan_licenses(docs, own).collect()}
    assert got == {1: ("house", 1.0, 0), 2: ("", 0.0, 0)}
    with pytest.raises(Exception, match="key phrase"):
        license_scan.scan_licenses(docs, own.withColumn("key", F.lit("absent words"))).collect()
