"""The URL filter, the lexical search and the prefix trie: against plain Python, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from aerogrid.llm import lexical_search, prefix_trie, queries, url_filter
from aerogrid.llm.prefix_trie import Direct, Indexed, Radix, Sorted, emit, insert, shared_length

URLS = [
    None, "", "no place at all", "https://", "http://Example.ORG", "http://EXAMPLE.org/Es/", "http://example.org/es/casino", "http://a.b.example.org/es/",
    "http://notexample.org/es/1", "http://x.example.org/en/12?es", "http://com/fr/", "http://a.com/fr/porn", "http://a.com/de/", "http://a.com?/fr/", "http://a.com#://b.org/",
    "http://free-bets.net/", "http://free.net/free", "http://freebets.net/", "http://net/a?x=casino", "http://net/casinos", "http://net/\nadult\nspam", "ftp://é.net/sexy_girls", "x" * 50_000 + " xxx",
]


def url_rows(spark, urls):
    df = spark.createDataFrame([(None if i == 3 else i, u) for i, u in enumerate(urls)], "page_id long, url string")
    return df.withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "score", "html")})


def judged(url):
    """host, path, rule and verdict, rule by rule and term by term."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in url_filter.RULES if ("." + low).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in url)
    pieces = " " + re.sub("[^a-z0-9]", " ", text) + " "
    strict, soft = (sum(f" {t} " in pieces for t in terms) for terms in (url_filter.STRICT, url_filter.SOFT))
    found = max(fits, default=None)
    return low, path, found and found[1], found[2] if found else "block" if strict or soft >= 2 else "allow", strict, soft


def test_urls(spark):
    df = url_rows(spark, URLS + URLS[5:8])
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(URLS) + 3
    assert sorted(map(repr, (tuple(r)[1:7] for r in got))) == sorted(repr(judged(u)) for u in URLS + URLS[5:8])
    assert [r["page_id"] for r in got].count(None) == 1
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_urls_of_the_table(spark, small):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.op11_url_filter(spark, small).collect()
    assert {r["page_id"]: tuple(r)[1:7] for r in got} == {i: judged(u) for i, u in urls.items()} and len(got) == len(urls)


def test_rules_of_ones_own(spark):
    df = spark.createDataFrame([(1, "http://a.b.c/x/y"), (2, "http://b.c/x"), (3, "http://c"), (4, "http://d/")], "page_id long, url string")
    rules = [("C", "block"), ("b.c/x", "allow"), ("a.b.c/", "block"), ("c/x/y", "block")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules, strict=(), soft=()).collect()}
    assert got == {1: ("a.b.c/", "block"), 2: ("b.c/x", "allow"), 3: ("C", "block"), 4: (None, "allow")}
    with pytest.raises(ValueError):
        url_filter.filter_urls(df, [("a/", "maybe")])


def terms(text):
    return [w.translate(url_filter._LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k):
    """All scores, in Python's own whole numbers."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, ws) for i, ws in held if ws]
    n_docs, length, df = len(held), sum(len(ws) for _, ws in held), Counter(w for _, ws in held for w in set(ws))
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, ws in wanted.items():
        scores = []
        for i, words in held:
            tf, m = Counter(words), 100 - 90 + 90 * len(words) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in ws if tf[w])
            scores += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_search(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["Über", "été", "A1"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for i in range(300)]
    docs += [(300 + i, "w1 w2 w3") for i in range(40)] + [(7, docs[7][1]), (None, "w1 w2 w3 w4"), (None, None), (900, None), (901, ""), (902, " -- "), (903, "w5 " * 50_000)]
    items = [(i, " ".join(r.choice(words) for _ in range(6))) for i in range(20)] + [(3, "W1, w2-W3"), (None, "w7"), (50, None), (51, "never met"), (52, "?")]
    # in the order in which the best come last, over several partitions
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({c: F.lit("x") for c in ("n", "rank", "score", "item_id", "terms")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("term", "doc_id")})
    want = ranked(docs, items, 10)
    for bound in (1_000_000, 30):
        got = lexical_search.search(d, q, block_postings=bound)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert lexical_search.search(d.limit(0), q).count() == lexical_search.search(d, q.limit(0)).count() == 0


def test_heaps_keep_the_smallest_ids_of_ties():
    import numpy as np

    heaps = lexical_search.Heaps(1, 3)
    for ids in ([9, 8, 7, 6, 5], [1, 20], [4]):
        heaps.add(np.full((len(ids), 1), 5), np.array(ids), np.zeros(len(ids), bool))
    assert sorted(-i for _, _, i in heaps.heaps[0]) == [1, 4, 5]


def rebuilt(rows):
    """Conversations with the openings that they share; turns are (role, text), in order of their numbers and ids."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tid = f"{len(text):08x}" + hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()[:24]
            convs[c].append((turn is not None, turn or 0, tid, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]  # remainders have the sign of c, as in SQL
    return out


def trie(convs):
    """All prefixes with their members; sums by looking at all pairs."""
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    rows = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in members if x}
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(node))
        rows.append((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(x[:-1] == node for x in below if x), sum(x not in parents for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def odd_conversations(seed, n=400):
    r, rows = random.Random(seed), []
    for c in range(n):
        c = c * 7 % 1000
        for t in range(r.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", r.choice(["a", "b", "é\U0001d504", "long " * 30])))
    rows += [(2000 + i, t, "user", f"turn {t}") for i in range(60) for t in range(4)]  # copies
    rows += [(3000, t, "user", "again") for t in range(300)] + [(3001, t, "user", "again") for t in range(299)]
    rows += [(None, 0, "user", "nobody's"), (4001, None, "user", "first"), (4001, 0, None, "then"), (4001, 0, "user", None), (4001, 0, "user", None), (-250, 1, "user", "below zero"), (-200, 1, "user", "a")]
    return rows


@pytest.mark.parametrize("tree_keys", [1, 2, 7, 20_000])
def test_trie(spark, tree_keys):
    rows = odd_conversations(tree_keys)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("key", "tid", "h", "of", "part", "n", "shared", "node_id")})
    got = prefix_trie.prefix_trie(prefix_trie.share_openings(prefix_trie.turns_of(df)), parts=3, tree_keys=tree_keys).drop("node_id", "parent_id")
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == trie(rebuilt(rows))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.share_openings(prefix_trie.turns_of(none))).count() == 0
    # a conversation whose opening belongs to one that isn't there, and which has no more turns than that
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    one = spark.createDataFrame([(c, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(prefix_trie.share_openings(prefix_trie.turns_of(one))).drop("node_id", "parent_id").collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_pieces_of_a_crowded_end(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([b"a"] * 8 + [b"b"]), pa.array([*range(8), 5], pa.int64())], ["key", "conv_id"])
    pieces = list(prefix_trie._pieces(iter([batch.slice(0, 4), batch.slice(4)])))
    assert pieces[-1].column(3).to_pylist() == ["0,1,2", "3,4,5", "6,7", "5"]
    out = list(prefix_trie._digests(iter(pieces)))[-1].to_pylist()
    assert [(r["key"], r["first"], r["n"]) for r in out] == [(b"a", 0, 8), (b"b", 5, 1)]
    assert out[0]["sha"] == hashlib.sha256(b"0,1,2,3,4,5,6,7").hexdigest()


def test_layouts_grow_and_keep_their_order():
    r = random.Random(1)
    for n, kind in ((4, Sorted), (16, Sorted), (17, Indexed), (48, Indexed), (49, Direct), (256, Direct)):
        ways, picked = Sorted(), r.sample(range(256), n)
        for b in picked:
            ways = ways.put(b, b + 1)
        assert type(ways) is kind and [b for b, _ in ways.items()] == sorted(picked)
        assert all(ways.get(b) == (b + 1 if b in picked else None) for b in range(256))


def test_radix_tree_against_all_prefixes():
    r = random.Random(5)
    for _ in range(30):
        ids = [bytes([0, 0, 0, r.randrange(9)]) + r.choice([b"\0" * 11, b"same bytes!"]) + bytes([r.randrange(3) if r.random() < 0.5 else r.randrange(256)]) for _ in range(r.choice([3, 80]))]
        keys = sorted({b"".join(r.choice(ids) for _ in range(r.randrange(6))) for _ in range(120)})
        root = Radix(b"")
        for i, k in r.sample(list(enumerate(keys)), len(keys)):
            insert(root, k, (1, i, "sha"))
        got = emit(root, set(), set())
        want = Counter(k[:at] for k in keys for at in range(0, len(k) + 1, 16))
        assert len(got) == len(want) and {row[0]: row[5] for row in got} == {hashlib.md5(p).digest(): n for p, n in want.items()}
        assert all((row[2] == 0) == (row[1] is None) == (row[4] is None) for row in got)


def test_shared_length():
    for a, b, n in ((b"", b"a", 0), (b"abc", b"abc", 3), (b"abc", b"abd", 2), (b"xbc", b"abc", 0), (b"ab", b"abc", 2)):
        assert shared_length(a, b) == n
