"""URL filter: host and path rules first, then a weighted vocabulary that an Aho-Corasick automaton finds in one reading of the URL."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, map_batches, struct

#: (host/path, verdict) of rules that hold for a host, its subdomains, and paths that begin so.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Terms of which one rejects a URL, and terms of which SOFT_HITS different ones do.
STRICT = ("casino", "hentai", "nsfw", "porn", "porno", "poker", "viagra", "cialis", "warez", "xxx", "phishing", "malware")
SOFT = (
    "adult", "ads", "bet", "bets", "betting", "cheap", "clickbait", "crack", "dating", "escort", "farm", "free", "girls", "hot", "keygen", "loan", "lottery",
    "nude", "pharmacy", "pills", "promo", "serial", "sex", "sexy", "slots", "spam", "torrent", "track", "tracker", "tracking", "win", "x",
)
SOFT_HITS = 2

_PLACE = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans(UPPER, LOWER)
_INNER = frozenset(LOWER + "0123456789")

Rules = Mapping[str, Sequence[tuple[str, str, str]]]


def split_rules(rules: Sequence[tuple[str, str]]) -> Rules:
    """Rules by host: (path, rule, verdict). A rule without a slash holds for all paths; the last of equal rules counts."""
    out: dict[str, dict[str, tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"no verdict {verdict}")
        host, slash, path = rule.partition("/")
        out.setdefault(host.translate(_LOWER), {})[slash + path] = (slash + path, rule, verdict)
    return {host: list(paths.values()) for host, paths in out.items()}


def place(url: str | None) -> tuple[str, str]:
    """Host (lower-cased) and path; both empty without "://"."""
    found = _PLACE.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def matching_rule(by_host: Rules, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits, and its verdict; of equally long ones that with the longer host."""
    best = None
    while host:
        for start, rule, verdict in by_host.get(host, ()):
            if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        host = host.partition(".")[2]
    return best


def automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for weight, terms in ((0, soft), (1, strict)):
        for term in terms:
            found.add_word(term.translate(_LOWER), (len(term), term.translate(_LOWER), weight))
    found.make_automaton()
    return found


def hits(terms, url: str) -> tuple[int, int]:
    """How many different strict and soft terms stand in the URL, with neither a letter nor a digit of ASCII beside them."""
    text, seen = url.translate(_LOWER), {}
    for end, (size, term, weight) in terms.iter(text):
        before, after = end - size, end + 1
        if (before < 0 or text[before] not in _INNER) and (after == len(text) or text[after] not in _INNER):
            seen[term] = weight
    n_strict = sum(seen.values())
    return n_strict, len(seen) - n_strict


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
    soft_hits: int = SOFT_HITS, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, score: a row for each row of pages.

    Where a rule fits, the longest one decides. Elsewhere a URL is blocked if it holds a strict term or soft_hits different soft ones; score is
    the weight of its terms, at most 1: a strict term weighs 1, a soft one 1 / soft_hits. A term counts where it stands alone between
    characters that are no ASCII letters or digits, anywhere in the URL; a term of both lists is strict. A null URL, or one
    without "://", has an empty host and path, and no rule but those with an empty host; null and empty URLs hold no term and are allowed. Repeated rows
    are judged each, rows without an id too; other columns don't matter. An empty table stays empty.

    Rules and terms travel with the code and are read once a task; pages are judged where they lie, without a shuffle.
    """
    by_host = split_rules(rules)
    if soft_hits < 1 or not all((*strict, *soft)):
        raise ValueError("terms must not be empty, soft_hits must be 1 at least")
    kind = pages.schema[id_col].dataType

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft) if strict or soft else None
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = place(url)
                rule = matching_rule(by_host, host, path)
                n_strict, n_soft = hits(terms, url) if terms and url else (0, 0)
                reject = n_strict > 0 or n_soft >= soft_hits
                verdict = rule[1] if rule else "block" if reject else "allow"
                rows.append((host, path, rule and rule[0], verdict, n_strict, n_soft, 1.0 if n_strict else min(1.0, n_soft / soft_hits)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "score"],
            )

    out = struct(
        ("page_id", kind), ("host", T.StringType()), ("path", T.StringType()), ("rule", T.StringType()), ("verdict", T.StringType()),
        ("n_strict", T.LongType()), ("n_soft", T.LongType()), ("score", T.DoubleType()),
    )
    return map_batches(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), judge, out)


def filter_urls_sql(
    rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS
) -> str:
    """The same rows of the table pages, as DuckDB SQL: a pattern for each term, the rules from the longest on."""
    flat = sorted(((h, *p) for h, ps in split_rules(rules).items() for p in ps), key=lambda r: (-len(r[2]), -len(r[0])))

    def case(at: int) -> str:
        fits = "".join(f" WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{r[at]}'" for r in flat)
        return f"CASE{fits} END"

    def count(terms: Sequence[str]) -> str:
        return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){re.escape(t)}($|[^a-z0-9])')::BIGINT" for t in terms) or "0::BIGINT"

    return f"""
    WITH parts AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low
      FROM pages
    ), found AS (
      SELECT page_id, host, path, {case(2)} AS rule, {case(3)} AS ruled, {count(strict)} AS n_strict, {count([t for t in soft if t not in strict])} AS n_soft FROM parts
    )
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN n_strict > 0 OR n_soft >= {soft_hits} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft,
      CASE WHEN n_strict > 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, n_soft::DOUBLE / {soft_hits}) END AS score
    FROM found"""
