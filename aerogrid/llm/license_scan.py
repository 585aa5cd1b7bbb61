"""Licence scan by a positional rare-token index, in DataFrame functions alone.

Templates are a table of texts, each with a key phrase that must stand as it is. One pass over the documents lists the places of
all words that templates use; their document frequencies rank the words of each key phrase. A file is looked up by the rarest
word of each phrase; of the phrases found so, the words that this file holds least often (ties: the rarest in all files) each
say where the template would start, and where they all say the same is a candidate. Candidates are verified from the same list of places: the whole key phrase, then the share of
the template's words that stand at their relative places.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, lower_ascii, materialise, small


class Template(NamedTuple):
    label: str
    text: str
    key: str
    base: bool = False


#: Fixed values. The key phrase must stand as it is; base templates are nothing but their key phrase.
TEMPLATES = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("mpl", "mozilla public license version 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    Template("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software.""",
        "permission is hereby granted free of charge",
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
        "copy modify and or distribute this software",
    ),
    Template(
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
        "apache license version 2",
    ),
    Template(
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        "gnu general public license as published by the free software foundation either version 3",
    ),
)

#: The least share of a template's words that must be in place for its label, and words of a key phrase whose places are intersected.
MIN_SHARE, RARE = 0.6, 3


def _words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"({WORD})"), F.lit(1))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """label, text, key, base of each template."""
    quoted = lambda s: "'" + re.sub(r"[\\']", " ", s) + "'"
    rows = ", ".join(f"({quoted(t.label)}, {quoted(t.text)}, {quoted(t.key)}, {t.base})" for t in templates)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(label, text, key, base)")


def posted(templates: DataFrame) -> DataFrame:
    """template, label, base, size, key_size, at (place in the template), word, in_key: a row for each word of each template."""
    t = templates.select("label", "base", _words(F.col("text")).alias("words"), _words(F.col("key")).alias("key"))
    t = t.withColumn("template", F.xxhash64("label", "words", "key")).dropDuplicates(["template"])
    places = F.filter(F.sequence(F.lit(0), F.size("words") - F.size("key")), lambda i: F.slice("words", i + 1, F.size("key")) == F.col("key"))
    t = t.withColumn("key_at", F.get(places, F.lit(0)))
    t = t.filter(F.when(F.col("key_at").isNull(), F.raise_error(F.concat(F.lit("a key phrase isn't in its template: "), "label"))).otherwise(True))
    each = t.select("template", "label", "base", F.size("words").alias("size"), F.size("key").alias("key_size"), "key_at", F.posexplode("words").alias("at", "word"))
    return each.withColumn("in_key", (F.col("at") >= F.col("key_at")) & (F.col("at") < F.col("key_at") + F.col("key_size"))).drop("key_at")


def scan_licenses(
    docs: DataFrame, templates: DataFrame | None = None, min_share: float = MIN_SHARE, rare: int = RARE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest start (null
    without any). labels holds every template of which a place has its key phrase and min_share of its words;
    score is the largest share found, 0 without any. Null and empty texts have no words and no labels ('').
    Repeated rows give a row each, null ids stay null, other columns are ignored; an empty table gives no rows.
    Ties in IDF go to the word further left in the phrase; a template that is listed twice counts once.

    templates: a table (label, text, key, base); the plan is the same for any number of them. Texts are split once. What is
    written and shuffled is a row for each place of a word that some template uses, and for each document.
    """
    spark = docs.sparkSession
    index = materialise(posted(template_table(spark) if templates is None else templates))
    vocabulary = index.select("word").union(spark.sql("SELECT '' AS word")).distinct()

    # one row for each place of a template's word; place -1, of an empty word, stands for the document itself
    words = docs.select(F.col(id_col).alias("doc_id"), _words(F.col(text_col).cast("string")).alias("words"), F.monotonically_increasing_id().alias("row"))
    each = words.select("row", "doc_id", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("place", "word"))
    each = each.join(small(vocabulary, F.octet_length("word")), "word")
    own = F.col("place") == 0
    places = materialise(each.select("row", "word", (F.col("place") - 1).alias("place"), F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n")).alias("n_words")))
    rows, hits = places.filter("place = -1").select("row", "doc_id", "n_words"), places.filter("place >= 0").select("row", "word", "place")

    # the words of each key phrase, the rarest first: that of the highest log(N / df), whatever N
    key_words = small(index.filter("in_key").select("word").distinct(), F.octet_length("word"))
    frequency = hits.join(key_words, "word", "left_semi").groupBy("word", "row").agg(F.lit(1).alias("one")).groupBy("word").agg(F.count("one").alias("df"))
    by_idf = F.row_number().over(Window.partitionBy("template").orderBy(F.coalesce("df", F.lit(0)), "at"))
    keys = index.filter("in_key").join(small(frequency, F.octet_length("word")), "word", "left").withColumn("by_idf", by_idf)
    keys = small(materialise(keys.select("template", "word", "at", "by_idf", "key_size")), F.octet_length("word"))

    # a file is looked up by the rarest word of each template; what it holds of such a template's key phrase goes on
    asked = hits.join(keys.filter("by_idf = 1").select("template", "word"), "word").select("row", "template").distinct()
    asked = materialise(asked)
    mine = hits.join(small(asked.select("row").distinct()), "row", "left_semi").join(keys, "word").join(small(asked), ["row", "template"])
    mine = materialise(mine.select("row", "template", "at", "place", "by_idf", "key_size"))
    # of the words of the phrase, those that this file holds least often, and of these the rarest in all files, say where it may start
    held = mine.groupBy("row", "template", "at").agg(F.count(F.lit(1)).alias("n"), F.first("by_idf").alias("by_idf"), F.first("key_size").alias("key_size"))
    of_phrase = Window.partitionBy("row", "template")
    held = held.withColumns({"nth": F.row_number().over(of_phrase.orderBy("n", "by_idf")), "words": F.count(F.lit(1)).over(of_phrase)})
    chosen = held.filter((F.col("words") == F.col("key_size")) & (F.col("nth") <= rare)).select("row", "template", "at", F.least("key_size", F.lit(rare)).alias("wanted"))
    starts = mine.join(chosen, ["row", "template", "at"]).groupBy("row", "template", (F.col("place") - F.col("at")).alias("start"))
    starts = starts.agg(F.count(F.lit(1)).alias("n"), F.first("wanted").alias("wanted"))
    starts = materialise(starts.filter(F.col("n") == F.col("wanted")).select("row", "template", "start"))

    # verification: what should stand where, and does
    due = starts.join(small(index, F.octet_length("word") + 32), "template")
    due = due.select("row", "template", "start", "label", "base", "size", "key_size", "in_key", "word", (F.col("start") + F.col("at")).alias("place"))
    there = hits.join(small(starts.select("row").distinct()), "row", "left_semi")
    found = due.join(there, ["row", "place", "word"]).groupBy("row", "template", "start").agg(
        *[F.first(c).alias(c) for c in ("label", "base", "size", "key_size")], F.count_if("in_key").alias("in_key"), F.count(F.lit(1)).alias("n")
    )
    share = F.col("n") / F.col("size").cast("double")
    found = found.filter(F.col("in_key") == F.col("key_size")).withColumn("share", share).filter((F.col("share") >= min_share) | F.col("base"))

    base, start = F.col("base"), F.col("start").cast("long")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    of_row = found.groupBy("row").agg(
        F.count_if(base).cast("long").alias("n_base"), F.min(F.when(base, start)).alias("first_word"), F.max(F.when(base, start)).alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.max("share").alias("score"),
    )
    of_row = materialise(of_row)
    discard(asked, mine, starts)
    out = rows.join(small(of_row, F.octet_length("labels") + 64), "row", "left")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def scan_licenses_sql(templates=TEMPLATES, min_share: float = MIN_SHARE) -> str:
    """The same rows by trying every place where a key phrase's first word stands, as DuckDB SQL."""
    heads, words = [], []
    for k, t in enumerate(templates):
        ws, key = (re.findall(r"[a-z0-9]+", s.lower()) for s in (t.text, t.key))
        at = next(i for i in range(len(ws)) if ws[i : i + len(key)] == key)
        heads.append(f"({k}, '{t.label}', {t.base}, {len(ws)}, {at}, {len(key)})")
        words += [f"({k}, {i}, '{w}')" for i, w in enumerate(ws)]
    return f"""
    WITH t(template, label, base, size, key_at, key_size) AS (VALUES {', '.join(heads)}),
    tw(template, place, word) AS (VALUES {', '.join(words)}),
    split AS (
      SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
      FROM documents
    ), numbered AS MATERIALIZED (SELECT * FROM split),
    w AS MATERIALIZED (SELECT * FROM (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS place FROM numbered) WHERE word IN (SELECT word FROM tw)),
    tried AS (SELECT w.rid, t.template, w.place - t.key_at AS start FROM w JOIN tw ON tw.word = w.word JOIN t ON t.template = tw.template AND t.key_at = tw.place),
    found AS (
      SELECT d.rid, d.template, d.start, count(*) AS n, count(*) FILTER (WHERE tw.place >= t.key_at AND tw.place < t.key_at + t.key_size) AS in_key
      FROM tried d JOIN t ON t.template = d.template JOIN tw ON tw.template = d.template JOIN w ON w.rid = d.rid AND w.place = d.start + tw.place AND w.word = tw.word
      GROUP BY d.rid, d.template, d.start
    ), stands AS (SELECT f.rid, f.start, t.label, t.base, f.n / t.size::DOUBLE AS share FROM found f JOIN t USING (template) WHERE f.in_key = t.key_size AND (t.base OR f.n / t.size::DOUBLE >= {min_share})),
    of_row AS (
      SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
        coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM stands GROUP BY rid
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
    FROM numbered LEFT JOIN of_row USING (rid)"""
