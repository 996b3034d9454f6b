"""License scan: an exact set-similarity join of text blocks with notices.

DataFrame functions only. Words are letters, digits and all code points from
U+0080, with A-Z lower-cased. Line ends separate words like any other gap, so a
notice may be wrapped. A notice of n words belongs to the smallest size, a power of
two, that holds 1.25 n words; the blocks of a size s are the stretches of 2 s words
of a text that start at multiples of s, so every stretch of s words lies in one.

A notice is found in a block that holds at least ``ceil(threshold * k)`` of its k
distinct words, and its telling phrase (what tells it from other licenses) word
after word. The join uses one global order of words, the rarest in the corpus first:

* prefix: a block that holds a template has one of its first
  ``k - ceil(threshold * k) + 1`` words, so only these are joined;
* length: the block has at least ``ceil(threshold * k)`` words;
* position: what follows the first common word in both suffices.

Beside the join, fixed phrases are searched as consecutive words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, materialize, prepare, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what separates words, before and after lower-casing
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

# fixed values: phrases and their labels
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# fixed values: notices of public licenses, the phrase that tells each from the others, and its label
TEMPLATES = (
    ("released under the mit license", "mit license", "mit"),
    ("licensed under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software",
     "any person obtaining a copy of this software", "mit"),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
     "distribute sublicense and or sell copies of the software", "deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache license version 2", "apache-2"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at", "apache license version 2", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
     "basis without warranties or conditions of any kind either express or implied",
     "distributed under the license is distributed on an as is basis", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3"),
    ("it under the terms of the gnu general public license as published by the free software foundation either version 3 of the "
     "license or at your option any later version",
     "gnu general public license as published by the free software foundation either version 3", "gpl-3"),
    ("it under the terms of the gnu general public license as published by the free software foundation either version 2 of the "
     "license or at your option any later version",
     "gnu general public license as published by the free software foundation either version 2", "gpl-2"),
    ("it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of "
     "the license or at your option any later version",
     "gnu lesser general public license as published by the free software foundation either version 3", "lgpl-3"),
    ("it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of "
     "the license or at your option any later version",
     "gnu affero general public license as published by the free software foundation either version 3", "agpl-3"),
    ("released under the bsd license", "bsd license", "bsd"),
    ("redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
     "redistributions of source code must retain", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify", "isc"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
     "redistribute it freely", "alter it and redistribute it freely", "zlib"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license", "any person or organization obtaining a copy", "boost"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software", "unlicense"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc by 4", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     "attribution noncommercial 4", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license",
     "attribution sharealike 4", "cc-by-sa"),
    ("has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights",
     "cc0"),
)
THRESHOLD = 0.8


def words(text: Column) -> Column:
    """Words of a text in order."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), f"{GAP}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building each one anew: separators are counted, case does not matter."""
    parts = F.split(text, f"{GAP}+")
    edge = lambda i: F.when(F.element_at(parts, i) == "", 1).otherwise(0)
    return F.greatest(F.size(parts) - edge(1) - edge(-1), F.lit(0)).cast("long")


def any_word(text: Column, found: list[str]) -> Column:
    """Whether a text holds one of some ASCII words; Java folds case for ASCII only."""
    letter = GAP.replace("[", "[^")
    return text.rlike(f"(?i)(?<!{letter})(?:{'|'.join(sorted(found))})(?!{letter})")


def block_size(n: int) -> int:
    """Smallest power of two of at least 1.25 n."""
    return 1 << (math.ceil(1.25 * n) - 1).bit_length()


def template_table(templates=TEMPLATES, threshold: float = THRESHOLD, frequency: dict[str, int] | None = None) -> list[tuple]:
    """(id, label, words in global order, least overlap, prefix, telling phrase, block size) of every notice."""
    frequency = frequency or {}
    rows = []
    for i, (notice, telling, label) in enumerate(templates):
        ordered = sorted(set(notice.split()), key=lambda w: (frequency.get(w, 0), w))
        least = math.ceil(threshold * len(ordered))
        rows.append((i, label, ordered, least, ordered[:len(ordered) - least + 1], f" {telling} ", block_size(len(notice.split()))))
    return rows


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents of the whole corpus that hold each word of the templates (a fixed number of words)."""
    wanted = F.array(*[F.lit(w) for w in vocabulary])
    held = F.array_intersect(wanted, F.split(F.lower("text"), f"{GAP}+"))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return {r["w"]: r["n"] for r in rows}


def _places(phrase: str) -> Column:
    """Start positions of a phrase in the array column ``w``."""
    parts = phrase.split()
    last = F.size("w") - len(parts)

    def starts(i):
        test = F.get("w", i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            test = test & (F.get("w", i + j) == p)
        return test
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), starts)).otherwise(F.array().cast("array<int>"))


def _blocks(size: int, prefixes: list[str]) -> Column:
    """Blocks of one size of the word array ``w`` that hold one of ``prefixes``: (size, words in order)."""
    last = F.greatest(F.ceil(F.size("w") / size).cast("int") - 1, F.lit(0))
    wanted = F.array(*[F.lit(w) for w in prefixes])
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.lit(size).alias("size"), F.slice("w", i * size + 1, 2 * size).alias("o")))
    return F.filter(each, lambda x: F.arrays_overlap(x["o"], wanted))


def block_matches(spark: SparkSession, texts: DataFrame, table: list[tuple]) -> DataFrame:
    """(doc_id, h, own, containment): the join of the blocks of ``texts`` with the notices."""
    templates = spark.createDataFrame(
        table, "template int, label string, t array<string>, least int, prefix array<string>, telling string, size int")
    entries = F.broadcast(templates.withColumn("word", F.explode("prefix")))             # fixed size
    prefixes = {size: sorted({w for r in table if r[6] == size for w in r[4]}) for size in sorted({r[6] for r in table})}
    every = F.array(*[F.lit(w) for w in sorted({w for p in prefixes.values() for w in p})])
    blocks = (texts.select("doc_id", "h", words(F.col("text")).alias("w"))
              .select("doc_id", "h", F.explode(F.concat(*[_blocks(s, p) for s, p in prefixes.items()])).alias("x"))
              .select("doc_id", "h", "x.size", "x.o", F.array_distinct("x.o").alias("b"))
              .select("doc_id", "h", "size", "o", "b", F.explode(F.array_intersect("b", every)).alias("word")))
    common = F.array_intersect("t", "b")                 # keeps the global order of t
    after_first = F.size("t") - F.array_position("t", F.col("word"))
    found = (blocks.join(entries, ["size", "word"])
             .filter(F.size("b") >= F.col("least"))
             .filter(F.element_at(F.array_intersect("prefix", "b"), 1) == F.col("word"))   # each pair once, at its first word
             .filter(1 + F.least(after_first, F.size("b") - 1) >= F.col("least"))
             .withColumn("overlap", F.size(common)).filter("overlap >= least")
             .filter(F.contains(F.concat(F.lit(" "), F.array_join("o", " "), F.lit(" ")), F.col("telling"))))
    return (found.groupBy("doc_id", "h")
            .agg(F.collect_set("label").alias("own"), F.max(F.col("overlap") / F.size("t")).alias("containment")))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES,
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    ``n_base`` counts the places of all phrases, ``first_word`` and
    ``last_word`` are the smallest and largest start (null without one).
    ``score`` is 1 for a phrase, else the largest containment of a found
    notice, else 0. Long texts are read whole, in blocks. A null or empty text has no words and no labels (empty
    strings). Rows that repeat an id are told apart by a hash of the text;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = keyed_text(df, id_col, text_col)
    vocabulary = sorted({w for fixed in (*[t[0] for t in templates], *[p[0] for p in phrases]) for w in fixed.split()})
    frequency = word_frequencies(docs, vocabulary)
    table = template_table(templates, threshold, frequency)
    told = [t[1] for t in templates] + [p[0] for p in phrases]
    rare = {min(p.split(), key=lambda w: (frequency.get(w, 0), w)) for p in told}
    # a text without any of these words has neither the telling phrase of a notice nor a phrase
    scanned = materialize(docs.select(
        "doc_id", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("n_words"),
        F.when(any_word(F.col("text"), list(rare)), F.col("text")).alias("text")))
    texts = scanned.filter("text is not null").select("doc_id", "h", "text").distinct()

    places = [_places(p) for p, _ in phrases]
    hits = [F.when(F.size(x) > 0, F.lit(label)) for x, (_, label) in zip(places, phrases)]
    base = (texts.select("doc_id", "h", words(F.col("text")).alias("w"))
            .select("doc_id", "h", F.concat(*places).alias("at"), F.array_compact(F.array(*hits)).alias("base"))
            .select("doc_id", "h", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"),
                    F.array_max("at").cast("long").alias("last_word"), F.array_distinct("base").alias("base")))
    matches = block_matches(spark, texts, table).withColumnsRenamed({"doc_id": "m_id", "h": "m_h"})
    found = materialize(
        base.join(matches, base["doc_id"].eqNullSafe(F.col("m_id")) & (base["h"] == F.col("m_h")), "left")
        .filter("n_base > 0 or own is not null")
        .select(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), "n_base", "first_word", "last_word", "base",
                F.coalesce("own", F.array().cast("array<string>")).alias("own"), "containment"))
    joined = F.array_join(F.array_sort(F.coalesce(F.array_union("base", "own"), F.array().cast("array<string>"))), ",")
    return (scanned.join(small(found), scanned["doc_id"].eqNullSafe(F.col("f_id")) & (scanned["h"] == F.col("f_h")), "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                    F.array_join(F.array_sort(F.coalesce("base", F.array().cast("array<string>"))), ",").alias("base_labels"),
                    joined.alias("labels"),
                    F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score")))
