"""License scan by diagonal voting over word k-grams.

Rolling hashes of all word k-grams of every document are tested against a
bitmap of the templates' k-grams (of fixed size), and the k-grams that pass
are joined with the template positions by their text.  A hit votes for the
diagonal document position minus template position.  Neighbouring diagonals
(a word too many or too few) are merged, and a merged span is verified: it
must hold enough of the template's distinct k-grams in about its length.
Phrases, the base labels, must hold all of theirs on one diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, id_and_text
from .grams import Words, filter_test, hash_filter


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool = False  # found wherever all its words stand consecutively


PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
# Usual wording of public licence notices.
NOTICES = (
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files the software to deal in the software without restriction"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the "
                       "license at"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                    "general public license as published by the free software foundation"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial "
                    "portions of the software"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
                       "distributed on an as is basis without warranties or conditions of any kind"),
    Template("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
                    "general public license for more details"),
    Template("lgpl", "gnu lesser general public license"),
    Template("lgpl", "gnu library general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("bsd", "bsd 2 clause license"),
    Template("bsd", "bsd 3 clause license"),
    Template("bsd", "2 clause bsd license"),
    Template("bsd", "3 clause bsd license"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                    "promote products derived from this software without specific prior written permission"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                    "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors "
                     "be held liable for any damages arising from the use of this software"),
    Template("boost", "boost software license version 1 0"),
    Template("mpl", "mozilla public license version 2 0"),
    Template("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("epl", "eclipse public license"),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in "
                          "source code form or as a compiled binary for any purpose"),
    Template("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring "
                    "rights to this software to the public domain worldwide"),
)
# Identifiers of the public SPDX list, by label; a tag names one after "SPDX-License-Identifier:".
SPDX = {
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "apache": ("Apache-2.0",),
    "boost": ("BSL-1.0",),
    "bsd": ("0BSD", "BSD-2-Clause", "BSD-3-Clause"),
    "cc-by": ("CC-BY-4.0",),
    "cc-by-nc": ("CC-BY-NC-4.0",),
    "cc-by-sa": ("CC-BY-SA-4.0",),
    "cc0": ("CC0-1.0",),
    "epl": ("EPL-2.0",),
    "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "isc": ("ISC",),
    "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "mit": ("MIT",),
    "mpl": ("MPL-2.0",),
    "unlicense": ("Unlicense",),
    "zlib": ("Zlib",),
}
TAGS = tuple(Template(label, f"spdx-license-identifier: {name.lower()}") for label, names in SPDX.items() for name in names)
K_PHRASE, K_NOTICE = 2, 3
MERGE = 2         # diagonals this far apart belong to one span
COVERAGE = 0.8    # share of a notice's k-grams that a verified span holds
STRETCH = 1.5     # a verified span is at most this many times as long as its notice


def template_grams(templates: Sequence[Template]) -> list[tuple]:
    """(template, label, phrase, n_grams, at, k, gram, hash) per k-gram of each template."""
    rows = []
    for number, t in enumerate(templates):
        words = Words(t.text.encode())
        k = min(K_PHRASE if t.phrase else K_NOTICE, len(words))
        if k:
            grams, hashes = words.grams(k), words.rolling(k).view(np.int64).tolist()
            rows += [(number, t.label, t.phrase, len(grams), at, k, gram, h)
                     for at, (gram, h) in enumerate(zip(grams, hashes))]
    return rows


def _scan(docs: DataFrame, orders: list[int], bitmap: bytes) -> DataFrame:
    """(doc_id, n_words, hits) per row; hits are the k-grams that may belong to a template."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2 MB always

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_match = filter_test(shared.value)
        for batch in batches:
            counts, ends, places, grams = [], [0], [], []
            for text in batch.column("text").to_pylist():
                words = Words(text)
                counts.append(len(words))
                for n in orders:
                    at = np.flatnonzero(may_match(words.rolling(n)))
                    places.append(at)
                    grams += [words.gram(i, n) for i in at.tolist()]
                ends.append(len(grams))
            hits = pa.StructArray.from_arrays([pa.array(np.concatenate(places) if places else [], pa.int64()),
                                               pa.array(grams, pa.binary())], names=["place", "gram"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)],
                names=["doc_id", "n_words", "hits"])

    return docs.mapInArrow(run, "doc_id long, n_words long, hits array<struct<place: long, gram: binary>>")


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES + TAGS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans per row.

    n_base counts all places of phrases, first_word and last_word are their
    smallest and largest start; spans are the verified (label, first, last) in
    words; score is the largest verified or partial share of a template found.
    A null text is empty: no words, no places, empty labels, score 0.  Null
    and repeated ids are kept row by row; an empty table or template list is
    allowed; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    rows = template_grams(templates)
    known = spark.createDataFrame(
        [r[:-1] for r in rows], "template int, label string, phrase boolean, n_grams int, at int, k int, gram binary")
    bitmap = hash_filter(np.array([r[-1] for r in rows], np.int64).view(np.uint64))
    scanned = cut_lineage(_scan(id_and_text(docs, id_col, text_col), sorted({r[5] for r in rows}), bitmap))
    scanned = scanned.withColumn("row", F.monotonically_increasing_id())  # over written rows: stable
    votes = (scanned.select("row", F.explode("hits").alias("hit")).select("row", "hit.place", "hit.gram")
             .join(known, "gram")  # a gram's number of blanks fixes k
             .withColumn("diagonal", F.col("place") - F.col("at")))
    lines = votes.groupBy("row", "template", "label", "phrase", "n_grams", "k", "diagonal").agg(
        F.collect_set("at").alias("seen"), F.min("place").alias("first"),  # at most the template's k-grams
        (F.max("place") + F.first("k") - 1).alias("last"))
    phrases = lines.where("phrase and size(seen) = n_grams").select(
        "row", "label", "phrase", F.lit(1.0).alias("share"), F.lit(True).alias("found"), "first", "last")
    by_template = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(by_template)
    spans = (lines.where("not phrase")
             .withColumn("starts", F.coalesce((step > MERGE).cast("int"), F.lit(1)))
             .withColumn("span", F.sum("starts").over(by_template))
             .groupBy("row", "template", "label", "phrase", "n_grams", "k", "span")
             .agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("first").alias("first"),
                  F.max("last").alias("last"))
             .withColumn("share", F.size("seen") / F.col("n_grams"))
             .withColumn("found", (F.col("share") >= COVERAGE)
                         & (F.col("last") - F.col("first") + 1 <= STRETCH * (F.col("n_grams") + F.col("k") - 1)))
             .select("row", "label", "phrase", "share", "found", "first", "last"))
    base = F.col("phrase") & F.col("found")
    per_row = phrases.unionByName(spans).groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("found"), F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("first", "last", "label")))).alias("spans"))
    return scanned.drop("hits").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
