"""License notices in documents by diagonal voting.

All rolling word k-gram hashes of the texts are joined by Spark with the gram
positions of license templates.  Each match votes for its diagonal (position in
the text less position in the template); votes are aggregated by document,
template and diagonal, neighbouring diagonals are merged (words put in or left
out shift a diagonal), and candidate spans with enough votes are verified word
by word: the longest common subsequence must cover most of the template and
most of the span.

Grams are of three words, for short templates of two.  The votes a template needs
and how far its diagonals may lie apart follow from the words that verification
lets be missing or added, so no span that verifies lacks the votes.

The templates are a fixed table of about two thousand grams and are broadcast; the
texts aren't shuffled.  Besides, base phrases are found at every place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm import _text as T
from readloom.llm._common import durable, if_light, if_small

#: Shares of the template and of the span that common words must reach, in percent; words of a short template.
COVER, DENSE, SHORT = 80, 90, 8
_NO_ID = -(2**63)

# Phrases with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Customary notices of public licenses with their labels.
TEMPLATES = (
    ("Released under the MIT License", "mit"),
    ("Licensed under the MIT License", "mit"),
    ("This project is licensed under the terms of the MIT license", "mit"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "mit",
    ),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "isc",
    ),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        "apache-2.0",
    ),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 2", "gpl-2.0"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
        "gpl-3.0-or-later",
    ),
    (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
        "gpl-2.0-or-later",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
        "gpl",
    ),
    ("Licensed under CC BY 4.0", "cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY-ND 4.0", "cc-by-nd-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
        "bsd-2-clause",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "bsd",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "mpl-2.0",
    ),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
)


def _sequences(texts: list[str]) -> list[np.ndarray]:
    w = T.text_words(texts, T.ALNUM)
    return [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def edits(size: int) -> list[tuple[int, int]]:
    """(missing, added): how many words of a template of so many may lack in a verified span, and be added in each case."""
    least = -(-COVER * size // 100)
    return [(size - n, 100 * n // DENSE - n) for n in range(least, size + 1)]


def gram_of(size: int) -> int:
    return min(2 if size < SHORT else 3, size)


def needed_votes(size: int) -> int:
    """Grams of a template that any verified span has: a missing word breaks gram_of() of them, an added one a gram less."""
    k = gram_of(size)
    return max(1, min(size - k + 1 - k * missing - (k - 1) * added for missing, added in edits(size)))


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, at) of every word k-gram of the templates."""
    rows = [
        (int(g.view(np.int64)), n, i) for n, s in enumerate(_sequences([x for x, _ in TEMPLATES])) for i, g in enumerate(T.grams(s, gram_of(len(s))))
    ]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of every 2-gram of a text and then of every 3-gram, n2 of the former."""
    for batch in batches:
        column = batch.column("text")
        for lo, hi in T.slices(column):
            w = T.words(*T.padded(column.slice(lo, hi - lo)), T.ALNUM)
            numbers = [np.maximum(w.counts - k + 1, 0) for k in (2, 3)]
            begin = np.concatenate(([0], np.cumsum(numbers[0] + numbers[1])))
            ends, doc = np.repeat(w.first[1:], w.counts), np.repeat(np.arange(hi - lo), w.counts)
            flat = np.zeros(int(begin[-1]), np.int64)
            for k, shift in ((2, 0), (3, numbers[0])):
                g = T.grams(w.hashes, k)
                at = np.flatnonzero(np.arange(len(g)) + k <= ends[: len(g)])
                flat[(begin[:-1] + shift - w.first[:-1])[doc[at]] + at] = g[at].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat))
            keys = [batch.column(c).slice(lo, hi - lo) for c in ("key", "text_hash")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(numbers[0], pa.int64()), lists], ["key", "text_hash", "n2", "grams"])


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = _sequences([p for p, _ in PHRASES])
    for batch in batches:
        column = batch.column("text")
        for lo, hi in T.slices(column):
            w = T.words(*T.padded(column.slice(lo, hi - lo)), T.ALNUM)
            ends = np.repeat(w.first[1:], w.counts)
            at, label = [], []
            for n, words in enumerate(phrases):
                m = max(len(w.hashes) - len(words) + 1, 0)
                same = np.ones(m, bool)
                for j, h in enumerate(words):
                    same &= w.hashes[j : j + m] == h
                found = np.flatnonzero(same & (np.arange(m) + len(words) <= ends[:m]))
                at.append(found)
                label.append(np.full(len(found), n))
            at, label = np.concatenate(at), np.concatenate(label)
            doc = np.searchsorted(w.first, at, side="right") - 1
            n = hi - lo
            within = at - w.first[doc]
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            np.minimum.at(first, doc, within)
            np.maximum.at(last, doc, within)
            none = last < 0
            labels: list[list[str]] = [[] for _ in range(n)]
            for d, k in {*zip(doc.tolist(), label.tolist(), strict=True)}:
                labels[d].append(PHRASES[k][1])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(lo, n) for c in ("doc_id", "key", "text_hash")),
                    pa.array(w.counts, pa.int64()),
                    pa.array(np.bincount(doc, minlength=n), pa.int64()),
                    pa.array(first, pa.int64(), mask=none),
                    pa.array(last, pa.int64(), mask=none),
                    pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                ],
                ["doc_id", "key", "text_hash", "n_words", "n_base", "first_word", "last_word", "base"],
            )


def best_span(words: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(common words, first word, end) of the best span around words[low:high] that verifies, or None.

    A span verifies if its longest common subsequence with the template reaches
    COVER percent of the template and DENSE percent of the span.  Most common words
    count, of equals the shorter span, then the earlier.  A span may be taken to
    begin and end with common words, so it begins with one of the template's first
    words, as many as may be missing and one more; for each such beginning one
    pass over the following words gives the common words of every end.
    """
    size = len(template)
    longest = size * 100 // DENSE
    low, high = max(0, low - longest), min(len(words), high + longest)
    span = words[low:high]
    seen = np.concatenate(([0], np.cumsum(np.isin(span, template))))
    begins = np.flatnonzero(np.isin(span, template[: edits(size)[0][0] + 1]))
    # so many of the words that follow must be among the template's
    begins = begins[100 * (seen[np.minimum(begins + longest, len(span))] - seen[begins]) >= COVER * size]
    best = None
    for at in range(0, len(begins), 256):
        a = begins[at : at + 256]
        row = np.zeros((len(a), size + 1), np.int16)
        for j in range(min(longest, len(span))):
            inside = a + j < len(span)
            same = (template == span[np.minimum(a + j, len(span) - 1)][:, None]) & inside[:, None]
            row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], row[:, :-1] + same), axis=1)
            n = row[:, -1].astype(np.int64)
            ok = np.flatnonzero(inside & (100 * n >= COVER * size) & (100 * n >= DENSE * (j + 1)))
            if len(ok):
                top = ok[np.argmax(n[ok])]
                found = (int(n[top]), -(j + 1), -int(a[top]))
                best = found if best is None or found > best else best
    if best is None:
        return None
    n, length, a = best[0], -best[1], -best[2]
    return n, low + a, low + a + length


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = _sequences([x for x, _ in TEMPLATES])
    for batch in batches:
        for lo, hi in T.slices(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            w = T.words(*T.padded(part.column("text")), T.ALNUM)
            labels, scores, spans = [], [], []
            for i, candidates in enumerate(part.column("spans").to_pylist()):
                words, found, most, where = w.hashes[w.first[i] : w.first[i + 1]], set(), 0.0, []
                for t, low, high in sorted({(c["template"], c["low"], c["high"]) for c in candidates}):
                    got = best_span(words, templates[t], low, high)
                    if got:
                        n, begin, end = got
                        most = max(most, n / len(templates[t]))
                        where.append({"template": t, "low": begin, "high": end, "score": n / len(templates[t]), "words": n})
                # of spans that overlap, those count that no other exceeds in common words, or at equal numbers in their share
                better = lambda x, y: (x["words"], x["score"]) > (y["words"], y["score"]) and x["low"] < y["high"] and y["low"] < x["high"]
                where = [x for x in where if not any(better(y, x) for y in where)]
                found |= {TEMPLATES[x["template"]][1] for x in where}
                labels.append(sorted(found))
                scores.append(most)
                spans.append([{k: x[k] for k in ("template", "low", "high", "score")} for x in where])
            span = pa.struct([("template", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    part.column("text_hash"),
                    pa.array(labels, pa.list_(pa.string())),
                    pa.array(scores, pa.float64()),
                    pa.array(spans, pa.list_(span)),
                ],
                ["key", "text_hash", "more", "cover", "verified"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    key = F.col("doc_id").cast("long")
    return docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(_NO_ID)).alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def candidate_spans(docs: DataFrame) -> DataFrame:
    """(key, text_hash, template, low, high, votes): merged diagonals with enough votes, as word spans."""
    spark = docs.sparkSession
    votes = (
        _keyed(docs)
        .select("key", "text_hash", "text")
        .mapInArrow(_grams, "key long, text_hash long, n2 long, grams array<long>")
        .select("key", "text_hash", "n2", F.posexplode("grams").alias("nth", "gram"))
        .select("key", "text_hash", "gram", F.when(F.col("nth") < F.col("n2"), F.col("nth")).otherwise(F.col("nth") - F.col("n2")).alias("pos"))
        .join(F.broadcast(template_grams(spark)), "gram")
        .withColumn("diagonal", F.col("pos") - F.col("at"))
        .groupBy("key", "text_hash", "template", "diagonal")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    )
    along = Window.partitionBy("key", "text_hash", "template").orderBy("diagonal")
    sizes = [len(s) for s in _sequences([x for x, _ in TEMPLATES])]
    of = lambda values: F.element_at(F.array(*(F.lit(n) for n in values)), F.col("template") + 1)
    gap, need, gram = of([max(1, *(m + x for m, x in edits(n))) for n in sizes]), of(map(needed_votes, sizes)), of(map(gram_of, sizes))
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > gap).cast("int"), F.lit(0))
    return (
        votes.withColumn("apart", apart)
        .withColumn("run", F.sum("apart").over(along))
        .groupBy("key", "text_hash", "template", "run")
        .agg(F.sum("n").alias("votes"), F.min("low").cast("long").alias("low"), (F.max("high") + F.first(gram)).cast("long").alias("high"))
        .where(F.col("votes") >= need)
        .drop("run")
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of docs(doc_id, text, ...).

    n_base counts the places of all base phrases; base_labels are theirs, labels
    also those of verified templates, both sorted, distinct and comma-joined.
    score is the largest verified share of a template, at least 0.5 with a base
    phrase, else 0.  spans lists the verified spans (empty without any) by word
    positions.  A null
    text has no words.  Rows of one doc_id are judged by their own texts; other
    columns are ignored; an empty table gives an empty result.
    """
    spans = candidate_spans(docs).groupBy("key", "text_hash").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans"))
    spans = durable(spans)
    again = (
        _keyed(docs)
        .select("key", "text_hash", "text")
        .join(if_small(spans.select("key", "text_hash")), ["key", "text_hash"], "left_semi")
        .dropDuplicates(["key", "text_hash"])
        .join(spans, ["key", "text_hash"])
    )
    verified = again.mapInArrow(
        _verify,
        "key long, text_hash long, more array<string>, cover double, verified array<struct<template int, low long, high long, score double>>",
    ).where(F.size("more") > 0)
    base = _keyed(docs).mapInArrow(
        _base,
        "doc_id long, key long, text_hash long, n_words long, n_base long, first_word long, last_word long, base array<string>",
    )
    verified = durable(verified)
    out = base.join(if_light(verified, 32 * (F.size("verified") + F.size("more") + 2)), ["key", "text_hash"], "left")
    joined = F.sort_array(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    at_least = F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(joined, ",").alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), at_least).alias("score"),
        F.coalesce("verified", F.array().cast("array<struct<template int, low long, high long, score double>>")).alias("spans"),
    )
