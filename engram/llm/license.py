"""License scans by a trained paragraph classifier (operator 9), DataFrame
functions and Spark's own ML only.

Every paragraph (line) of every text is classified by multinomial logistic
regression over word 2-grams and key words of the notices into a licence family
or "unknown".  The model learns from the templates below, cut and framed in
several ways, and from all paragraphs of the corpus as the unknown class; the
score from which a family counts is calibrated on all of them too.  Paragraphs
with the same terms are alike to the model, so each set of terms that the corpus
holds is one row, weighted by the number of its paragraphs: as many iterations
as the model needs read that table, and the corpus is read once to count it.  A
prediction is confirmed by comparing the paragraph with the templates of its
family.

A notice wrapped over lines or inside a long line is no paragraph of its own.
Overlapping windows of words over the whole text, whatever its line ends and
comment marks, are compared with the templates too; of a window that holds
enough of one, the part between the first and the last shared word pair is
classified and confirmed like a paragraph.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UNKNOWN = "unknown"
# Public notices and their families (short forms and opening sentences).
TEMPLATES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
        "License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "public-domain": [
        "This work is dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "reserved": [
        "All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
#: What may stand before or after a notice.
FRAMES = ("{}", "This file: {}", "The code. {}", "{} See the file for details.", "Copyright 2020 The Authors. {}",
          "Unless stated otherwise: {}")
#: Paragraphs that talk of licences and grant none.
NEGATIVES = (
    "The driver lost his license last year.", "She was granted a fishing licence by the county.",
    "A license to kill is not permission to use public property.", "The copyright case was heard in general court.",
    "The version released under pressure was without warranty of quality.", "All the rights were reserved for later.",
    "The public library is free of charge to any person.", "The commons were open to the general public.",
    "He works under the general manager of the file archive.", "This work is what the author was known for.",
)
#: Rows of the training table that one task holds.
SET_ROWS = 1 << 16
FALSE_RATE = 0.0005                      # share of unknown paragraphs that may reach the calibrated score
CONFIRMED = 0.6                          # share of a template's word pairs that a paragraph must hold
#: Windows: words, and words from one to the next.  A run of up to words - step + 1 words is whole in one of them.
WINDOWS = ((12, 4), (24, 8), (48, 16))


def paragraphs(text: Column) -> Column:
    """The lines of a text that hold anything; null has none."""
    return F.filter(F.split(text, r"\n"), lambda p: F.trim(p) != "")


def words(p: Column) -> Column:
    """Lower-case words: letters and digits, with inner dots, dashes and plus signs."""
    return F.regexp_extract_all(F.lower(p), F.lit(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"), F.lit(0))


def pairs(w: Column) -> Column:
    """Neighbouring words, joined by a blank."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _template_pairs(template: str) -> list[str]:
    w = re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", template.lower())
    return sorted(set(map(" ".join, zip(w, w[1:], strict=False))))


def _keys(templates: list[str]) -> list[str]:
    """Words of which a window that can be confirmed holds one: without the pairs
    that these words are in, too few of any template remain."""
    keys: set[str] = set()
    for t in templates:
        p = _template_pairs(t)
        rest = [x for x in p if not keys & set(x.split(" "))]
        for w in sorted(set(" ".join(p).split(" ")), key=lambda w: (-len(w), w)):
            if len(rest) / len(p) < CONFIRMED:
                break
            keys.add(w)
            rest = [x for x in rest if w not in x.split(" ")]
    return sorted(keys)


def _vocabulary() -> list[str]:
    """The terms that the model knows: pairs of the framed templates and of the
    negatives, and the templates' key words."""
    texts = [f.format(t) for ts in TEMPLATES.values() for t in ts for f in FRAMES]
    return sorted({p for t in [*texts, *NEGATIVES] for p in _template_pairs(t)}
                  | set(_keys([t for ts in TEMPLATES.values() for t in ts])))


VOCABULARY = _vocabulary()


def terms(w: Column) -> Column:
    """The set of those words and pairs that the model knows, in order; null has none."""
    found = F.filter(F.concat(w, pairs(w)), lambda x: x.isin(VOCABULARY))
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def _fitting() -> list[tuple[int, int, list[tuple[str, str]]]]:
    """The windows, each with the (family, template) that fit it and no smaller one."""
    left = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    out = []
    for n, step in WINDOWS:
        fit = [(f, t) for f, t in left if len(re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", t.lower())) <= n - step + 1]
        left = [x for x in left if x not in fit]
        out.append((n, step, fit))
    assert not left, left
    return out


def _windows(w: Column) -> Column:
    """Those windows of a text's words that hold a key word: structs of kind (1
    for the smallest windows) and words."""
    def of(kind: int, n: int, step: int, templates: list[str]) -> Column:
        keys = F.array(*map(F.lit, _keys(templates)))
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(step)), lambda i: F.slice(w, i, n))
        cut = F.when(F.arrays_overlap(w, keys), F.filter(cut, lambda x: F.arrays_overlap(x, keys)))
        return F.transform(F.coalesce(cut, F.array().cast("array<array<string>>")), lambda x: F.struct(
            F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("paragraph"), x.alias("words")))

    return F.concat(*[of(kind, n, step, [t for _, t in fit]) for kind, (n, step, fit) in enumerate(_fitting(), 1)])


def _spans(df: DataFrame) -> DataFrame:
    """Rows of kind 0 as they are; of the windows those that hold enough of a
    template, with ``words`` cut to what lies between the shared pairs."""
    df = df.withColumn("_own", F.when(F.col("kind") > 0, pairs(F.col("words"))))
    best = F.lit(None).cast("struct<share:double,pairs:array<string>>")
    for kind, (_, _, fit) in enumerate(_fitting(), 1):
        of = [F.struct((F.size(F.array_intersect("_own", F.array(*map(F.lit, p)))) / len(p)).alias("share"),
                       F.array(*map(F.lit, p)).alias("pairs")) for p in (_template_pairs(t) for _, t in fit)]
        best = F.when(F.col("kind") == kind, F.array_max(F.array(*of))).otherwise(best)
    df = df.withColumn("_best", best).where((F.coalesce("kind", F.lit(0)) == 0) | (F.col("_best.share") >= CONFIRMED))
    at = F.filter(F.transform("_own", lambda x, i: F.when(F.array_contains(F.col("_best.pairs"), x), i + 1)),
                  lambda i: i.isNotNull())
    df = df.withColumn("_at", at)
    span = F.slice("words", F.array_min("_at"), F.array_max("_at") - F.array_min("_at") + 2)
    return df.withColumn("words", F.when(F.col("kind") > 0, span).otherwise(F.col("words"))).drop("_own", "_best", "_at")


def likeness(own: Column, family: str) -> Column:
    """The largest share of a template's word pairs that are among ``own`` (the
    word pairs of a paragraph, or its terms), over the templates of a family."""
    shares = [F.size(F.array_intersect(own, F.array(*map(F.lit, p)))) / len(p)
              for p in map(_template_pairs, TEMPLATES[family])]
    return F.greatest(*shares, F.lit(0.0))


def term_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """(terms, n): each set of terms that paragraphs of the corpus have, and how many have it."""
    p = docs.select(F.explode(paragraphs(F.col(text))).alias("p")).select(words(F.col("p")).alias("w"))
    return p.select(terms(F.col("w")).alias("terms")).groupBy("terms").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, text: str = "text") -> tuple[LogisticRegressionModel, float, list]:
    """The model, the calibrated least score, and the families by index.

    Positive: every template, whole and without its first or last words, in every
    frame.  Unknown: NEGATIVES and all paragraphs of the corpus, but for those that
    look like a template.  The least score is one that no more than FALSE_RATE of
    these paragraphs reach."""
    spark = docs.sparkSession
    families = [UNKNOWN, *sorted(TEMPLATES)]
    index = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    named = [F.struct(F.lit(f).alias("family"), F.lit(x).alias("template")) for f, ts in TEMPLATES.items() for x in ts]
    t = spark.range(1).select(F.explode(F.array(*named)).alias("t")).select("t.family", "t.template")
    n = F.size(F.split("template", " "))
    part = lambda lo, hi: F.array_join(F.slice(F.split("template", " "), lo, hi), " ")
    cuts = F.array(F.col("template"), F.when(n > 5, part(F.lit(2), n - 1)), F.when(n > 5, part(F.lit(1), n - 1)),
                   F.when(n > 9, part(F.lit(3), n - 4)))
    known = t.select("family", F.explode(cuts).alias("cut")).where("cut IS NOT NULL").select("family", F.explode(
        F.array(*[F.concat(F.lit(f.split("{}")[0]), F.col("cut"), F.lit(f.split("{}")[1])) for f in FRAMES])).alias("p"))
    known = known.unionByName(spark.range(1).select(
        F.lit(UNKNOWN).alias("family"), F.explode(F.array(*map(F.lit, NEGATIVES))).alias("p")))
    known = known.withColumn("w", words(F.col("p"))).select("family", terms(F.col("w")).alias("terms"), F.lit(1).cast("long").alias("n"))
    # written first: a condition on the sets would be put to every paragraph
    corpus = written(term_sets(docs, text), "license-sets")
    corpus = corpus.where(F.greatest(*[likeness(F.col("terms"), f) for f in TEMPLATES]) < 0.4)
    rows = known.unionByName(corpus.select(F.lit(UNKNOWN).alias("family"), "terms", "n"))
    counts = {r["family"]: r for r in rows.groupBy("family").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets")).collect()}
    weight = F.lit(1.0)
    for f, c in counts.items():
        weight = F.when(F.col("family") == f, 200.0 * (4 if f == UNKNOWN else 1) / c["n"] * F.col("n")).otherwise(weight)
    # in order, and one task unless there are very many sets: the sums of a rerun are the same
    tasks = 1 + sum(c["sets"] for c in counts.values()) // SET_ROWS
    rows = _features(rows.select(index.cast("double").alias("label"), "terms", weight.alias("weight")), "terms")
    rows = rows.orderBy("label", "terms").coalesce(tasks)
    model = LogisticRegression(maxIter=60, regParam=0.002, family="multinomial", weightCol="weight",
                               aggregationDepth=2).fit(rows)
    held = classify(corpus, "terms", model, families)
    top = held.select("n", F.when(F.col("family") == UNKNOWN, 0.0).otherwise(F.col("score")).alias("s")).agg(
        F.percentile("s", F.lit(1 - FALSE_RATE), F.col("n")).alias("s")).first()["s"]
    return model, max(0.5, float(top or 0.0)), families


def _features(df: DataFrame, of: str) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(VOCABULARY, inputCol=of, outputCol="features").transform(df)


def classify(df: DataFrame, of: str, model: LogisticRegressionModel, families: list) -> DataFrame:
    """Adds family (the likeliest) and score (its probability) of a paragraph with the terms ``of``."""
    out = model.transform(_features(df, of)).withColumn("_p", vector_to_array("probability"))
    return out.withColumn("family", F.element_at(F.array(*map(F.lit, families)), (F.col("prediction") + 1).cast("int"))) \
              .withColumn("score", F.array_max("_p")).select(*df.columns, "family", "score")


def _units(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The paragraphs of :func:`scan_paragraphs` (kind 0) and the windows that
    hold enough of a template (kind 1 and above, without a paragraph), both
    classified and compared."""
    model, least, families = train(docs, text)
    # no word goes over a line end, so the words of the lines are those of the text
    lines = F.transform(paragraphs(F.col(text)), lambda x: F.struct(
        F.lit(0).alias("kind"), x.alias("paragraph"), words(x).alias("words")))
    p = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), lines.alias("_lines"))
    p = p.withColumn("_words", F.flatten(F.col("_lines")["words"]))
    p = p.select("row", "doc_id", F.posexplode_outer(F.concat("_lines", _windows(F.col("_words")))).alias("place", "u"))
    p = p.select("row", "doc_id", "place", "u.kind", "u.paragraph", "u.words")
    p = _spans(p)
    p = classify(p.withColumn("_terms", terms(F.col("words"))), "_terms", model, families)
    there = F.col("paragraph").isNotNull() | (F.col("kind") > 0)
    p = p.withColumn("family", F.when(there & (F.col("score") >= least), F.col("family")).otherwise(F.lit(UNKNOWN)))
    best = F.lit(0.0)
    for f in TEMPLATES:
        best = F.when(F.col("family") == f, likeness(F.col("_terms"), f)).otherwise(best)
    return p.withColumn("likeness", best).withColumn("confirmed", F.col("likeness") >= CONFIRMED).drop("words", "_terms")


def scan_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph, in ``row`` of its document and ``place`` (from 0),
    with family, score, likeness (to the nearest template of the family; 0 for
    unknown) and confirmed.  Documents without paragraphs have one row with a
    null paragraph."""
    return _units(docs, doc_id, text).where(F.coalesce("kind", F.lit(0)) == 0).drop("kind")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_paragraphs, n_licensed (confirmed paragraphs, and
    families that only windows over lines or within long ones bear out),
    n_unconfirmed (predictions that no template bears out), license (family of
    the confirmed paragraph or window with the best likeness, then score, then
    name; null if there is none), likeness and score (of that one, else null).

    Null and empty texts have no paragraphs, a null doc_id stays null, repeated
    rows each give a row, other columns are ignored, an empty table gives an
    empty result."""
    if docs.limit(1).count() == 0:
        return docs.select(F.col(doc_id).alias("doc_id"), *[F.lit(None).cast(k).alias(c) for c, k in (
            ("n_paragraphs", "long"), ("n_licensed", "long"), ("n_unconfirmed", "long"), ("license", "string"),
            ("likeness", "double"), ("score", "double"))])
    p = _units(docs, doc_id, text)
    line = F.coalesce("kind", F.lit(0)) == 0
    best = F.max(F.when(F.col("confirmed"), F.struct("likeness", "score", "family")))
    of = lambda which: F.collect_set(F.when(F.col("confirmed") & which, F.col("family")))
    out = p.groupBy("row", "doc_id").agg(
        F.count("paragraph").alias("n_paragraphs"),
        (F.count_if(F.col("confirmed") & line) + F.size(F.array_except(of(~line), of(line)))).alias("n_licensed"),
        F.count_if((F.col("family") != UNKNOWN) & ~F.col("confirmed") & line).alias("n_unconfirmed"), best.alias("best"))
    return out.select("doc_id", "n_paragraphs", "n_licensed", "n_unconfirmed", F.col("best.family").alias("license"),
                      F.col("best.likeness").alias("likeness"), F.col("best.score").alias("score"))
