"""Licence statements in texts, by a trained paragraph classifier.

A paragraph is a line. Its words and word pairs, as far as they are in a small
vocabulary, are the features of a logistic regression over licence families, a
class for statements of other licences, and ordinary prose. Probabilities are
calibrated on paragraphs held out of the training; a family that is not sure
enough becomes ``unknown``. A predicted family is confirmed when most five-word
shingles of one of its notices stand in the paragraph.

Notices are mostly wrapped. So lines near one with three words of a notice are read
once more, each with those that follow it: a notice that stands there, and not in
the line or in those that follow alone, is a confirmed statement as well.

The vocabulary has no word that ordinary paragraphs are full of, so that most
paragraphs have no feature at all. These get the probabilities of the intercepts,
which are those of prose, and never leave the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.tables import ROW, stored_with_row
from caseloom.plans.store import stored

PROSE, UNKNOWN = "none", "unknown"
MAX_PROSE = 2000       # ordinary paragraphs that are learned from
MAX_GRAMS = 4096       # size of the vocabulary
COMMON = 0.01          # a feature is left out if more of the ordinary paragraphs have it, or each of its words
PRECISION = 0.98       # of sure families among held-out paragraphs
SHINGLE, SIMILARITY = 5, 0.8
NEAR = 16              # lines before and behind a line with words of a notice, over which it may be wrapped
WRAPPED = 64           # words of a line, and of those that follow; more than any notice has

# Short notices of well-known licences, by family.
NOTICES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
             "Licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.",
              "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC-SA 4.0 for non-commercial use."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "Released under the GPL version 2."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
             "Licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
            "This project is licensed under the terms of the MIT license."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "reserved": ["All rights reserved.", "Copyright 2020 by the authors. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
# Statements of licences outside these families, and prose that has words of licences in it.
OTHER = ["Licensed under the Example Public License.", "Released under a custom license, see the license file.", "This work is licensed under terms that the author sends on request.",
         "Use is subject to the license agreement of the vendor.", "Distributed under the terms of a proprietary license.", "The data may be used under the open government licence."]
PLAIN = ["He lost his driving license on the way to work.", "They fought for equal rights and a free press.", "The public library is open on Monday.",
         "A new version of the story was released in May.", "She studied at MIT before she moved to Paris.", "The Apache live in the southwest of the country.",
         "All of the members were present.", "The committee granted permission to build the bridge.", "The software runs on this machine without changes.",
         "Please reserve a table for four persons.", "The terms of trade changed in the last version of the report.", "A copy of the letter was sent to the author.",
         "The work of the commission is free of charge.", "Version 3 comes with more colours.", "The foundation published a general report."]


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def gram_list(words: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.contains(" "))))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p.rlike(r"\S"))


def training_paragraphs(docs: DataFrame, text: str, max_prose: int = MAX_PROSE) -> DataFrame:
    """``(label, words, found, held_out)``: notices with words left out and cut, and ordinary paragraphs, ``found`` in the documents.

    Ordinary are the first paragraphs of the at most ``max_prose`` documents with
    the lowest hash, where they do not speak of licences or copyright.
    """
    spark = docs.sparkSession
    given = [(f, n) for f, notices in NOTICES.items() for n in notices] + [(UNKNOWN, n) for n in OTHER] + [(PROSE, n) for n in PLAIN]
    prose = (
        docs.select(F.xxhash64(text).alias("h"), F.get(paragraphs(F.col(text)), F.lit(0)).alias("text")).filter("text is not null")
        .filter(~F.lower("text").rlike("licen[sc]|copyright|rights|public domain|permission|creative commons|gnu"))
        .orderBy("h", "text").limit(max_prose).select(F.lit(PROSE).alias("label"), word_list(F.col("text")).alias("words"), F.lit(True).alias("found"))
    )
    whole = spark.createDataFrame(given, "label string, text string").select("label", word_list(F.col("text")).alias("words"))
    cut = whole.select("label", F.explode(F.concat(
        F.array("words", "words", "words"),
        F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.filter("words", lambda w, j: j != i)),
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") / 3).cast("int")),
                    lambda i: F.slice("words", 1, F.greatest(F.lit(1), F.size("words") - i))),
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") / 3).cast("int")),
                    lambda i: F.slice("words", i + 1, F.size("words"))))).alias("words"))
    rows = cut.withColumn("found", F.lit(False)).union(prose).filter(F.size("words") > 0)
    return rows.withColumn("held_out", F.pmod(F.xxhash64("label", F.array_join("words", " ")), F.lit(4)) == 0)


@dataclass
class LicenseModel:
    weights: DataFrame           # (gram, trigger, w): one weight per class; ``trigger`` is a word of the gram
    classes: list[str]
    intercepts: list[float]
    temperature: float
    threshold: float             # least calibrated probability of a sure family


def train_license_model(docs: DataFrame, text: str = "text", max_prose: int = MAX_PROSE) -> LicenseModel:
    """Train on notices and on ordinary paragraphs of ``docs``; calibrate on the quarter held out."""
    rows = stored(training_paragraphs(docs, text, max_prose).select("label", "words", "found", gram_list(F.col("words")).alias("grams"), "held_out").coalesce(1), "license-rows")
    spark = docs.sparkSession
    n_prose = max(1, rows.filter("found").count())
    counted = rows.select("label", "found", F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.sum(F.col("found").cast("int")).alias("prose"), F.sum((F.col("label") != PROSE).cast("int")).alias("other"))
    vocabulary = stored(
        counted.filter((F.col("other") > 0) & (F.col("prose") <= COMMON * n_prose)).orderBy(F.desc("other"), "gram").limit(MAX_GRAMS), "license-grams")
    # A gram is found by its rarer word, so that scanning for one word per gram finds all. That word has to be rare as well.
    rare = {r["gram"]: r["prose"] for r in counted.filter(~F.col("gram").contains(" ")).collect()}
    trigger = {g: min(g.split(" "), key=lambda w: (rare.get(w, 0), w)) for g in [r["gram"] for r in vocabulary.orderBy(F.desc("other"), "gram").collect()]}
    names = [g for g, w in trigger.items() if rare.get(w, 0) <= COMMON * n_prose]
    vectors = CountVectorizerModel.from_vocabulary(names, inputCol="grams", outputCol="features")
    vectors.setBinary(True)
    classes = [PROSE, UNKNOWN, *sorted(NOTICES)]
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1
    vectored = vectors.transform(rows.withColumn("y", label.cast("double"))).cache()
    regression = LogisticRegression(labelCol="y", family="multinomial", regParam=0.001, elasticNetParam=0.2, maxIter=60)
    fitted = regression.fit(vectored.filter(~F.col("held_out")))
    table = fitted.coefficientMatrix.toArray()
    intercepts = [float(x) for x in fitted.interceptVector]
    if max(range(len(classes)), key=lambda i: intercepts[i]) != 0:
        raise ValueError("a paragraph without features must be prose; there are too few ordinary paragraphs to learn from")
    weights = spark.createDataFrame(
        [(g, trigger[g], [float(x) for x in table[:, i]]) for i, g in enumerate(names)],
        "gram string, trigger string, w array<double>")
    held = fitted.transform(vectored.filter("held_out")).select("y", vector_to_array("rawPrediction").alias("raw"))
    tried = held.withColumn("t", F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)]))).withColumn("p", _softmax(F.col("raw"), F.col("t")))
    best = tried.groupBy("t").agg(F.avg(-F.log(F.greatest(F.lit(1e-12), F.element_at("p", (F.col("y") + 1).cast("int"))))).alias("loss")).orderBy("loss", "t").first()
    temperature = best["t"] if best else 1.0
    sure = (
        held.withColumn("p", _softmax(F.col("raw"), F.lit(temperature))).withColumn("top", F.array_max("p"))
        .withColumn("at", F.array_position("p", F.col("top")) - 1).filter("at > 1")
        .withColumn("cut", F.explode(F.array(*[F.lit(x / 20) for x in range(8, 20)]))).filter("top >= cut")
        .groupBy("cut").agg(F.avg((F.col("at") == F.col("y")).cast("double")).alias("right")).filter(F.col("right") >= PRECISION).orderBy("cut").first()
    )
    vectored.unpersist()
    return LicenseModel(weights, classes, intercepts, temperature, sure["cut"] if sure else 0.95)


def _softmax(raw: Column, temperature: Column) -> Column:
    scaled = F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) / temperature))
    return F.transform(scaled, lambda x: x / F.aggregate(scaled, F.lit(0.0), lambda a, b: a + b))


def _notice_words() -> list[tuple[str, list[str]]]:
    return [(f, re.findall("[a-z0-9]+", n.lower())) for f, notices in NOTICES.items() for n in notices]


def _three_words(words: Column) -> Column:
    def behind(at):
        return F.slice(words, at, F.greatest(F.lit(1), F.size(words)))

    def joined(a, b):
        return F.when(b.isNotNull(), F.concat_ws(" ", a, b))

    return F.zip_with(F.zip_with(words, behind(2), joined), behind(3), joined)


def license_paragraphs(docs: DataFrame, model: LicenseModel, text: str, carry: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Stored documents ``(row, carry, n_paragraphs, found, near)`` and their statements ``(row, par_no, paragraph, family, probability, confirmed)``."""
    triggers = F.array(*[F.lit(r["trigger"]) for r in model.weights.select("trigger").distinct().orderBy("trigger").collect()])
    threes = F.array(*[F.lit(t) for t in sorted({" ".join(w[i:i + 3]) for _, w in _notice_words() for i in range(len(w) - 2)})])
    scanned = stored_with_row(
        docs.select(*carry, paragraphs(F.col(text)).alias("p")).select(
            "*", F.size("p").cast("long").alias("n_paragraphs"),
            F.filter(F.transform("p", lambda x, i: F.struct(i.alias("no"), x.alias("x"))), lambda p: F.arrays_overlap(word_list(p["x"]), triggers)).alias("found")
        ).withColumn("hits", F.transform(F.filter("found", lambda p: F.arrays_overlap(_three_words(word_list(p["x"])), threes)), lambda p: p["no"])
        ).withColumn("near", F.when(F.size("hits") > 0, F.filter(
            F.transform("p", lambda x, i: F.struct(i.alias("no"), x.alias("x"))), lambda p: F.exists("hits", lambda h: F.abs(p["no"] - h) <= NEAR)))
        ).drop("p", "hits"), "license-scan")
    found = scanned.select(ROW, F.explode("found").alias("f")).select(ROW, F.col("f.no").alias("par_no"), F.col("f.x").alias("paragraph"))
    classes = F.array(*map(F.lit, model.classes))
    judged = (
        _probabilities(found.select(ROW, "par_no", word_list(F.col("paragraph")).alias("words")), model)
        .withColumn("top", F.array_max("p")).withColumn("label", F.element_at(classes, F.array_position("p", F.col("top")).cast("int")))
        .filter(F.col("label") != PROSE)
        .withColumn("family", F.when(F.col("top") >= model.threshold, F.col("label")).otherwise(UNKNOWN))
        .select(ROW, "par_no", "family", F.col("top").alias("probability"))
    )
    return scanned, confirmed(found.join(judged, [ROW, "par_no"])).unionByName(wrapped(scanned, model))


def _probabilities(units: DataFrame, model: LicenseModel) -> DataFrame:
    """``(row, par_no, p)``: the classes' probabilities of ``units(row, par_no, words)`` with a feature."""
    grams = units.select(ROW, "par_no", F.explode(gram_list(F.col("words"))).alias("gram"))
    n = len(model.classes)
    scores = grams.join(F.broadcast(model.weights.select("gram", "w")), "gram").groupBy(ROW, "par_no").agg(  # at most MAX_GRAMS rows
        *[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(n)])
    raw = F.array(*[F.col(f"s{i}") + F.lit(model.intercepts[i]) for i in range(n)])
    return scores.select(ROW, "par_no", raw.alias("raw")).select(ROW, "par_no", _softmax(F.col("raw"), F.lit(model.temperature)).alias("p"))


def _in_order(words: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - size)), lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def _shingles(words: Column, size: Column) -> Column:
    return F.array_distinct(_in_order(words, size))


def wrapped(scanned: DataFrame, model: LicenseModel) -> DataFrame:
    """Confirmed statements that go over line ends, as ``confirmed`` has them, each at the line that it begins in.

    Notices of some families are nearly those of others: of families that have a
    shingle in common, the one with the larger share is stated.
    """
    spark = scanned.sparkSession
    lines = scanned.filter(F.size("near") > 1).select(ROW, F.transform("near", lambda p: F.struct(
        p["no"].alias("no"), word_list(F.regexp_replace(p["x"], r"(?i)^\s*(rem|dnl)\s", "")).alias("w"))).alias("l"))
    begun = stored(lines, "license-near").select(ROW, "l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("at")).select(
        ROW, F.element_at("l", F.col("at")).alias("b"), F.slice("l", F.col("at") + 1, NEAR).alias("more"))
    parts = begun.select(
        ROW, F.col("b.no").alias("par_no"), F.slice("b.w", F.greatest(F.lit(1), F.size("b.w") - WRAPPED + 1), WRAPPED).alias("own"),
        F.slice(F.flatten(F.transform(F.filter("more", lambda p, i: p["no"] == F.col("b.no") + i + 1), lambda p: p["w"])), 1, WRAPPED).alias("rest"))
    units = stored(parts.filter((F.size("own") > 0) & (F.size("rest") > 0)).withColumn("words", F.concat("own", "rest")), "license-units")

    def key(words):
        size = min(SHINGLE, len(words))
        return len(words) * 5 // 4 - size + 1, size, list(dict.fromkeys(" ".join(words[i:i + size]) for i in range(len(words) - size + 1)))

    keys: dict[str, list] = {}
    for family, words in _notice_words():
        keys.setdefault(family, []).append(key(words))
    every = {f: {x for *_, shingles in known for x in shingles} for f, known in keys.items()}
    families = spark.createDataFrame(
        [(f, keys[f], [g for g in keys if every[f] & every[g]]) for f in sorted(keys)],
        "family string, notices array<struct<reach int, size int, shingles array<string>>>, rivals array<string>")
    held = units.select(ROW, "par_no", "words", *[
        F.array(*[_in_order(F.col(c), F.lit(k)) for k in range(1, SHINGLE + 1)]).alias(f"of_{c}") for c in ("words", "own", "rest")],
        F.size("own").alias("n_own"))

    def held_in(c, shingles, n, reach):
        return F.array_intersect(shingles, F.slice(F.element_at(F.col(c), n["size"]), 1, reach))

    def alone(c, reach):
        return F.array_max(F.transform("notices", lambda n: F.size(held_in(c, n["shingles"], n, reach(n))) / F.size(n["shingles"])))

    def begun_share(n):
        """Shingles from the first one on that begins in the line; not those of a next notice, behind the end of one."""
        first = F.array_position(n["shingles"], F.get(held_in("of_words", n["shingles"], n, F.col("n_own")), F.lit(0))).cast("int")
        later = F.slice(n["shingles"], F.greatest(F.lit(1), first), F.size(n["shingles"]))
        return F.coalesce(F.size(held_in("of_words", later, n, F.col("n_own") + n["reach"])) / F.size(n["shingles"]) * F.sign(first), F.lit(0.0))

    shares = held.crossJoin(F.broadcast(families)).select(  # one row per family of NOTICES
        ROW, "par_no", "words", "family", "rivals", F.array_max(F.transform("notices", begun_share)).alias("similarity"),
        alone("of_own", lambda n: F.lit(WRAPPED)).alias("own"), alone("of_rest", lambda n: n["reach"]).alias("rest"))
    likely = shares.filter(F.col("similarity") >= SIMILARITY)
    best = likely.groupBy(ROW, "par_no").agg(F.collect_list(F.struct("family", "similarity")).alias("others"))  # a family once
    stated = likely.filter((F.col("own") < SIMILARITY) & (F.col("rest") < SIMILARITY)).join(best, [ROW, "par_no"]).filter(
        ~F.exists("others", lambda o: F.array_contains("rivals", o["family"]) & (o["similarity"] > F.col("similarity"))))
    stated = stored(stated.select(ROW, "par_no", "words", "family", "similarity"), "license-wrapped")
    at = F.array_position(F.array(*map(F.lit, model.classes)), F.col("family")).cast("int")
    chances = _probabilities(stated.select(ROW, "par_no", "words").dropDuplicates([ROW, "par_no"]), model)
    return stated.join(chances, [ROW, "par_no"], "left").select(
        ROW, "par_no", F.array_join("words", " ").alias("paragraph"), "family", F.coalesce(F.element_at("p", at), F.lit(0.0)).alias("probability"),
        "similarity", F.lit(True).alias("confirmed"))


def confirmed(statements: DataFrame) -> DataFrame:
    """``statements`` with ``confirmed``: whether a notice of the family stands in the paragraph.

    That is 0.8 or more of the notice's five-word shingles; a shorter notice is one
    shingle as a whole.
    """
    spark = statements.sparkSession

    notices = (
        spark.createDataFrame([(f, n) for f, notices in NOTICES.items() for n in notices], "family string, text string")
        .withColumn("w", word_list(F.col("text"))).withColumn("size", F.least(F.lit(SHINGLE), F.size("w")))
        .withColumn("shingles", _shingles(F.col("w"), F.col("size")))
        .groupBy("family").agg(F.collect_list(F.struct("size", "shingles")).alias("notices"))
    )
    words = word_list(F.col("paragraph"))
    held = F.col("holds")
    share = F.transform("notices", lambda n: F.size(F.array_intersect(n["shingles"], F.element_at(held, n["size"]))) / F.size(n["shingles"]))
    best = F.coalesce(F.array_max(share), F.lit(0.0))
    return (
        statements.join(F.broadcast(notices), "family", "left")  # one row per family of NOTICES
        .withColumn("holds", F.array(*[_shingles(words, F.lit(k)) for k in range(1, SHINGLE + 1)]))
        .select(ROW, "par_no", "paragraph", "family", "probability", best.alias("similarity"), (best >= SIMILARITY).alias("confirmed"))
    )


def license_scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", model: LicenseModel | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_paragraphs, n_statements, n_confirmed, families, confirmed_families, best_probability``.

    Paragraphs are lines. A notice that is wrapped over lines is one statement more than
    those that its lines make by themselves. The lists of families are sorted and comma-joined; ``best_probability`` is that
    of the surest statement, NULL without any. NULL and empty texts have no
    paragraphs. Each row is a document, whatever its id; an empty table gives no
    rows; other columns play no part.
    """
    model = model or train_license_model(docs, text)
    scanned, found = license_paragraphs(docs, model, text, [F.col(id_col).alias("id")])
    by_row = found.groupBy(ROW).agg(
        F.count(F.lit(1)).alias("n_statements"), F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("confirmed_families"),
        F.max("probability").alias("best_probability"))
    return scanned.select(ROW, "id", "n_paragraphs").join(by_row, ROW, "left").select(
        F.col("id").alias("doc_id"), "n_paragraphs", F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"),
        F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("confirmed_families", F.lit("")).alias("confirmed_families"), F.round("best_probability", 6).alias("best_probability"))
