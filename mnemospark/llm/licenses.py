"""Licence scans: a trained paragraph classifier confirmed by template comparison.

A paragraph is a line with a word, or a group of up to GROUP consecutive words of lines that no
blank one parts, for notices wrapped over lines. Its word pairs and triples are looked up in the weights of a
sparse softmax regression over licence families and an unknown class, which is trained on
disturbed copies of the notices below and on a bounded sample of the corpus's own lines. The
probability at which a family is believed is calibrated on all lines that no notice confirms.
What is believed is compared with the family's notices, and confirmed where enough of one is
there. Corpus passes use DataFrame functions only; the weights are fitted on the driver.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Usual notices of each family.
NOTICES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU GPL, version 2 or later.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "reserved": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
    ),
}
UNKNOWN = "unknown"
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Disturbed copies of a notice, lines sampled from the corpus and characters of each, share of false alarms allowed.
COPIES, LINES, LINE_CHARS, ALARMS = 40, 5_000, 2_000, 0.001
#: Bounds of the probability that is believed.
BELIEF = (0.5, 0.95)
#: Share of a notice's word pairs that confirms a family.
CONFIRM = 0.5
#: Words of a group of lines; groups begin at every half, so a notice of half as many lies in one.
GROUP = 80


@dataclass(frozen=True)
class Model:
    """weights: n-gram -> a weight for each class; bias of each class."""

    classes: tuple[str, ...]
    weights: dict[str, list[float]]
    bias: list[float]


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}


def words_of(line: str) -> list[str]:
    return re.findall(WORD, line.lower())


def disturbed(words: list[str], rng: random.Random, filler: list[str]) -> list[str]:
    """Words of a notice with some dropped, and foreign ones before, after and between."""
    out = [w for w in words if rng.random() > 0.08]
    for _ in range(rng.randrange(4)):
        out.insert(rng.choice((0, len(out))), rng.choice(filler))
    if rng.random() < 0.3 and out:
        out.insert(rng.randrange(len(out)), rng.choice(filler))
    return out


def train(docs: DataFrame, seed: int = 0) -> Model:
    """Fits on disturbed notices and on at most LINES distinct lines of the corpus (a bound).

    The lines, of which LINE_CHARS characters count, are taken as unknown, but for those that
    hold most of a notice.
    """
    corpus = [words_of(x) for x in sample(docs)]
    known = [ngrams(words_of(t)) for texts in NOTICES.values() for t in texts]
    corpus = [w for w in corpus if not any(len(g & ngrams(w)) > 0.5 * len(g) for g in known)]
    filler = sorted({w for line in corpus for w in line}) or ["lorem", "ipsum"]
    rng = random.Random(seed)
    classes = (UNKNOWN, *NOTICES)
    rows = [(ngrams(w), 0) for w in corpus]
    for k, texts in enumerate(NOTICES.values(), 1):
        for t in texts:
            words = words_of(t)
            rows += [(ngrams(words), k)] * 5 + [(ngrams(disturbed(words, rng, filler)), k) for _ in range(COPIES)]
            # Its words in another order, and a few of them only, are no notice.
            for _ in range(COPIES // 4):
                foreign = ngrams(rng.sample(words, len(words)) + [rng.choice(filler)]), ngrams([*words[:2], *rng.choices(filler, k=6)])
                rows += [(x, 0) for x in foreign if not any(len(g & x) > 0.4 * len(g) for g in known)]
    rng.shuffle(rows)
    place = {g: i for i, g in enumerate(sorted(set().union(*known)))}
    w, b = fit([(sorted(place[g] for g in x if g in place), y) for x, y in rows], len(place), len(classes))
    return Model(classes, {g: [float(v) for v in w[i]] for g, i in place.items()}, [float(v) for v in b])


def sample(docs: DataFrame) -> list[str]:
    """The beginnings of the LINES distinct lines of least hash.

    Lines are first cut by a hash threshold for a few times as many, from the number of all
    lines, and copies are merged, so tasks and the driver hold about as many at any size.
    """
    text = common.text_of(docs)
    total = line_count(docs.select(text.alias("text")))
    share = min(1.0, 8 * LINES / max(total, 1))
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).filter("line <> ''").select(F.left("line", F.lit(LINE_CHARS)).alias("line")).withColumn("hash", F.xxhash64("line"))
    lines = lines.filter(F.col("hash") <= F.lit(int(-(2**63) + share * (2**64 - 1) // 1)).cast("long")) if share < 1 else lines
    return [r["line"] for r in lines.distinct().orderBy("hash", "line").limit(LINES).collect()]


def fit(rows: list[tuple[list[int], int]], n: int, classes: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression with ridge by full-batch Adam on sparse rows."""
    at = np.array([i for i, (x, _) in enumerate(rows) for _ in x], np.int64)
    col = np.array([c for x, _ in rows for c in x], np.int64)
    y = np.eye(classes)[[v for _, v in rows]]
    p = np.zeros((n + 1, classes))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, steps + 1):
        z = np.zeros((len(rows), classes)) + p[n]
        np.add.at(z, at, p[col])
        e = np.exp(z - z.max(1, keepdims=True))
        d = (e / e.sum(1, keepdims=True) - y) / max(len(rows), 1)
        g = 1e-5 * p
        np.add.at(g, col, d[at])
        g[n] = d.sum(0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return p[:n], p[n]


def passages(rows: DataFrame) -> DataFrame:
    """(rid, start, gram, at, end, place) of rows (rid, text): the n-grams of every run of lines without a blank one.

    start, at and end are the lines where the run begins and where the n-gram begins and ends,
    place is its first word's place in the run.
    """

    def runs(lines: Column) -> Column:
        blank = lambda i: F.trim(F.translate(F.get(lines, i), "\t\r\f\v", "    ")) == ""
        first = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~blank(i) & ((i == 0) | blank(i - 1)))
        return F.transform(F.array(first), lambda f: F.transform(f, lambda i, k: F.struct(i.alias("start"), F.slice(lines, i + 1, F.coalesce(F.get(f, k + 1), F.size(lines)) - i).alias("lines"))))[0]

    rows = rows.select("rid", F.split("text", "\n").alias("lines"))
    rows = rows.select("rid", F.explode(runs(F.col("lines"))).alias("run")).select("rid", F.col("run.start").alias("start"), F.col("run.lines").alias("lines"))
    found = F.flatten(F.transform("lines", lambda line, i: F.transform(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)), lambda w: F.struct(w.alias("w"), (F.col("start") + i).alias("at")))))

    def joined(w: Column, n: int) -> Column:
        each = lambda i: F.struct(F.concat_ws(" ", *[w[i + k]["w"] for k in range(n)]).alias("gram"), w[i]["at"].alias("at"), w[i + n - 1]["at"].alias("end"), i.alias("place"))
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: i + n <= F.size(w)), each)

    x = F.explode(F.transform(F.array(found), lambda w: F.concat(joined(w, 2), joined(w, 3)))[0]).alias("x")
    return rows.select("rid", "start", x).select("rid", "start", "x.*")


def scan(rows: DataFrame, model: Model) -> DataFrame:
    """(rid, found) of rows (rid, text): found is array<struct<at, family, probability, likeness, confirmed>>.

    A row for every text with a believed paragraph. Of the groups of lines of a run, one is there
    for each family that is confirmed in them but on no line of theirs, with the line where its
    n-grams begin. The probability that is believed is calibrated on all lines: so that of those
    that no notice confirms, ALARMS of all lines at most are believed, within BELIEF.
    """
    spark = rows.sparkSession
    c = len(model.classes)
    weights = list(model.weights.items())
    table = spark.createDataFrame([(g, k, w) for k, (g, w) in enumerate(weights)], "gram string, id int, weights array<double>")
    # The weights are those of the notices' n-grams: a fixed number of rows.
    hits = passages(rows).join(F.broadcast(table.select("gram", "id")), "gram")
    half = F.floor(F.col("place") / (GROUP // 2)).cast("int")
    own = F.when(F.col("at") == F.col("end"), F.array(F.struct(F.col("at").alias("line"), F.lit(-1).alias("part")))).otherwise(F.array().cast("array<struct<line:int,part:int>>"))
    keys = F.concat(own, F.array(*[F.struct(F.lit(-1).alias("line"), x.alias("part")) for x in (half, half + 1)]))
    hits = hits.select("rid", "start", "at", "end", "id", F.explode(keys).alias("key")).select("rid", "start", "key.line", "key.part", "id", "at", "end")
    where = ["rid", "start", "line", "part"]
    hits = hits.groupBy(*where, "id").agg(F.min("at").alias("at"), F.max("end").alias("end")).join(F.broadcast(table), "id")
    sums = [F.sum(F.col("weights")[k]).alias(f"z{k}") for k in range(c)]
    each = hits.groupBy(*where).agg(*sums, F.collect_set("gram").alias("grams"), F.min("at").alias("at"), F.max("end").alias("end"))
    each = each.filter("line >= 0 OR at < end")
    z = F.array(*[F.col(f"z{k}") + F.lit(model.bias[k]) for k in range(c)])
    best = each.select(*where, "at", "grams", z.alias("z")).withColumn("top", F.array_max("z"))
    best = best.withColumn("class", F.array_position("z", F.col("top")).cast("int") - 1).filter("class > 0")
    spread = F.aggregate("z", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("top")))
    best = best.withColumn("probability", 1 / spread).filter(F.col("probability") >= BELIEF[0])
    notices = spark.createDataFrame([(k, sorted(x for x in ngrams(words_of(t)) if x.count(" ") == 1)) for k, texts in enumerate(NOTICES.values(), 1) for t in texts], "k int, pairs array<string>")
    notices = notices.groupBy("k").agg(F.collect_list("pairs").alias("notices"))
    compared = best.join(F.broadcast(notices), F.col("class") == F.col("k"))
    like = F.array_max(F.transform("notices", lambda n: F.size(F.array_intersect(n, F.col("grams"))) / F.size(n)))
    compared = common.stored(compared.withColumn("likeness", like).select(*where, "at", "class", "probability", "likeness"), "licence-paragraphs")
    names = F.array(*[F.lit(x) for x in model.classes])
    x = F.struct("at", names[F.col("class")].alias("family"), "probability", "likeness", (F.col("likeness") >= CONFIRM).alias("confirmed"))
    believed = compared.filter(F.col("probability") >= belief(rows, compared))
    found = believed.filter((F.col("line") >= 0) | (F.col("likeness") >= CONFIRM)).withColumn("x", x)
    # The likeliest group of a run for each family, unless a line of the run has it already.
    group = F.max(F.when(F.col("line") < 0, F.struct("likeness", "x")))["x"]
    of_run = found.groupBy("rid", "start", "class").agg(F.collect_list(F.when(F.col("line") >= 0, F.col("x"))).alias("lines"), group.alias("group"))
    add = F.col("group").isNotNull() & ~F.exists("lines", lambda v: v["confirmed"])
    of_run = of_run.select("rid", F.when(add, F.concat("lines", F.array("group"))).otherwise(F.col("lines")).alias("xs"))
    return of_run.groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("xs"))).alias("found"))


def line_count(rows: DataFrame) -> int:
    """Lines of all texts."""
    return rows.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0


def belief(rows: DataFrame, compared: DataFrame) -> float:
    """The least probability that is believed, calibrated on all lines of rows."""
    total = line_count(rows)
    foreign = compared.filter((F.col("line") >= 0) & (F.col("likeness") < CONFIRM))
    n = foreign.count()
    if n <= ALARMS * total:
        return BELIEF[0]
    cut = foreign.agg(F.percentile_approx("probability", 1 - ALARMS * total / n, 10_000)).first()[0]
    return min(max(float(cut), BELIEF[0]), BELIEF[1])


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_believed, n_confirmed, families, paragraphs) of every row.

    families: confirmed ones, sorted, comma-joined; paragraphs: at:family of the believed ones,
    in text order. A null text counts as empty and has none; very long texts are taken whole;
    repeated rows give repeated rows; other columns are ignored. Of families of equal score the
    first of the list counts. An empty table gives an empty table.
    """
    rows = common.numbered(docs).select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), "text")
    found = scan(rows.select("rid", "text"), train(docs))
    out = rows.select("rid", "doc_id").join(found, "rid", "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    sure = F.filter("found", lambda x: x["confirmed"])
    return out.select(
        "doc_id",
        F.size("found").cast("long").alias("n_believed"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["at"], x["family"])), ",").alias("paragraphs"),
    )
