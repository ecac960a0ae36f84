"""Licence scans: a trained classifier of paragraphs, a calibrated unknown class, and a comparison with the templates.

A text falls into paragraphs at blank lines, comment marks at line starts set aside. The units of a paragraph are itself, its
lines and its sentences, so a notice is found when it is wrapped, when it stands between lines of other text, and when it
is one sentence of many. A unit's family is predicted by a multinomial logistic regression on word unigrams and bigrams, and
holds only if the unit has at least `SHARE` of the word pairs of a notice of that family and a probability of at least the
calibrated one; any other unit is `unknown`.

Most text needs no score: a unit with `SHARE` of a notice's n pairs has one of any n - ceil(SHARE * n) + 1 of them. `KEYS` are
a few words that so many pairs of each notice hold, so a unit without any of these pairs cannot be confirmed, whatever its score. The
class "none" is learned from the sentences below and from a bounded sample of the corpus's own units that do get a score but
hold no notice's pairs; every second one is held out, and sets the least probability together with clipped notices.

All of it is DataFrame functions and Spark's own learner. Weights and notices are one table of the notices' grams, of fixed
size. No unit text is a shuffle key, so a line that a third of all documents have is no hot key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmill.llm.common import cut, let

SAMPLE, LEAST, SHARE = 400, 0.5, 0.6
NONE, UNKNOWN = "none", "unknown"
# Usual notices of licence families.
NOTICES = (
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("boost", "SPDX-License-Identifier: BSL-1.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl", "SPDX-License-Identifier: EPL-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc", "Licensed under the ISC License."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("public-domain", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "SPDX-License-Identifier: Zlib"),
    (NONE, "The driver showed the officer a license and a registration."),
    (NONE, "The city granted the restaurant permission to serve food on the terrace."),
    (NONE, "All rights reserved. No part of this page may be copied without permission."),
    (NONE, "Copyright by the authors."),
    (NONE, "The warranty covers parts and labour for two years."),
    (NONE, "A poet takes licence with the facts, and the public forgives it."),
    (NONE, "Your licence fee is due in March; the terms are on the back of the form."),
    (NONE, "The software was released in version 3 and the work was done by the foundation."),
    (NONE, "The general public is free to use the library on weekdays."),
    (NONE, "The conditions of the contract were modified in writing."),
    (NONE, "See the accompanying documentation for the source of this copy."),
    (NONE, "Distribution of the materials is permitted in the following cities."),
    (NONE, "The foundation published a list of redistributions of land."),
    (NONE, "An international association of authors is available for attribution."),
    (NONE, "The file can be obtained from the office subject to the usual restrictions."),
    (NONE, "Without limitation of its liability the company will repair the damages."),
)
FAMILIES = sorted({f for f, _ in NOTICES})
TEMPLATES = [(f, t) for f, t in NOTICES if f != NONE]
# Words that are common anywhere.
USUAL = frozenset("a an and any are as at be by can for from if in is it not of on or should that the this to under use was will with you your".split())
# Comment marks at line starts.
MARKS = r"(?m)^[ \t]*(?:(?:#+|//+|/\*+|\*+/?|;+|%+|--+|<!--)[ \t]*)?"


def plain_words(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def plain_pairs(text: str) -> list[str]:
    w = plain_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def least_pairs(n: int, share: float = SHARE) -> int:
    """How many of a notice's n pairs must be in a set, so that every unit with `share` of the n has one of the set."""
    return n - math.ceil(share * n) + 1


def key_words() -> list[str]:
    """Words of which every unit that can be confirmed holds one, as a part of its text: in each notice enough pairs have one of them.

    Taken greedily: the word that adds most to what the notices still lack, longer words first as they are rarer.
    """
    notices = [plain_pairs(t) for _, t in TEMPLATES]
    covered: list[set[str]] = [set() for _ in notices]
    lack = lambda k: least_pairs(len(notices[k])) - len(covered[k])
    open_words = sorted({w for p in notices for q in p for w in q.split()} - USUAL)
    weight = {w: 1 if len(w) >= 8 else 1.6 if len(w) >= 6 else 3 if len(w) >= 4 else 5 if len(w) > 1 else 50 for w in open_words}
    has = {w: [{q for q in p if any(w in x for x in q.split())} for p in notices] for w in open_words}
    gain = lambda w: sum(min(lack(k), len(own - covered[k])) / least_pairs(len(notices[k])) for k, own in enumerate(has[w]) if lack(k) > 0) / weight[w]
    out = []
    while any(lack(k) > 0 for k in range(len(notices))):
        best = max(open_words, key=lambda w: (gain(w), w))
        out.append(best)
        covered = [c | own for c, own in zip(covered, has[best], strict=True)]
    return out


KEYS = key_words()


def needed_pairs() -> list[str]:
    """Word pairs of which every unit that can be confirmed has one: those pairs of the notices that hold a key word."""
    return sorted({q for _, t in TEMPLATES for q in plain_pairs(t) if any(w in x for x in q.split() for w in KEYS)})


def needs(text: Column) -> Column:
    """Whether a unit of this text may be confirmed: a key word is a part of it, then a needed pair stands in it. Exact, as no other unit has enough of a notice."""
    low = F.lower(text)
    part = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in KEYS))
    needed = F.array(*map(F.lit, needed_pairs()))
    return part & let(words(text), lambda w: F.arrays_overlap(pairs(w), needed))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def pairs(w: Column) -> Column:
    """Neighbouring words of an array, in order; a single word is its own pair."""
    n = F.size(w)
    both = F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n < 2, w).otherwise(both)


def grams(text: Column) -> Column:
    """The distinct words and word pairs of a text; a single word is its own pair."""
    return let(words(text), lambda w: F.array_distinct(F.concat(w, pairs(w))))


def paragraphs(text: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\r", ""), MARKS, ""), r"\n(?:[ \t]*\n)+")


def units_of(paragraph: Column) -> Column:
    """A paragraph, its lines and its sentences, white space collapsed, each once."""
    whole = F.trim(F.regexp_replace(paragraph, r"\s+", " "))
    lines = F.transform(F.split(paragraph, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.concat(F.array(whole), lines, F.split(whole, r"(?<=[.!?;]) ")))


def units(docs: DataFrame) -> DataFrame:
    """at (a document row), doc_id, paragraph, row (a unit), unit: the units that can be confirmed."""
    own = F.filter(paragraphs(F.col("text")), needs)
    at = docs.select("doc_id", "text").where(needs(F.col("text"))).select("doc_id", F.monotonically_increasing_id().alias("at"), own.alias("own"))
    spread = at.select("doc_id", "at", F.posexplode("own").alias("paragraph", "p"))
    found = spread.select("doc_id", "at", "paragraph", F.explode(F.filter(units_of(F.col("p")), needs)).alias("unit"))
    return found.select("at", "doc_id", "paragraph", F.monotonically_increasing_id().alias("row"), "unit")


@dataclass(frozen=True)
class Model:
    table: DataFrame  # gram, w: its weight in each family, then 1 for each notice that has it as a pair
    bias: tuple[float, ...]
    least: float


def judged(rows: DataFrame, model: Model) -> DataFrame:
    """row, k (the most probable family, the first of equals), probability, share (the most of a notice of that family) of rows(row, unit)."""
    n = len(FAMILIES)
    hits = rows.select("row", F.explode(grams(F.col("unit"))).alias("gram")).join(F.broadcast(model.table), "gram")
    sums = hits.groupBy("row").agg(*(F.sum(F.get("w", F.lit(k))).alias(f"s{k}") for k in range(n + len(TEMPLATES))))
    logits = F.array(*(F.col(f"s{k}") + b for k, b in enumerate(model.bias)))
    share = {f: F.greatest(F.lit(0.0), F.lit(0.0), *(F.col(f"s{n + k}") / len(plain_pairs(t)) for k, (g, t) in enumerate(TEMPLATES) if g == f)) for f in FAMILIES}
    shares = F.array(*(share[f] for f in FAMILIES))
    out = sums.select("row", logits.alias("logits"), shares.alias("shares")).withColumn("top", F.array_max("logits"))
    out = out.withColumn("k", (F.array_position("logits", F.col("top")) - 1).cast("int"))
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return out.select("row", "k", (1 / total).alias("probability"), F.get("shares", F.col("k")).alias("share"), F.array_max("shares").alias("most"))


def sample_of(found: DataFrame, n: int) -> DataFrame:
    """row, unit: at most n units of the corpus, by hash of the unit; about as many are read."""
    rows = max(1, found.count())
    place = F.pmod(F.xxhash64("unit"), F.lit(1_000_000))
    some = found.where(place < int(min(1.0, 4 * n / rows) * 1_000_000)).select("unit", place.alias("place")).distinct()
    return some.orderBy("place", "unit").limit(n).select(F.monotonically_increasing_id().alias("row"), "unit")


def fit(spark: SparkSession, rows: list[tuple[str, str]]) -> Model:
    """A model of labelled units (family, unit), with the least probability still open."""
    frame = spark.createDataFrame([(t, float(FAMILIES.index(f))) for f, t in rows], "unit string, label double")
    frame = frame.select(grams(F.col("unit")).alias("grams"), "label").coalesce(1)
    notices = spark.createDataFrame([(t,) for _, t in NOTICES], "unit string").select(grams(F.col("unit")).alias("grams")).coalesce(1)
    counter = CountVectorizer(inputCol="grams", outputCol="x", binary=True).fit(notices)
    model = LogisticRegression(featuresCol="x", family="multinomial", regParam=0.01, maxIter=40).fit(counter.transform(frame))
    matrix, has = model.coefficientMatrix.toArray(), [set(plain_pairs(t)) for _, t in TEMPLATES]
    table = [(g, [float(x) for x in matrix[:, k]] + [float(g in h) for h in has]) for k, g in enumerate(counter.vocabulary)]
    if len(matrix) != len(FAMILIES):
        raise ValueError("every family needs a labelled unit")
    return Model(spark.createDataFrame(table, "gram string, w array<double>"), tuple(map(float, model.interceptVector)), 0.0)


def train(found: DataFrame, sample: int = SAMPLE) -> Model:
    """The model for the units `found`: notices against other units like those that it will score.

    Corpus units that hold no notice's pairs are negatives. Every second negative is held out; the least probability lets at
    most one in a hundred of those pass, but no more than five in a hundred of clipped notices (without their first word and
    last tenth) may be lost by it.
    """
    spark = found.sparkSession
    fixed = [t for f, t in NOTICES if f == NONE]
    first = fit(spark, list(NOTICES))
    some = cut(sample_of(found, sample))
    own = some.join(judged(some, first), "row", "left").where(F.coalesce("most", F.lit(0.0)) < SHARE).orderBy("row").select("unit").limit(sample)
    others = [*fixed, *(r["unit"] for r in own.collect())]
    model = fit(spark, [*TEMPLATES, *((NONE, t) for t in others[::2])])
    clip = lambda t: " ".join(t.split()[1 : max(2, math.ceil(0.9 * len(t.split())))])
    held = [(k, 0, t) for k, t in enumerate(others[1::2])] + [(-1 - k, 1, clip(t)) for k, (_, t) in enumerate(TEMPLATES)]
    frame = spark.createDataFrame(held, "row long, real int, unit string").coalesce(1)
    rows = judged(frame.select("row", "unit"), model).join(frame, "row").select("real", F.when(F.col("k") == FAMILIES.index(NONE), 0.0).otherwise(F.col("probability")).alias("p")).collect()
    rank = lambda real, share: (lambda p: p[min(len(p) - 1, int(share * len(p)))] if p else LEAST)(sorted(r["p"] for r in rows if r["real"] == real))
    return Model(model.table, model.bias, min(max(LEAST, rank(0, 0.99)), rank(1, 0.05)))


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_units, n_confirmed, n_unknown, families: one row per doc_id of docs.

    n_units: paragraphs with a unit that was scored; n_confirmed: those with one that was confirmed; families: of the confirmed
    ones, sorted, comma-joined. Null and empty texts have none; very long texts are read whole. Repeated rows of a doc_id
    add up, a null doc_id is a row of its own. Of equally probable families the first by name is taken. Extra columns are
    ignored; an empty table gives no row.
    """
    found = cut(units(docs))
    model = train(found, sample)
    known = judged(found.select("row", "unit"), model)
    sure = (F.col("k") != FAMILIES.index(NONE)) & (F.col("probability") > model.least - 1e-12) & (F.col("share") >= SHARE)
    bit = F.when(sure, F.pow(F.lit(2.0), F.col("k")).cast("long")).otherwise(F.lit(0).cast("long"))
    each = found.select("at", "doc_id", "paragraph", "row").join(known.select("row", bit.alias("bits")), "row", "left")
    each = each.groupBy("at", "doc_id", "paragraph").agg(F.bit_or(F.coalesce("bits", F.lit(0).cast("long"))).alias("bits"))
    zero = docs.select("doc_id", F.lit(0).alias("n"), F.lit(0).cast("long").alias("bits"))
    out = each.select("doc_id", F.lit(1).alias("n"), "bits").union(zero).groupBy("doc_id").agg(F.sum("n").alias("n_units"), F.count(F.when(F.col("bits") != 0, 1)).alias("n_confirmed"), F.bit_or("bits").alias("bits"))
    names = F.array_compact(F.array(*(F.when(F.getbit("bits", F.lit(k)) == 1, F.lit(f)) for k, f in enumerate(FAMILIES))))
    return out.select("doc_id", "n_units", "n_confirmed", (F.col("n_units") - F.col("n_confirmed")).alias("n_unknown"), F.array_join(names, ",").alias("families"))
