r"""Licence scans: a trained paragraph classifier, with DataFrame and Spark ML functions only.

Paragraphs are lines, put together where a line break only wraps a sentence. Their sets of words and
word pairs go through a multinomial logistic regression over the licence families, ``other`` (licences
that are none of them) and ``none``. Training notices are made here: names and standard sentences of
the families in common frames and sentences that use the same words otherwise; the
rows, 1,390 with the held-out ones, are these alone, whatever the corpus.

A part is held out, with families that training never sees (``HELD_OTHER``). On it the probabilities
are calibrated by one temperature, the one of least loss, and the bound below which a licence-like
paragraph is ``unknown`` is the least that keeps all but ``FALSE_SHARE`` of the held-out rows of
other licences and of none out of the families (``reliability`` has the figures). A prediction is
confirmed when the paragraph holds ``CONFIRM`` of the words of a whole template, a name or a sentence,
of its family; what is not confirmed is ``unknown`` too.

Defined results: a row for each licence-like paragraph; null and empty texts have none; a paragraph
of any length is read whole; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored. Ties between families go to the one that sorts first.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

NONE, OTHER, UNKNOWN = "none", "other", "unknown"
#: Share of a template's words that a paragraph must hold to confirm its family.
CONFIRM = 0.85
#: Held-out rows of other licences and of none that may pass for a family.
FALSE_SHARE = 0.01
REGULARISATION = 1e-3
STEPS = 60
TEMPERATURES = tuple(round(0.1 * 1.2**k, 4) for k in range(20))
#: A template of fewer than three words confirms only beside one of these, or alone.
LICENCE_WORDS = ("license", "licence", "licensed", "licenses", "licensing", "spdx-license-identifier", "copyright")

# Names and standard sentences of each family: fixed public wording.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL version 3", "AGPLv3", "AGPL-3.0 license"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "new BSD license", "BSD 3-Clause", "BSD-3-Clause"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY 3.0 license", "CC BY"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC license"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 License", "CC BY-SA 4.0", "CC-BY-SA 3.0 license"],
    "cc0": ["CC0 1.0 Universal public domain dedication", "CC0", "CC0 1.0"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License version 2 or later", "GNU GPL v3", "GPLv3", "GPL-2.0 license", "GPL version 2"],
    "isc": ["ISC License", "ISC license terms"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPLv3", "LGPL-2.1 license"],
    "mit": ["MIT License", "MIT license terms", "Expat MIT license", "MIT"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0 license"],
    "unlicense": ["Unlicense", "The Unlicense public domain"],
}
OTHERS = {
    "boost": ["Boost Software License 1.0", "BSL-1.0"], "cddl": ["Common Development and Distribution License, version 1.1", "CDDL-1.1"], "eupl": ["European Union Public Licence 1.2", "EUPL-1.2"],
    "ofl": ["SIL Open Font License 1.1", "OFL-1.1"], "php": ["PHP License, version 3.01", "PHP-3.01"], "postgres": ["PostgreSQL License", "PostgreSQL"], "psf": ["Python Software Foundation License 2.0", "PSF-2.0"],
    "ruby": ["Ruby License", "Ruby"], "wtfpl": ["Do What The F Public License", "WTFPL"], "zlib": ["zlib License", "Zlib"], "proprietary": ["proprietary license of the company", "commercial license agreement"],
}
HELD_OTHER = {
    "artistic": ["Artistic License 2.0", "Artistic-2.0"], "epl": ["Eclipse Public License 2.0", "EPL-2.0"], "mspl": ["Microsoft Public License", "MS-PL"], "ncsa": ["University of Illinois NCSA Open Source License", "NCSA"],
    "osl": ["Open Software License 3.0", "OSL-3.0"], "sspl": ["Server Side Public License, version 1", "SSPL-1.0"], "vim": ["Vim License", "Vim"],
}
SENTENCES = {
    "apache": ["you may not use this file except in compliance with the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
FRAMES = ["Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the terms of the {}.", "This software is available under the {}", "This project is free software under the {}, see the LICENSE file", "License: {}", "SPDX-License-Identifier: {}", "Code may be used under the {}; all copyright notices must be kept", "{}", "Copyright (c) 2020 the authors. Use of this source code is governed by the {}."]
COUNTER = [
    "Released under pressure, the film was shown on Friday.", "The new version was released under the old name.", "This work is about the general public and its health.",
    "The driver lost the license after the crash.", "She applied for a fishing license in May.", "The software is a free download, version 2.0 or later.",
    "MIT researchers described the work in a paper.", "He studied at MIT and at a university in Berlin.", "The Apache helicopter landed near the village.", "Apache is a county in Arizona.",
    "The Mozilla foundation hosted a public event.", "Creative people share a common space.", "The attribution of the painting is uncertain.", "A non commercial radio station.",
    "The public domain of the kingdom grew.", "General terms of use of the library apply to the public.", "Permission to enter is granted to any person with a ticket.", "You may obtain a copy of the report at the office.",
    "The above notice shall be read in public.", "This program is shown on television.", "The source of the river and its binary star.", "Use of the road is permitted with conditions.",
    "The terms of the contract were agreed to in writing.", "Unless required by law, do not write to the office.", "Distributed under the trees, the seeds grew.", "A license plate was found under the bridge.",
    "Licensed drivers only.", "The bar is licensed to sell wine.", "See the file for details.", "Version 3 of the plan was published.", "GNU is an animal of the plains.", "The project is free and open to all.",
    "This software is late.", "Code may be used twice.", "The identifier is 4.0.", "By 4.0 percent.", "The license of the bar was renewed last week by the council.", "License plates are made of metal.", "License holders must renew in June.", "He studied at MIT in Boston.",
    "A degree from MIT is not cheap.", "She got her license at the age of twenty.", "The council renewed the liquor license of the hotel.", "His license to practise was withdrawn.", "Poetic license is needed here.", "Without a license nobody may hunt here.",
    "The license fee is paid each year by the public.", "A student license costs less.", "The term of the license ends in May.", "License", "Version 2.0", "Software", "All copies must be kept.", "The library is subject to the terms of the loan.", "",
]


#: What looks like the short name of a licence of some version; tried once a run of letters.
MARKED = r"(?<![a-z])([a-z]++-[0-9][0-9.]*+)"
#: A word, without points at its end. Nothing is tried twice or nested, so a run of any length costs its length.
WORD = r"(?<!\.)\.*+[a-z0-9+-]++(?:\.++[a-z0-9+-]++)*+"


def words(text: Column) -> Column:
    """Lower-cased words of a paragraph; points, plus and hyphens stay inside them, and ``name-2.0`` has a mark before it."""
    low = F.lower(text)
    marked = F.when(text.contains("-") & text.rlike("-[0-9]"), F.regexp_replace(low, MARKED, "idmark $1")).otherwise(low)
    return F.regexp_extract_all(marked, F.lit(WORD), F.lit(0))


# A line break that wraps a sentence: the next line goes on in small letters, capitals go on in capitals,
# or the line ends in a word that needs another. Marks of comments before the next line are taken with it.
WRAP = (
    r"""\r?\n(?:(?:(?<=[^\s.!?:;]\n)|(?<=[^\s.!?:;]\r\n))[ \t#*/]*(?=[a-z("])|(?:(?<=[A-Z,]\n)|(?<=[A-Z,]\r\n))[ \t#*/]*(?=[A-Z]{2})"""
    r"""|(?:(?<=\bthe\n)|(?<=\bof\n)|(?<=\bunder\n)|(?<=\ba\n)|(?<=\bGNU\n))[ \t#*/]*(?=[A-Z]))"""
)


def paragraphs(text: Column) -> Column:
    return F.split(F.regexp_replace(text, WRAP, " "), "\n", -1)


def _examples() -> list[tuple[str, str, bool]]:
    """(text, class, held out)."""
    out = []
    for family, names in NAMES.items():
        for i, name in enumerate(names):
            out += [(f.format(name), family, (i + j) % 4 == 3) for j, f in enumerate(FRAMES)]
        out += [(s, family, False) for s in SENTENCES.get(family, [])]
        out += [(f"{s}. {f.format(names[0])}", family, j % 4 == 3) for s in SENTENCES.get(family, []) for j, f in enumerate(FRAMES[:4])]
    for held, families in ((False, OTHERS), (True, HELD_OTHER)):
        out += [(f.format(name), OTHER, held) for names in families.values() for name in names for f in FRAMES]
    out += [(s, NONE, i % 4 == 3) for i, s in enumerate(COUNTER)]
    # Pairs of counter-examples hold more of the shared words than one does.
    n = len(COUNTER)
    out += [(f"{COUNTER[i]} {COUNTER[(i * 7 + k) % n]}", NONE, i % 4 == 3) for i in range(n) for k in (1, 3, 5)]
    return out


def _features(df: DataFrame, col: str = "_words") -> DataFrame:
    """Words and word pairs, in ``_grams``; the vectors count each once."""
    # Marks of both ends: a paragraph that begins or ends with a word differs from one that has it within.
    bounded = df.withColumn("_bounded", F.concat(F.array(F.lit("<s>")), F.col(col), F.array(F.lit("</s>"))))
    pairs = NGram(n=2, inputCol="_bounded", outputCol="_pairs").transform(bounded)
    return pairs.withColumn("_grams", F.concat(F.col(col), F.col("_pairs"))).drop("_pairs", "_bounded")


class Classifier:
    """Classes in the order of their probabilities: none, other, then the families."""

    def __init__(self, vectors: CountVectorizerModel, model: LogisticRegressionModel, temperature: float = 1.0, least: float = 0.5):
        self.classes = [NONE, OTHER, *sorted(NAMES)]
        self.vectors, self.model, self.temperature, self.least = vectors, model, temperature, least

    def raw(self, df: DataFrame) -> DataFrame:
        """``df`` (with _words) with _q, the regression's probabilities."""
        found = self.model.transform(self.vectors.transform(_features(df)))
        return _once(found, _q=vector_to_array("_probability")).drop("_vector", "_probability", "_raw", "_prediction", "_grams")

    def scored(self, df: DataFrame) -> DataFrame:
        """``df`` (with _words) with _p, calibrated probabilities, _best, the largest of a family's, and that _family."""
        return _calibrated(self.raw(df), F.lit(self.temperature), self.classes)

    def like(self, df: DataFrame) -> DataFrame:
        """The rows of ``scored`` in which none has less than half."""
        # What the temperature could bring below a half, by a bound that holds for any shares of the others.
        first = F.element_at("_q", 1)
        near = (1 - first) * max(1.0, (len(self.classes) - 1) ** (self.temperature - 1)) >= first
        return _calibrated(self.raw(df).where(near), F.lit(self.temperature), self.classes).where(F.element_at("_p", 1) < 0.5)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that later steps read and never compute again, as they would if filters were pushed below."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _calibrated(df: DataFrame, temperature: Column, classes: list[str]) -> DataFrame:
    df = _once(df, _w=F.transform("_q", lambda x: F.pow(x, 1 / temperature)))
    df = _once(df, _s=F.aggregate("_w", F.lit(0.0), lambda a, x: a + x))
    df = _once(df, _p=F.transform("_w", lambda x: x / F.col("_s"))).drop("_w", "_s", "_q")
    own = F.slice("_p", 3, len(classes) - 2)
    df = _once(df, _best=F.array_max(own))
    return _once(df, _family=F.element_at(F.array(*map(F.lit, classes[2:])), F.array_position(own, F.col("_best")).cast("int")))


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _training(spark: SparkSession) -> DataFrame:
    place = {c: i for i, c in enumerate([NONE, OTHER, *sorted(NAMES)])}
    rows = [{"text": t, "label": float(place[f]), "held": h} for t, f, h in _examples()]
    return _local(spark, rows, "text:string,label:double,held:boolean").withColumn("_words", words(F.col("text")))


def train(spark: SparkSession) -> Classifier:
    """Fit and calibrate on the notices of this module; the same in every session."""
    data = _features(_training(spark))
    grams = sorted(r[0] for r in data.where("not held").select(F.explode("_grams")).distinct().collect())
    vectors = CountVectorizerModel.from_vocabulary(grams, inputCol="_grams", outputCol="_vector", minTF=1.0, binary=True)
    fit = vectors.transform(data.where("not held")).coalesce(1).cache()
    lr = LogisticRegression(featuresCol="_vector", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", regParam=REGULARISATION, maxIter=STEPS, family="multinomial")
    made = Classifier(vectors, lr.fit(fit))
    fit.unpersist()
    held = made.raw(data.where("held").drop("_grams")).select("label", "_q").cache()
    tried = _calibrated(held.withColumn("t", F.explode(F.array(*map(F.lit, TEMPERATURES)))), F.col("t"), made.classes)
    loss = tried.groupBy("t").agg(F.avg(-F.log(F.greatest(F.element_at("_p", (F.col("label") + 1).cast("int")), F.lit(1e-12)))).alias("loss"))
    made.temperature = loss.orderBy("loss", "t").first().t
    # The bound is the quantile of what held-out rows of no family reach.
    wrong = _calibrated(held.where("label < 2"), F.lit(made.temperature), made.classes)
    reached = wrong.agg(F.percentile("_best", 1 - FALSE_SHARE)).first()[0]
    held.unpersist()
    made.least = min(0.95, max(0.5, math.ceil(reached * 1000) / 1000))
    return made


def reliability(spark: SparkSession, made: Classifier) -> DataFrame:
    """Held-out rows by tenths of the largest probability: bin, n, confidence, accuracy."""
    held = made.scored(_training(spark).where("held"))
    top = F.array_max("_p")
    right = (F.array_position("_p", top) - 1 == F.col("label")).cast("double")
    return held.groupBy(F.least(F.floor(top * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(top).alias("confidence"), F.avg(right).alias("accuracy"))


def _templates() -> dict[str, list[str]]:
    return {f: [*names, *SENTENCES.get(f, [])] for f, names in NAMES.items()}


def classify(docs: DataFrame, model: Classifier, id_col="doc_id", text_col="text") -> DataFrame:
    """A row for each licence-like paragraph: doc_id, paragraph (its place), licence, nearest, probability, similarity."""
    spark = docs.sparkSession
    every = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(paragraphs(F.col(text_col))).alias("paragraph", "_text"))
    every = _once(every, _words=words(F.col("_text"))).drop("_text")
    like = model.like(every.where(F.size("_words") > 0))
    # One small row of all templates; only licence-like paragraphs are compared.
    rows = [{"family": f, "text": t} for f, ts in _templates().items() for t in ts]
    table = _local(spark, rows, "family:string,text:string").select("family", F.array_distinct(words(F.col("text"))).alias("t")).groupBy("family").agg(F.collect_list("t").alias("_templates"))
    joined = like.join(F.broadcast(table), F.col("_family") == F.col("family"))
    mine = F.array_distinct(F.col("_words"))
    told = F.arrays_overlap(mine, F.array(*map(F.lit, LICENCE_WORDS)))
    shared = F.transform("_templates", lambda t: F.when((F.size(t) > 2) | told | (F.size(mine) == F.size(t)), F.size(F.array_intersect(mine, t)) / F.size(t)).otherwise(0.0))
    out = joined.withColumn("similarity", F.array_max(shared))
    sure = (F.col("_best") >= model.least) & (F.col("similarity") >= CONFIRM)
    return out.select("doc_id", "paragraph", F.when(sure, F.col("_family")).otherwise(UNKNOWN).alias("licence"), F.col("_family").alias("nearest"), F.col("_best").alias("probability"), "similarity")


def op9_licences(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), train(spark))


def brute_force(rows: list[tuple[int, str | None]], model: Classifier) -> list[tuple]:
    """(doc_id, paragraph, licence, nearest, probability, similarity), rounded, from the coefficients in plain Python."""

    def split(text):
        plain = re.sub(r"\.+( |$)", " ", re.sub(r"[^a-z0-9.+-]+", " ", re.sub(r"([a-z]+-[0-9][0-9.]*)", r"idmark \1", text.lower())))
        return [w for w in plain.split(" ") if w]

    place = {g: i for i, g in enumerate(model.vectors.vocabulary)}
    weights, constant = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    templates = {f: [set(split(t)) for t in ts] for f, ts in _templates().items()}
    out = []
    for doc, text in rows:
        for k, part in enumerate(re.sub(WRAP, " ", text).split("\n") if text is not None else []):
            w = split(part)
            if not w:
                continue
            used = sorted({place[g] for g in {*w, *(f"{a} {b}" for a, b in zip(["<s>", *w], [*w, "</s>"]))} if g in place})
            m = (weights[:, used].sum(axis=1) + constant) / model.temperature
            e = [math.exp(x - max(m)) for x in m]
            p = [x / sum(e) for x in e]
            if p[0] >= 0.5:
                continue
            best = max(p[2:])
            family = model.classes[2 + p[2:].index(best)]
            told = not {*w}.isdisjoint(LICENCE_WORDS)
            similarity = max(len(t & {*w}) / len(t) if len(t) > 2 or told or len(t) == len({*w}) else 0.0 for t in templates[family])
            sure = best >= model.least and similarity >= CONFIRM
            out.append((doc, k, family if sure else UNKNOWN, family, round(best, 6), round(similarity, 6)))
    return out
