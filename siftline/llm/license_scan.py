"""License texts in documents by diagonal voting.

All rolling two-word hashes of a document are joined to their positions in the
templates. A match votes for its diagonal, the document's position less the
template's; what a diagonal has matched is a bit set of template positions, so
that votes add up by "or" before and after the shuffle. Neighbouring diagonals,
which inserted and deleted words set apart, are merged, and a span is verified by
the share of the template's word pairs that its merged diagonals hold.

Phrases are found where one diagonal holds all their pairs; notices where up to
``SHIFT`` neighbouring diagonals hold at least ``COVERAGE`` of them. A phrase's
label is its licence; the method's own labels come from longer phrases (versions)
and from the licences' notices, which often do without the name.

A score is the greatest share of a template found in one place, 0 where nothing
is found. Null texts are empty and have no words. Rows with a null id, and
repeated rows, get a result each. Other columns are passed over. No rows, no
results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.storage import stored, text_or_empty
from siftline.operators.once import compute_once

#: Diagonals that are merged: words inserted or deleted within a notice.
SHIFT = 12
COVERAGE = 0.7
#: Template positions in one mask: bits of a long.
BITS = 64

# The phrases and labels of the contract.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Further phrases, with the label of the licence they name.
PHRASES = (
    ("apache license version 2 0", "apache-2.0"),
    ("general public license version 2", "gpl-2.0"),
    ("general public license version 3", "gpl-3.0"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("creative commons attribution", "cc-by"),
    ("boost software license", "bsl"),
    ("do what the fuck you want to public license", "wtfpl"),
)
# The notices that the licences ask to be kept, and their labels.
NOTICES = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
     files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
     modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
     is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
     included in all copies or substantial portions of the Software.""", "mit"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
     License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
     or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
     CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
     limitations under the License.""", "apache"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
     published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
     is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
     MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "gpl"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
     conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
     following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
     following disclaimer in the documentation and/or other materials provided with the distribution.""", "bsd"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
     provided that the above copyright notice and this permission notice appear in all copies.""", "isc"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
     with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "mpl"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
     sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
     non-commercial, and by any means.""", "unlicense"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
     any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
     including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""", "zlib"),
    ("""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
     documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
     Software, and to prepare derivative works of the Software""", "bsl"),
)


@dataclass(frozen=True)
class Template:
    text: str
    label: str
    #: Whether single diagonals must hold the whole text.
    exact: bool = False
    base: bool = False


TEMPLATES = (
    *[Template(t, label, exact=True, base=True) for t, label in BASE_PHRASES],
    *[Template(t, label, exact=True) for t, label in PHRASES],
    *[Template(t, label) for t, label in NOTICES],
)


def words_of(text: Column) -> Column:
    """Words of the contract. Non-ASCII letters stay letters, whatever their case;
    the Kelvin sign, whose small form would be an ASCII k, is kept apart."""
    lowered = F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _pairs(frame: DataFrame) -> DataFrame:
    """``n_words`` and ``pairs``: an odd hash for each two neighbouring words."""
    split = compute_once(frame, {"words": words_of(F.col("text"))}).drop("text")
    hashed = compute_once(split.withColumn("n_words", F.size("words").cast("long")), {"hashes": F.transform("words", lambda w: F.xxhash64(w))}).drop("words")
    n = F.greatest(F.col("n_words").cast("int") - 1, F.lit(0))
    return hashed.withColumn("pairs", F.zip_with(F.slice("hashes", 1, n), F.slice("hashes", 2, n), lambda a, b: F.xxhash64(a, b).bitwiseOR(F.lit(1).cast("long")))).drop("hashes")


def template_positions(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``pair, template, at``: a few thousand rows, as many as the templates have words."""
    rows = spark.createDataFrame([(i, t.text) for i, t in enumerate(templates)], "template int, text string")
    return _pairs(rows).select(F.posexplode("pairs").alias("at", "pair"), "template")


def matches(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Every place where a document's word pair stands in a template (stored).

    One further row per document, with a null template, keeps ``n_words``.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    pairs = _pairs(keyed)
    # Zero, which is no pair's hash, stands for the document itself.
    ended = pairs.withColumn("pairs", F.concat("pairs", F.array(F.lit(0).cast("long"))))
    placed = ended.select("doc_id", "text_hash", "n_words", F.posexplode("pairs").alias("pos", "pair"))
    spark = docs.sparkSession
    known = template_positions(spark, templates).unionByName(spark.createDataFrame([(None, 0, None)], "at int, pair long, template int"))
    # The templates' size is fixed by their texts: broadcasting them is safe.
    return stored(placed.join(F.broadcast(known), "pair").select("doc_id", "text_hash", "n_words", "template", "pos", "at"))


def diagonals(found: DataFrame, longest: int) -> DataFrame:
    """Per document, template and diagonal: masks of matched template positions and
    the first and last word. Repeated rows set the same bits."""
    masks = [
        F.bit_or(F.when(F.shiftright("at", 6) == k, F.expr(f"shiftleft(1L, at % {BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"m{k}")
        for k in range(-(-longest // BITS))
    ]
    voted = found.filter("template IS NOT NULL").groupBy("doc_id", "text_hash", "template", (F.col("pos") - F.col("at")).alias("diagonal"))
    return voted.agg(*masks, F.min("pos").alias("first_word"), (F.max("pos") + 1).alias("last_word"))


def spans(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, text_hash, template, label, base, first_word, last_word, coverage``
    of every verified place, from ``matches``."""
    spark = found.sparkSession
    sizes = [len(words) for words in map(_plain_words, templates)]
    told = spark.createDataFrame([(i, t.label, t.base, t.exact, n - 1) for i, (t, n) in enumerate(zip(templates, sizes))], "template int, label string, base boolean, exact boolean, n_pairs int")
    votes = diagonals(found, max(sizes)).join(F.broadcast(told), "template")
    masks = [c for c in votes.columns if c.startswith("m") and c[1:].isdigit()]
    bits = lambda names: sum((F.bit_count(F.col(m)) for m in names[1:]), F.bit_count(F.col(names[0])))
    votes = votes.withColumn("held", bits(masks))
    key = ["doc_id", "text_hash", "template"]
    kept = [*key, "label", "base", "first_word", "last_word", "coverage"]
    whole = votes.filter(F.col("exact") & (F.col("held") == F.col("n_pairs"))).withColumn("coverage", F.lit(1.0)).select(*kept)
    # Where all diagonals together hold too little, no neighbours hold enough.
    place = Window.partitionBy(*key)
    rich = votes.filter(~F.col("exact")).withColumn("all_held", F.sum("held").over(place)).filter(F.col("all_held") >= COVERAGE * F.col("n_pairs"))
    near = place.orderBy("diagonal").rangeBetween(0, SHIFT)
    merged = rich.select(*key, "label", "base", "n_pairs", "diagonal", *[F.bit_or(m).over(near).alias(m) for m in masks], F.min("first_word").over(near).alias("first_word"), F.max("last_word").over(near).alias("last_word"))
    verified = merged.withColumn("coverage", bits(masks) / F.col("n_pairs")).filter(F.col("coverage") >= COVERAGE)
    # Diagonals less than half a template apart tell of one place; the best stays.
    ordered = place.orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(ordered) > F.col("n_pairs") / 2
    islands = verified.withColumn("starts", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("starts").over(ordered))
    best = islands.groupBy(*key, "island").agg(F.max(F.struct("coverage", -F.col("diagonal"), "label", "base", "first_word", "last_word")).alias("b"))
    return whole.unionByName(best.select(*key, "b.label", "b.base", "b.first_word", "b.last_word", "b.coverage"))


def _plain_words(template: Template) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in template.text.lower()).split()


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: its words, its base phrases' places, all labels, score."""
    found = matches(docs, templates)
    of_base = lambda c: F.when(F.col("base"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    told = spans(found, templates).groupBy("doc_id", "text_hash").agg(
        F.count(of_base("label")).alias("n_base"), F.min(of_base("first_word")).cast("long").alias("first_word"), F.max(of_base("first_word")).cast("long").alias("last_word"),
        joined(of_base("label")).alias("base_labels"), joined("label").alias("labels"), F.max("coverage").alias("score"),
    ).withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    rows = found.filter("template IS NULL").select("doc_id", "text_hash", "n_words")
    same = rows["doc_id"].eqNullSafe(told["found_id"]) & (rows["text_hash"] == told["found_hash"])
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return rows.join(told, same, "left").select("doc_id", "n_words", *[F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])
