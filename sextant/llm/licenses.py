"""License scans: MinHash bands over text windows retrieve templates, shingle containment verifies. Native: DataFrame
functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import ascii_lower

#: Notices by which texts name their license, and whole texts of short licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd-2-clause-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Words of a shingle, least containment, bands of one row each; words of all templates, at most: they are broadcast.
SIZE, CONTAINMENT, BANDS, MOST_WORDS = 5, 0.8, 32, 100_000
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS, -1), lambda w: w != "")


def shingle_hashes(w: Column, size: int = SIZE) -> Column:
    """A hash for each `size` consecutive words of the array w, which must be a column of its own; fewer words: none."""
    some = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, some).otherwise(F.array().cast("array<bigint>"))


def min_hashes(shingles: Column, bands: int = BANDS) -> Column:
    """For each band the least of the shingles' hashes under the band's own hash function."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, j))))


def collision_probability(similarity: float, bands: int = BANDS) -> float:
    """The chance that two sets of that Jaccard similarity share a band."""
    return 1 - (1 - similarity) ** bands


def steps(n_words: int) -> tuple[int, int]:
    """Stride and length in words of the windows for templates of n_words: any n_words of a text, and one more, lie
    wholly in one window, so a template that stands there has a similarity of about 4 / 5 to it."""
    stride = max(1, n_words // 4)
    return stride, n_words + stride


def _templates(spark: SparkSession, templates: tuple[tuple[str, str], ...], size: int, bands: int) -> list:
    """name, n (words), h (hashes of the different shingles), sig, low (the shingles that are a band's least)."""
    made = spark.createDataFrame(list(templates), "name string, text string").select("name", words(F.col("text")).alias("w"))
    made = made.select("name", F.size("w").alias("n"), F.array_distinct(shingle_hashes(F.col("w"), size)).alias("h"))
    return made.select("name", "n", "h", min_hashes(F.col("h"), bands).alias("sig")).withColumn(
        "low", F.filter("h", lambda h: F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.xxhash64(h, j) == F.get(F.col("sig"), j)))
    ).collect()


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, size: int = SIZE, least: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """doc_id, template, containment (double), word (long) for each document of docs (doc_id, text; others are ignored)
    and template found in it: the largest share of the template's different word shingles that a window of the text
    holds, `least` or more, and the first word of the first such window.

    Windows of a template's length and a quarter more begin at every quarter length. Templates need `size` words.
    Documents without a match, null and empty texts have no row. Rows that share a doc_id are one document; those without
    one are told apart by their words. Of equal windows the first counts. A very long text is exploded only where it may
    match.

    A window shares a band with a template only if it holds the shingle that is the template's least in that band.
    MinHashes are therefore taken only of windows that hold any template's least shingle; the others have no band
    in common with any template, so bands retrieve just what they would over all windows. Nothing is shuffled but the
    matches; templates are broadcast, MOST_WORDS words at most.
    """
    spark = docs.sparkSession
    known = _templates(spark, templates, size, bands)
    if not known or min(t["n"] for t in known) < size:
        raise ValueError(f"templates need at least {size} words")
    if sum(t["n"] for t in known) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words are too many to broadcast")
    low = sorted({h for t in known for h in t["low"]})
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), words(docs["text"].cast("string")).alias("w"))
    rows = rows.select(F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("w")).alias("other")).alias("doc"), shingle_hashes(F.col("w"), size).alias("h"))
    # no filters and no plain explode until windows are rows: a predicate over arrays would be pushed into the scan with
    # the arrays' expressions in its lambdas, and split the text anew for each word
    at = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: (i >= 0) & F.get(F.col("h"), i).isin(low))
    rows = rows.select("doc", "h", at.alias("at"))

    def windows(n: int) -> Column:
        stride, length = steps(n)
        first = lambda i: F.greatest(F.lit(0), F.ceil((i + size - length) / stride)).cast("int")
        near = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(first(i), F.floor(i / stride).cast("int")))))
        return F.transform(near, lambda k: F.struct(F.lit(n).alias("n"), (k * stride).alias("word"), F.lit(length - size + 1).alias("length")))

    kinds = sorted({t["n"] for t in known})
    rows = rows.select("doc", "h", F.explode_outer(F.concat(*[windows(n) for n in kinds])).alias("win"))
    rows = rows.where("win is not null").select("doc", "win.n", "win.word", F.expr("slice(h, win.word + 1, win.length)").alias("h"))
    rows = rows.select("doc", "n", "word", "h", F.posexplode(min_hashes(F.col("h"), bands)).alias("band", "low"))
    index = spark.createDataFrame([(t["name"], t["n"], t["h"], j, x) for t in known for j, x in enumerate(t["sig"])], "template string, n int, shingles array<bigint>, band int, low bigint")
    met = rows.join(F.broadcast(index), ["n", "band", "low"])
    share = F.size(F.array_intersect("shingles", "h")) / F.size("shingles")
    met = met.select("doc", "template", "word", share.alias("containment")).where(F.col("containment") >= least)
    best = met.groupBy("doc", "template").agg(F.max(F.struct("containment", (-F.col("word")).alias("back"))).alias("best"))
    return best.select("doc.doc_id", "template", "best.containment", (-F.col("best.back")).cast("long").alias("word"))


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, size: int = SIZE, least: float = CONTAINMENT) -> str:
    """The same in SQL for DuckDB, by exact containment in every window."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    given = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in templates)
    return f"""
with t as (select name, {split.format("body")} as w from (values {given}) v(name, body)),
tt as (select name, len(w) as n, greatest(1, len(w) // 4) as stride, w from t),
ts as (select distinct name, array_to_string(w[i : i + {size - 1}], ' ') as s from (select name, w, unnest(range(1, len(w) - {size} + 2)) as i from t)),
tn as (select name, count(*) as shingles from ts group by name),
d as (select doc_id, case when doc_id is null then array_to_string(w, ' ') end as other, w from (select doc_id, {split.format("coalesce(text, '')")} as w from documents)),
ds as (select doc_id, other, i - 1 as i, array_to_string(w[i : i + {size - 1}], ' ') as s from (select doc_id, other, w, unnest(range(1, len(w) - {size} + 2)) as i from d where len(w) >= {size})),
hits as (select ds.doc_id, ds.other, ds.i, ds.s, tt.name, tt.n, tt.stride from ds join ts using (s) join tt using (name)),
wins as (
  select distinct doc_id, other, name, s, stride * k as word
  from (select *, unnest(range(greatest(0, cast(ceil((i + {size} - n - stride) / stride) as bigint)), i // stride + 1)) as k from hits)),
c as (select doc_id, other, name, word, count(*) / any_value(shingles) as containment from wins join tn using (name) group by doc_id, other, name, word)
select doc_id, name as template, max(containment) as containment, cast(arg_max(word, containment * 1e9 - word) as bigint) as word
from c where containment >= {least} group by doc_id, other, name"""
