"""Licence scan: Dice coefficient over word bigrams against licence templates.

A document is compared by units: each line, each paragraph (lines up to a blank one) and the
whole text. A unit is normalised (lower case; all but letters and digits become one space)
and turned into its set of word bigrams. A template of a bigrams can reach THRESHOLD only
with units of a*t/(2-t) to a*(2-t)/t bigrams (t the threshold); others are pruned before any set is compared.
The best template of each unit that reaches THRESHOLD counts, ties by the smaller name.

Templates are short notices and file headers (TEMPLATES) and whole licences (license_texts/).

Scale: one pass of built-in functions, no shuffle, no join. The templates are a constant.
Defined cases: null text has no licence; texts of any length are compared whole; rows with equal
doc_id are scanned one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.exprs import let

#: The threshold, also as a ratio, since sizes are compared in whole numbers.
THRESHOLD, RATIO = 0.8, (4, 5)
#: Wording of public licence notices, as published with the licences.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
NOT_WORD = r"[^\p{L}\p{N}]+"


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


@functools.cache
def templates() -> list[tuple[str, list[str]]]:
    """(name, bigrams) of the notices and of the whole licences beside this module."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
    whole = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            whole.append((name.removesuffix(".txt"), f.read()))
    return [(name, bigrams(text)) for name, text in TEMPLATES + whole]


def _templates():
    rows = templates()
    held = lambda b: F.split(F.lit("|".join(b)), r"\|")  # noqa: E731  (a constant for the optimizer)
    return F.array(*[F.struct(F.lit(name).alias("name"), held(b).alias("b"), F.lit(len(b)).alias("n")) for name, b in rows]), [len(b) for _, b in rows]


def _best(unit, templates, sizes):
    """(score, name) of the best template of a unit, or null."""
    t, (p, q) = THRESHOLD, RATIO
    low, high = -(-min(sizes) * p // (2 * q - p)), max(sizes) * (2 * q - p) // p

    def compare(b):
        n = F.size(b)
        fit = F.filter(templates, lambda x: 2 * q * F.least(n, x["n"]) >= p * (n + x["n"]))
        scored = F.transform(fit, lambda x: F.struct((-2.0 * F.size(F.array_intersect(b, x["b"])) / (n + x["n"])).alias("score"), x["name"].alias("name")))
        return F.array_min(F.filter(scored, lambda s: s["score"] <= -t))

    def pairs(w):
        b = F.array_distinct(F.transform(F.slice(w, F.lit(2), F.size(w) - 1), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x)))
        # a unit repeats few bigrams at most, or many: the word count bounds the set from above only
        return F.when(F.size(w) >= F.lit(low) + 1, let(b, lambda b: F.when(F.size(b).between(low, high), compare(b))))

    return let(F.split(F.trim(F.regexp_replace(F.lower(unit), NOT_WORD, " ")), " "), pairs)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_units, n_licenses, licenses, best_score) per row of docs."""
    templates, sizes = _templates()
    text = F.coalesce("text", F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[\x20\x09-\x0D]*\n"), F.array(text)))
    found = F.filter(F.transform(units, lambda u: _best(u, templates, sizes)), lambda x: x.isNotNull())
    out = docs.select(F.col("doc_id").cast("long"), found.alias("f"))
    names = F.array_sort(F.array_distinct(F.transform("f", lambda x: x["name"])))
    score = F.round(-F.array_min(F.transform("f", lambda x: x["score"])), 6)
    return out.select("doc_id", F.size("f").cast("long").alias("n_units"), F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.coalesce(score, F.lit(0.0)).alias("best_score"))


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",".join(f"({quote(name)}, string_split({quote('|'.join(b))}, '|'))" for name, b in templates())
    t, (p, q) = THRESHOLD, RATIO
    return rf"""
WITH tpl(name, b) AS (VALUES {rows}),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n[\x20\x09-\x0D]*\n')), [text]))) AS u
      FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
w AS (SELECT doc_id, u, string_split(trim(regexp_replace(lower(u), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u),
b AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) >= 2),
s AS (SELECT doc_id, u, name, 2.0::DOUBLE * len(list_intersect(b.b, tpl.b)) / (len(b.b) + len(tpl.b)) AS score FROM b JOIN tpl ON {2 * q} * least(len(b.b), len(tpl.b)) >= {p} * (len(b.b) + len(tpl.b))),
best AS (SELECT doc_id, u, name, score FROM s WHERE score >= {t} QUALIFY row_number() OVER (PARTITION BY doc_id, u ORDER BY score DESC, name) = 1),
a AS (SELECT doc_id, count(*) AS n_units, count(DISTINCT name) AS n_licenses, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, round(max(score), 6) AS best_score FROM best GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(best_score, 0.0::DOUBLE) AS best_score
FROM documents d LEFT JOIN a USING (doc_id)
"""
