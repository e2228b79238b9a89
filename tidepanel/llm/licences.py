"""Licence scan: Dice coefficient of word bigrams against templates, in DataFrame functions only.

Units are the whole text and each of its lines and paragraphs. A unit of n distinct bigrams can only reach a Dice
coefficient d with a template of m if d/(2-d) m <= n <= (2-d)/d m, so most units are dropped by their size before any
bigram is compared, and each unit left meets only the templates whose bounds hold it. Rows are judged one by one:
nothing is shuffled, and templates are literals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Public notices and licence texts, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def normalised(text: str) -> list[str]:
    """ASCII letters and digits, lower-cased, as words; anything else parts them."""
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def bounds(size: int, threshold: float) -> tuple[float, float]:
    """Bigrams that a unit can have to reach `threshold` with a template of `size`."""
    return threshold / (2 - threshold) * size, (2 - threshold) / threshold * size


def _words(c: Column) -> Column:
    return F.filter(F.split(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"), lambda x: x != "")


def _bigrams(w: Column) -> Column:
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def matches(text: Column, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> Column:
    """array<struct<licence, dice, unit>>: for each unit that reaches `threshold`, every template it reaches it with.

    Unit 0 is the whole text, 1, 2, ... its lines, -1, -2, ... its paragraphs of several lines (parted by blank ones).
    Templates of under two words can't match. Null and empty texts match nothing.
    """
    known = [(name, sorted(g)) for name, t in (TEMPLATES if templates is None else templates).items() if (g := bigrams(normalised(t)))]
    none = F.array().cast("array<struct<licence:string,dice:double,unit:int>>")
    if not known:
        return none
    low = min(bounds(len(g), threshold)[0] for _, g in known)
    high = max(bounds(len(g), threshold)[1] for _, g in known)
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, g)).alias("grams")) for n, g in known))
    lines = F.split(text, "\n")
    unit = lambda t, k: F.struct(t.alias("text"), k.cast("int").alias("unit"))
    paragraphs = F.split(text, "\\n[ \\t\\r]*\\n")
    units = F.concat(
        F.array(unit(text, F.lit(0))),
        F.when(F.size(lines) > 1, F.transform(lines, lambda t, k: unit(t, k + 1))).otherwise(F.array().cast("array<struct<text:string,unit:int>>")),
        F.when(F.size(paragraphs) > 1, F.filter(F.transform(paragraphs, lambda t, k: unit(t, -k - 1)), lambda u: F.contains(u["text"], F.lit("\n")))).otherwise(
            F.array().cast("array<struct<text:string,unit:int>>")
        ),
    )
    # n bigrams need n + 1 words, so at least 2 n + 1 characters
    long_enough = F.filter(units, lambda u: F.length(u["text"]) >= F.lit(int(2 * low) + 1))
    cut = F.transform(long_enough, lambda u: F.struct(_words(u["text"]).alias("words"), u["unit"].alias("unit")))
    sized = F.filter(cut, lambda u: (F.size(u["words"]) - 1 >= F.lit(low)))
    grams = F.transform(sized, lambda u: F.struct(_bigrams(u["words"]).alias("grams"), u["unit"].alias("unit")))
    fit = F.filter(grams, lambda u: F.size(u["grams"]).between(low, high))

    def scored(u: Column) -> Column:
        n = F.size(u["grams"])
        near = F.filter(table, lambda t: (n >= F.size(t["grams"]) * F.lit(threshold / (2 - threshold))) & (n <= F.size(t["grams"]) * F.lit((2 - threshold) / threshold)))
        dice = lambda t: F.size(F.array_intersect(u["grams"], t["grams"])) * F.lit(2.0) / (n + F.size(t["grams"]))
        return F.filter(F.transform(near, lambda t: F.struct(t["name"].alias("licence"), dice(t).alias("dice"), u["unit"].alias("unit"))), lambda m: m["dice"] >= threshold)

    return F.when(text.isNull(), none).otherwise(F.flatten(F.transform(fit, scored)))


def scanned(docs: DataFrame, text_col: str = "text", out_col: str = "licences", **options) -> DataFrame:
    """`docs` with `out_col` (see `matches`); each row for itself, other columns untouched."""
    if out_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out_col!r}; pass another out_col")
    return docs.withColumn(out_col, matches(F.col(text_col), **options))


def sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB, one row per document: doc_id, n_matches, best licence (highest Dice, then name) and its Dice."""
    rows = ",\n".join(f"('{n}', [{', '.join(repr(g) for g in sorted(bigrams(normalised(t))))}])" for n, t in (templates or TEMPLATES).items())
    return f"""
WITH t(name, grams) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
u AS (SELECT rid, 0 AS unit, text AS part FROM d WHERE text IS NOT NULL
  UNION ALL SELECT rid, unit, part FROM (SELECT rid, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS unit, len(string_split(text, chr(10))) AS n FROM d) WHERE n > 1
  UNION ALL SELECT rid, -unit, part FROM (SELECT rid, unnest(p) AS part, generate_subscripts(p, 1) AS unit, len(p) AS n FROM (SELECT rid, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS p FROM d)) WHERE n > 1 AND contains(part, chr(10))),
w AS (SELECT rid, unit, regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM u),
s AS (SELECT * FROM w WHERE len(w) BETWEEN 2 AND 1000000),
g AS (SELECT rid, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM s),
b AS (SELECT * FROM g WHERE len(grams) <= (SELECT max(len(grams)) FROM t) * {(2 - threshold) / threshold}),
m AS (SELECT rid, name, 2.0 * len(list_intersect(b.grams, t.grams)) / (len(b.grams) + len(t.grams)) AS dice FROM b, t),
h AS (SELECT * FROM m WHERE dice >= {threshold}),
k AS (SELECT rid, count(*) AS n, max(dice) AS best FROM h GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_matches,
  (SELECT min(h.name) FROM h WHERE h.rid = d.rid AND h.dice = k.best) AS licence, round(k.best, 6) AS dice
FROM d LEFT JOIN k USING (rid)"""
