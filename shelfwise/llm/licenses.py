"""Licence scans in DataFrame expressions alone: passages and word windows against licence templates by Dice over word bigrams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed licence notices: identifier, text. A licence may have several.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
)
#: Standard licence bodies, paragraph by paragraph. Like the notices, they are also looked for within lines and across line ends.
BODIES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Words that start some word of more than a third of each template's bigrams (a test checks this); see ``MATCH``.
CUES = ("licen", "cc", "copyright", "permission", "softw", "rights", "charge", "public", "law", "use", "source", "granted", "free", "work", "released", "under", "attribution", "mozilla")
#: Dice from which a passage is a template. At 0.8 a passage shares two thirds of the template's bigrams at least, so it
#: holds a bigram of any set of more than a third of them: passages without a cue word are pruned without loss.
MATCH = 0.8


def words_of(text: str) -> list[str]:
    return re.sub(r"[^A-Za-z0-9]+", " ", text).strip().lower().split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def bounds(size: int, match: float = MATCH) -> tuple[int, int]:
    """Least and most bigrams of a passage that can reach the match with a template of ``size`` bigrams.

    The shared bigrams are at most the smaller size: 2 * min >= match * (a + b).
    """
    sizes = [n for n in range(1, 4 * size + 4) if 2 * min(n, size) >= match * (n + size)]
    return min(sizes), max(sizes)


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, match: float = MATCH) -> Column:
    """Array of (dice, license, from_line, template) for the passages of the column ``text`` that match a template.

    Passages are the lines of a text and its paragraphs of several lines.
    """
    # the cues are proved for matches from MATCH on; for a lower one every passage is compared
    cue = quoted("(?i)\\b(" + "|".join(CUES) + ")") if match >= MATCH else quoted("")
    lines = f"transform(split({text}, '\\n', -1), (x, i) -> named_struct('x', x, 'i', i + 1))"
    paragraphs = f"transform(split({text}, '\\\\n[ \\\\t\\\\r]*\\\\n', -1), (x, i) -> named_struct('x', x, 'i', -1 - i))"
    passages = f"filter(concat(filter({lines}, p -> p.x rlike {cue}), filter({paragraphs}, p -> instr(p.x, '\\n') > 0 and p.x rlike {cue})), p -> true)"
    words = f"transform({passages}, p -> named_struct('i', p.i, 'w', split(trim(lower(regexp_replace(p.x, '[^A-Za-z0-9]+', ' '))), ' ')))"
    grams = f"transform({words}, p -> named_struct('i', p.i, 'g', array_distinct(transform(slice(p.w, 2, size(p.w)), (b, j) -> concat(p.w[j], ' ', b)))))"
    tests = []
    for n, (name, notice) in enumerate(TEMPLATES):
        own = bigrams_of(notice)
        low, high = bounds(len(own), match)
        listed = "array(" + ", ".join(map(quoted, own)) + ")"
        dice = f"2.0D * size(array_intersect(p.g, {listed})) / (size(p.g) + {len(own)})"
        # the size bound is tested first: only templates of a fitting size are compared
        tests.append(f"case when size(p.g) between {low} and {high} then named_struct('dice', {dice}, 'license', {quoted(name)}, 'passage', p.i, 'template', {n}) end")
    found = f"flatten(transform({grams}, p -> filter(array({', '.join(tests)}), m -> m.dice >= cast({match} as double))))"
    return F.expr(f"case when {text} rlike {cue} then {found} else cast(array() as array<struct<dice:double,license:string,passage:int,template:int>>) end")


def least_shared(size: int, match: float = MATCH) -> int:
    """Least bigrams that any passage must share with a template of ``size`` bigrams to reach the match."""
    return next(n for n in range(1, size + 1) if 2 * n >= match * (n + size))


def anchors(notice: str, match: float = MATCH) -> list[str]:
    """Bigrams of which every match of the notice holds one: more than it may miss, those of the longest words."""
    own = bigrams_of(notice)
    return sorted(own, key=lambda g: (-len(g), g))[: len(own) - least_shared(len(own), match) + 1]


def anchored(grams: list[str]) -> str:
    return quoted("(?i)(?<![A-Za-z0-9])(?:" + "|".join(g.replace(" ", "[^A-Za-z0-9]+") for g in sorted(set(grams))) + ")(?![A-Za-z0-9])")


def uncovered(text: str, found: str) -> str:
    """SQL of the words of ``text`` in order, across line ends; each passage of ``found`` stands as one word '|'."""
    matched = f"transform(filter({found}, m -> m.passage > 0), m -> split({text}, '\\n', -1)[m.passage - 1])"
    line = "split(trim(lower(regexp_replace(l, '[^A-Za-z0-9]+', ' '))), ' ')"
    lines = f"flatten(transform(split(x, '\\n', -1), l -> case when array_contains({matched}, l) then array('|') else {line} end))"
    paragraphs = f"transform(split({text}, '\\\\n[ \\\\t\\\\r]*\\\\n', -1), (x, k) -> case when exists({found}, m -> m.passage = -1 - k) then array('|') else {lines} end)"
    return f"filter(flatten({paragraphs}), w -> w <> '')"


def windows(text: str, grams: str, n: int, name: str, notice: str, match: float = MATCH) -> str:
    """SQL of the matches of one template among the windows of the bigrams ``grams`` of ``text``, stride 1.

    Cutting a foreign bigram off an end never lowers Dice, so only windows from one of the template's bigrams to another
    are compared, of at most as many bigrams as ``bounds`` allows. Of overlapping windows the best is one match.
    """
    own = bigrams_of(notice)
    need, most = least_shared(len(own), match), bounds(len(own), match)[1]
    listed = "array(" + ", ".join(map(quoted, own)) + ")"
    hits = f"filter(transform({grams}, (g, p) -> named_struct('p', p, 'd', array_position({listed}, g))), h -> h.d > 0)"
    dice = f"2.0D * size(array_distinct(transform(slice(hs, i + 1, {need} + j), x -> x.d))) / (size(array_distinct(slice({grams}, h.p + 1, e.p - h.p + 1))) + {len(own)})"
    ends = f"transform(slice(hs, i + {need}, {most - need + 1}), (e, j) -> named_struct('s', case when e.p - h.p < {most} then -({dice}) else 0D end, 'a', h.p, 'b', e.p))"
    made = f"flatten(transform(array({hits}), hs -> filter(transform(hs, (h, i) -> array_min({ends})), w -> -w.s >= cast({match} as double))))"
    best = f"aggregate(array_sort({made}), cast(array() as array<struct<s:double,a:int,b:int>>), (k, w) -> case when exists(k, y -> y.a <= w.b and w.a <= y.b) then k else concat(k, array(w)) end)"
    one = f"transform({best}, w -> named_struct('dice', -w.s, 'license', {quoted(name)}, 'passage', 0, 'template', {n}))"
    return f"case when {text} rlike {anchored(anchors(notice, match))} then {one} else cast(array() as array<struct<dice:double,license:string,passage:int,template:int>>) end"


def scan_licenses(df: DataFrame, text_col: str = "text", match: float = MATCH) -> DataFrame:
    """``df`` with ``license_matches``: dice, license, passage (line number, -n for the n-th paragraph, 0 for a window of
    words in the rest of the text) and template (numbers go on from ``TEMPLATES`` to ``BODIES``).

    Passages that match as a whole are left out of the windows, so that a notice counts once for a template.
    Null and empty texts, and texts of single words, match nothing. Rows come back one for one with all their columns
    (one named ``license_matches`` is replaced); nothing is shuffled.
    """
    own = [c for c in df.columns if c != "license_matches"]
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    both = TEMPLATES + BODIES
    some = anchored([a for _, t in both for a in anchors(t, match)])
    out = out.withColumn("_m", matches("_t", match))
    # texts without an anchor of any template hold no window that matches
    out = out.withColumn("_w", F.expr(f"case when _t rlike {some} then {uncovered('_t', '_m')} else cast(array() as array<string>) end"))
    out = out.withColumn("_g", F.expr("transform(slice(_w, 2, size(_w)), (b, j) -> concat(_w[j], ' ', b))"))
    inner = ", ".join(windows("_t", "_g", n, name, t, match) for n, (name, t) in enumerate(both))
    out = out.withColumn("license_matches", F.expr(f"case when size(_g) > 0 then concat(_m, {inner}) else _m end"))
    return out.select("_own.*", "license_matches")


def license_summary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_matches, best_dice (0 without a match) and licenses (distinct, sorted, comma-joined) of every row."""
    found = scan_licenses(df.select(id_col, text_col), text_col)
    best = F.expr("coalesce(array_max(transform(license_matches, m -> m.dice)), 0D)")
    names = F.expr("array_join(array_sort(array_distinct(transform(license_matches, m -> m.license))), ',')")
    return found.select(id_col, F.size("license_matches").cast("bigint").alias("n_matches"), best.alias("best_dice"), names.alias("licenses"))


def license_sql() -> str:
    """``license_summary`` over ``documents`` for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cue = quote("(?i)\\b(" + "|".join(CUES) + ")")
    rows = ", ".join(f"({n}, {quote(name)}, [{', '.join(map(quote, bigrams_of(t)))}])" for n, (name, t) in enumerate(TEMPLATES))
    return f"""
WITH templates(template, license, b) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
passages AS (
  SELECT r, unnest(string_split(t, chr(10))) AS x FROM docs
  UNION ALL
  SELECT r, x FROM (SELECT r, unnest(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n')) AS x FROM docs) WHERE contains(x, chr(10))),
words AS (SELECT r, row_number() OVER () AS p, string_split(trim(lower(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM passages WHERE regexp_matches(x, {cue})),
grams AS (SELECT r, p, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words),
found AS (SELECT r, p, license, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM grams, templates),
hits AS (SELECT r, count(*) AS n, max(dice) AS best, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM found WHERE dice >= {MATCH} GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(best, 0)::DOUBLE AS best_dice, coalesce(names, '') AS licenses
FROM docs LEFT JOIN hits USING (r)"""
