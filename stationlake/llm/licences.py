"""Licence recognition by sentences: known sentences become identifiers, rules match their order.

Only DataFrame functions run, in one pass over each text, without a shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import carried

# Sentences of public licence texts and notices, by identifier.
SENTENCES = (
    ("mit-title", "MIT License"),
    ("mit-title", "The MIT License"),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-notice", "This project is licensed under the MIT License."),
    (
        "mit-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "mit-condition",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "mit-as-is",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT.",
    ),
    (
        "mit-liability",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "This project is licensed under the Apache License, Version 2.0."),
    ("apache-header", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache-use", "you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at"),
    (
        "apache-as-is",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ),
    (
        "apache-see",
        "See the License for the specific language governing permissions and limitations under the "
        "License.",
    ),
    (
        "gpl3-notice",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    ("gpl3-notice", "Licensed under the GNU General Public License, version 3."),
    ("gpl-free", "This program is free software:"),
    (
        "gpl3-terms",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "gpl2-terms",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation;",
    ),
    ("gpl2-version", "either version 2 of the License, or (at your option) any later version."),
    (
        "gpl-hope",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    ),
    (
        "gpl-merchant",
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    ("gpl-see", "See the GNU General Public License for more details."),
    (
        "bsd-permit",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ),
    (
        "bsd-source",
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ),
    (
        "bsd-binary",
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    (
        "bsd-names",
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission.",
    ),
    (
        "bsd-as-is",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    ("public", "This is free and unencumbered software released into the public domain."),
)

# Rules in the order they apply; what one has matched the later ones don't see.
RULES = (
    ("Apache-2.0", ("apache-header", "apache-use", "apache-copy", "apache-as-is", "apache-see")),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-as-is")),
    ("BSD-3-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-merchant", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms", "gpl2-version")),
    ("Apache-2.0", ("apache-header", "apache-use")),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("Unlicense", ("public",)),
)

#: A sentence ends at these marks before white space or the end, and at an empty line.
SENTENCE_END = r"[.!?;:]+(?:[ \t\r\n]|$)|\n[ \t\r]*\n"
#: What a normalised sentence keeps: letters of a-z, digits and points inside numbers.
OTHER = r"[^a-z0-9.]+"


def normal(sentence: str) -> str:
    """Normal form of one sentence, as `_normal` gives it."""
    plain = re.sub(OTHER, " ", sentence.lower()).strip(" ")
    return plain.rstrip(".")


KNOWN = {normal(re.sub(r"[;:]$", "", text)): name for name, text in SENTENCES}

#: Marks before the words of a line, as of comments, quotes and lists.
LINE_MARKS = r"(?md)^[ \t\r!-/:-@\[-`{-~]+(?:(?:dnl|rem)(?![a-z0-9])[ \t\r!-/:-@\[-`{-~]*)?|^(?:dnl|rem)(?![a-z0-9])"
_TITLES = "|".join(
    r"[^a-z0-9.\n]+".join(map(re.escape, known.split()))
    for known, name in KNOWN.items()
    if name.endswith("-title")
)
#: Lines that stand alone: copyright lines (not words of a licence about them) and known titles.
OWN_LINE = (
    r"(?md)^[^a-z0-9\n©]*(?:(?:(?:portions[ \t]+)?copyright(?![a-z])"
    r"(?![ \t]+(?:notices?|holders?|owners?|laws?|and|or)(?![a-z]))|©|c\)[ \t])[^\n]*"
    rf"|(?:all rights reserved|{_TITLES})[^a-z0-9\n]*)$"
)
EMPTY_LINE = r"\n[ \t\r]*\n"


def _normal(c: Column) -> Column:
    return F.rtrim(F.btrim(F.regexp_replace(c, OTHER, " "), F.lit(" ")), F.lit("."))


def rule_pattern(names: tuple[str, ...]) -> str:
    """Identifiers one after another in a string where each stands between spaces."""
    return " " + "  ".join(names) + " "


def find_licences(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` and, of each whole text, what licences it states.

    ``sentence_ids``: identifiers of the known sentences in order, separated by spaces; ``n_known``
    their number; ``licences``: names of the licences whose rules match, in the order of the
    rules, each once, separated by commas.  A sentence may run over several lines, with the marks of
    a comment before each; one that isn't known is cut behind copyright lines and titles, and what
    is still unknown is tried line by line.  Unknown sentences don't come between the known ones.

    A null or empty text has none of these: empty strings and 0.  Rows stand alone; no rows give no
    rows; columns not carried are ignored, one named like a result is left out.
    """
    results = {"sentence_ids", "n_known", "licences", "_ids", "_left"}
    carry, _ = carried(docs, carry, results | {f"_m{i}" for i in range(len(RULES))})
    handed = [F.col(f"`{c}`") for c in carry]
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])

    def piece(sentence: Column) -> Column:
        whole = F.element_at(known, _normal(sentence))
        by_line = F.filter(
            F.transform(F.split(sentence, "\n"), lambda x: F.element_at(known, _normal(x))),
            lambda x: x.isNotNull(),
        )
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(by_line)

    def lookup(sentence: Column) -> Column:
        whole = F.element_at(known, _normal(sentence))
        cut = F.split(F.regexp_replace(sentence, OWN_LINE, "$0\n"), EMPTY_LINE)
        return (
            F.when(whole.isNotNull(), F.array(whole))
            .when(F.contains(sentence, F.lit("\n")), F.flatten(F.transform(cut, piece)))
            .otherwise(F.array().cast("array<string>"))
        )

    lower = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.regexp_replace(lower, LINE_MARKS, "")
    sentences = F.split(text, SENTENCE_END)
    ids = F.flatten(F.transform(sentences, lookup))
    out = docs.select(*handed, ids.alias("_ids"))
    # each identifier between spaces of its own
    spaced = F.array_join(F.transform("_ids", lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "")
    out = out.withColumn("_left", spaced)
    found = []
    for i, (_, names) in enumerate(RULES):
        pattern = F.lit(rule_pattern(names))
        out = out.withColumns(
            {
                f"_m{i}": F.contains("_left", pattern),
                "_left": F.replace("_left", pattern, F.lit(" | ")),
            }
        )
        found.append(f"_m{i}")
    matched = F.array(*[F.when(F.col(m), F.lit(name)) for m, (name, _) in zip(found, RULES)])
    return out.select(
        *handed,
        F.array_join("_ids", " ").alias("sentence_ids"),
        F.size("_ids").cast("long").alias("n_known"),
        F.array_join(F.array_distinct(F.array_compact(matched)), ",").alias("licences"),
    )


def licence_sql(table: str = "documents", key: str = "doc_id") -> str:
    """The same in DuckDB's SQL, but for line marks and cuts behind copyright lines and titles."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in KNOWN.items()) + "}"

    def norm(x: str) -> str:
        return f"rtrim(trim(regexp_replace({x}, '{OTHER}', ' ', 'g'), ' '), '.')"

    steps = [
        f"contains(left{i}, {quote(rule_pattern(names))}) AS m{i}, "
        f"replace(left{i}, {quote(rule_pattern(names))}, ' | ') AS left{i + 1}"
        for i, (_, names) in enumerate(RULES)
    ]
    chain = reduce(lambda inner, step: f"SELECT *, {step} FROM ({inner})", steps, "SELECT * FROM spaced")
    matched = ", ".join(f"CASE WHEN m{i} THEN {quote(n)} END" for i, (n, _) in enumerate(RULES))
    return f"""
WITH cut AS (
    SELECT {key}, string_split_regex(lower(coalesce(text, '')), '{SENTENCE_END}') AS s FROM {table}),
looked AS (
    SELECT {key}, flatten(list_transform(s, lambda x: CASE
        WHEN known[{norm("x")}] IS NOT NULL THEN [known[{norm("x")}]]
        ELSE list_filter(list_transform(string_split(x, chr(10)), lambda y: known[{norm("y")}]),
            lambda z: z IS NOT NULL) END)) AS ids
    FROM cut, (SELECT {known} AS known)),
spaced AS (
    SELECT *, coalesce(array_to_string(list_transform(ids, lambda x: ' ' || x || ' '), ''), '') AS left0
    FROM looked),
ruled AS ({chain}),
named AS (SELECT *, list_filter([{matched}], lambda x: x IS NOT NULL) AS names FROM ruled)
SELECT {key}, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, len(ids)::BIGINT AS n_known,
    coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '')
        AS licences
FROM named
"""
