"""Licence scans by sentence rules.

A text is cut in sentences; each is normalised and mapped to the identifier of
a known licence sentence, or to none; the text's identifiers, in order, are
matched against the rules, each an ordered run of identifiers with at most
``GAP`` unknown sentences between two neighbours.  The identifiers of a text
form a string of codes between blanks, so a rule is a regular expression over
codes and the whole scan is column expressions: no UDF, join or shuffle.  A
sentence in which a holder's name stands is known by its pattern (``VARIANTS``).
Rules are looked at only for texts in which a known sentence stands.

A text is cut twice: with line ends as sentence ends, and with wrapped lines
joined within a paragraph; what either finds counts.  Markers of comments at
line starts are ignored.

Null and empty texts have no sentences and no licence.  One row out for each
row in, whatever its id; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

GAP = 2

_WARRANTY_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_SPDX = ("MIT", "Apache-2.0", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "ISC", "MIT OR Apache-2.0", "Apache-2.0 OR MIT")

#: Rule name -> (licence, its sentences in order).  Public licence wording (fixed values).
RULES: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache-notice": ("Apache-2.0", ("Licensed under the Apache License, Version 2.0.",)),
    "apache-header": ("Apache-2.0", ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "You may obtain a copy of the License at")),
    "mit-notice": ("MIT", ("Released under the MIT License.",)),
    "mit-notice-licensed": ("MIT", ("Licensed under the MIT License.",)),
    "mit-text": ("MIT", ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")),
    "gpl3-notice": ("GPL-3.0", ("This work is licensed under the GNU General Public License, version 3.",)),
    "gpl3-header": ("GPL-3.0-or-later", ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",)),
    "gpl2-header": ("GPL-2.0-or-later", ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",)),
    "gpl-only-header": ("GPL-3.0", ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",)),
    "lgpl21-header": ("LGPL-2.1-or-later", ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",)),
    "lgpl3-header": ("LGPL-3.0-or-later", ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",)),
    "agpl3-header": ("AGPL-3.0-or-later", ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",)),
    "epl2-header": ("EPL-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",)),
    "unlicense-text": ("Unlicense", ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")),
    "zlib-text": ("Zlib", ("This software is provided 'as-is', without any express or implied warranty.", "In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:")),
    "boost-header": ("BSL-1.0", ("Distributed under the Boost Software License, Version 1.0.",)),
    "cc0-notice": ("CC0-1.0", ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",)),
    "apache-text": ("Apache-2.0", ("Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",)),
    "mpl-header": ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
    "bsd-2-text": ("BSD-2-Clause", (*_BSD, _WARRANTY_BSD)),
    "bsd-3-text": ("BSD-3-Clause", (*_BSD, _ENDORSE, _WARRANTY_BSD)),
    "isc-text": ("ISC", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",)),
    "cc-by-nc-notice": ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0.",)),
    "cc-by-notice": ("CC-BY-4.0", ("Licensed under CC BY 4.0.",)),
    "cc-by-sa-notice": ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0.",)),
    **{f"spdx-{x.lower()}": (x, (f"SPDX-License-Identifier: {x}",)) for x in _SPDX},
}

_MARKERS = r"(?m)^[ \t]*(//+|#+|\*+|--+|/\*+|<!--)[ \t]*"
_OTHER = r"[^A-Za-z0-9\n.;:!?]+"
_LINE_ENDS = r"[.;:!?]+([ \n]|$)|\n"
_PARAGRAPH = r"\n *\n[ \n]*"
_ENDS = r"[.;:!?]+( |$)"


def sentences(text: str) -> list[str]:
    """The normalised sentences of a known text (its lines joined)."""
    t = re.sub(_OTHER, " ", text).lower()
    return [s.strip() for s in re.sub(_ENDS, "\0", t).split("\0") if s.strip()]


#: Known sentence -> identifier; a text's unknown sentences are '--'.
KNOWN = {s: str(i) for i, s in enumerate(dict.fromkeys(s for _, lines in RULES.values() for line in lines for s in sentences(line)))}
UNKNOWN = "--"
#: Beginning of a sentence, pattern of the whole, the known sentence that it stands for.
VARIANTS = (("neither the name of ", "neither the name of .* nor the names of (its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission", sentences(_ENDORSE)[0]),)


def pattern(lines: tuple[str, ...]) -> str:
    return f"( {UNKNOWN}){{0,{GAP}}}".join(f" {KNOWN[s]}" for line in lines for s in sentences(line)) + "( |$)"


def _codes(cut: Column) -> Column:
    units = F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")
    known = F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])
    named = lambda s: [F.when(s.startswith(begin) & s.rlike(f"^{p}$"), F.lit(KNOWN[of])) for begin, p, of in VARIANTS]
    return F.concat(F.lit(""), F.array_join(F.transform(units, lambda s: F.concat(F.lit(" "), F.coalesce(F.try_element_at(known, s), *named(s), F.lit(UNKNOWN)))), ""))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_known (known sentences, lines taken alone), rules and
    licences found (sorted, comma-joined) for each row."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _MARKERS, ""), _OTHER, " "))
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace("_clean", _PARAGRAPH, "! "), "\n", " "), " +", " ")
    rows = df.select(F.col(id_col).alias("doc_id"), clean.alias("_clean"))
    rows = rows.select("doc_id", _codes(F.split("_clean", _LINE_ENDS)).alias("_by_line"), _codes(F.split(joined, _ENDS)).alias("_by_paragraph"))
    met = F.array(*[F.when(F.col("_by_line").rlike(p) | F.col("_by_paragraph").rlike(p), F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("licence"))) for name, licence, p in sorted((n, v[0], pattern(v[1])) for n, v in RULES.items())])
    some = F.col("_by_line").rlike(r"\d") | F.col("_by_paragraph").rlike(r"\d")
    found = F.when(some, F.filter(met, lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<rule:string,licence:string>>"))
    rows = rows.select("doc_id", F.regexp_count("_by_line", F.lit(r"\d+")).cast("long").alias("n_known"), found.alias("_met"))
    return rows.select("doc_id", "n_known", F.array_join(F.transform("_met", lambda x: x["rule"]), ",").alias("rules"), F.array_join(F.array_sort(F.array_distinct(F.transform("_met", lambda x: x["licence"]))), ",").alias("licences"))


def op5_licences(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in KNOWN.items()) + "}"
    named = "".join(f" CASE WHEN regexp_matches(s, {quote('^' + p + '$')}) THEN {quote(KNOWN[of])} END," for _, p, of in VARIANTS)
    codes = lambda cut: f"list_aggregate(list_append(list_transform(list_filter(list_transform({cut}, lambda s: trim(s, ' ')), lambda s: s <> ''), lambda s: ' ' || coalesce(list_extract(map_extract({known}, s), 1),{named} '{UNKNOWN}')), ''), 'string_agg', '')"
    met = ", ".join(f"CASE WHEN regexp_matches(l, {quote(p)}) OR regexp_matches(p, {quote(p)}) THEN {{'rule': {quote(n)}, 'licence': {quote(lic)}}} END" for n, lic, p in sorted((n, v[0], pattern(v[1])) for n, v in RULES.items()))
    e = lambda s: "e" + quote(s.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"""
WITH c AS (SELECT doc_id, lower(regexp_replace(regexp_replace(coalesce(text, ''), {e(_MARKERS)}, '', 'g'), {e(_OTHER)}, ' ', 'g')) AS clean FROM documents),
j AS (SELECT doc_id, clean, regexp_replace(regexp_replace(regexp_replace(clean, {e(_PARAGRAPH)}, '! ', 'g'), e'\\n', ' ', 'g'), ' +', ' ', 'g') AS joined FROM c),
k AS (SELECT doc_id, {codes(f"string_split_regex(clean, {e(_LINE_ENDS)})")} AS l, {codes(f"string_split_regex(joined, {e(_ENDS)})")} AS p FROM j),
m AS (SELECT doc_id, len(regexp_extract_all(l, '[0-9]+'))::BIGINT AS n_known, list_filter([{met}], lambda x: x IS NOT NULL) AS met FROM k)
SELECT doc_id, n_known, array_to_string(list_transform(met, lambda x: x.rule), ',') AS rules, array_to_string(list_sort(list_distinct(list_transform(met, lambda x: x.licence))), ',') AS licences FROM m
"""


OP5_SQL = _sql()
