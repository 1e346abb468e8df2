"""License scans by sentence rules, with built-in functions only.

A text is cut into sentences (at line ends and after ``.``, ``!``, ``?`` or ``;`` before white space),
each is normalised (``A-Z`` to lower case, runs of other than letters a-z and digits to one space), and
known sentences become their identifiers.  A known sentence may be wrapped over lines (a line end counts
as a space, comment marks at line starts drop out, an empty line ends it), and one with a dot before a
space inside must be there with all of its parts.  The identifiers of a text, in order, are matched against
ordered rules from left to right, at each place the longest, whose identifiers are used up.  All
of it happens within the row: nothing is shuffled, and the known sentences are a bounded constant.

Defined cases: null and empty texts have no sentences and no licenses; a sentence may stand anywhere
between other text; repeats of a license count once; equal and null ids are rows of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The wording of published licences.
#: identifier -> sentence
SENTENCES = {
    1: "Released under the MIT License",
    2: "Licensed under the Apache License, Version 2.0",
    3: "Licensed under CC BY-NC 4.0",
    4: "This work is licensed under the GNU General Public License, version 3",
    10: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    11: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    20: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    21: "you may not use this file except in compliance with the License",
    22: "You may obtain a copy of the License at",
    30: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    31: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    41: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    42: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    43: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    50: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    60: "SPDX-License-Identifier: MIT",
    61: "SPDX-License-Identifier: Apache-2.0",
    62: "SPDX-License-Identifier: GPL-3.0-or-later",
    63: "SPDX-License-Identifier: BSD-3-Clause",
    70: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    71: "Licensed under CC BY 4.0",
    72: "Licensed under CC BY-SA 4.0",
    73: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    80: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    81: "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    82: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    90: "This is free and unencumbered software released into the public domain",
    91: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    92: "This software is provided 'as-is', without any express or implied warranty",
    93: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    94: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    100: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    101: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    102: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    110: "SPDX-License-Identifier: BSD-2-Clause",
    111: "SPDX-License-Identifier: MPL-2.0",
    112: "SPDX-License-Identifier: ISC",
    113: "SPDX-License-Identifier: LGPL-2.1-or-later",
    114: "SPDX-License-Identifier: GPL-2.0-only",
    115: "SPDX-License-Identifier: CC0-1.0",
    116: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}
#: (license, identifiers in order); longer rules over the same identifiers win
RULES = [
    ("MIT", (1,)), ("Apache-2.0", (2,)), ("CC-BY-NC-4.0", (3,)), ("GPL-3.0-only", (4,)),
    ("MIT", (10, 11)), ("Apache-2.0", (20, 21)), ("Apache-2.0", (20, 21, 22)), ("GPL-3.0-or-later", (30,)), ("GPL-3.0-or-later", (30, 31)),
    ("BSD-2-Clause", (40, 41, 42)), ("BSD-3-Clause", (40, 41, 42, 43)), ("MPL-2.0", (50,)),
    ("MIT", (60,)), ("Apache-2.0", (61,)), ("GPL-3.0-or-later", (62,)), ("BSD-3-Clause", (63,)),
    ("CC-BY-4.0", (70,)), ("CC-BY-4.0", (71,)), ("CC-BY-SA-4.0", (72,)), ("CC-BY-SA-4.0", (73,)), ("MIT", (10, 11, 82)), ("ISC", (80,)), ("ISC", (80, 81)),
    ("Unlicense", (90,)), ("Unlicense", (90, 91)), ("Zlib", (92, 93)), ("BSL-1.0", (94,)), ("LGPL-2.1-or-later", (100,)), ("AGPL-3.0-or-later", (101,)), ("GPL-2.0-or-later", (102,)),
    ("GPL-2.0-or-later", (102, 31)), ("LGPL-2.1-or-later", (100, 31)), ("AGPL-3.0-or-later", (101, 31)),
    ("BSD-2-Clause", (110,)), ("MPL-2.0", (111,)), ("ISC", (112,)), ("LGPL-2.1-or-later", (113,)), ("GPL-2.0-only", (114,)), ("CC0-1.0", (115,)), ("CC0-1.0", (116,)),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def pattern() -> str:
    """Matches known sentences between ends: "|" ends a sentence, a line end may stand for each space."""
    parts = [[normal(x).replace(" ", "[ \n]") for x in re.split(r"[.!?;]+\s", s.rstrip(".:"))] for s in SENTENCES.values()]
    known = sorted((r"\|\n?".join(p) for p in parts), key=lambda x: (-len(x), x))
    return rf"(?<=[|\n])(?:{'|'.join(known)})(?=[|\n])"


def sequences() -> dict[str, str]:
    """Identifiers as written in a sequence, each between commas -> license; longer rules come first."""
    return {"".join(f",{k}," for k in ids): name for name, ids in sorted(RULES, key=lambda r: -len(r[1]))}


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> ``(id, sentence_ids array<int>, licenses array<string>)``, licenses distinct and sorted."""
    known = ", ".join(f"'{normal(s)}', {k}" for k, s in SENTENCES.items())
    t = F.translate(F.concat(F.lit("\n"), F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("\n")), UPPER + "|", LOWER + " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[.!?;]+[\x20\x09-\x0D]", "|\n"), r"[^a-z0-9|\n]+", " ")
    t = F.regexp_replace(t, r" ?([|\n]) ?", "$1")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.regexp_extract_all(t, F.lit(pattern()), F.lit(0)).alias("s"))
    d = d.select("id", F.expr(f"transform(s, x -> try_element_at(map({known}), regexp_replace(x, '[^a-z0-9]+', ' ')))").alias("sentence_ids"))
    found = sequences()
    seq = F.array_join(F.transform("sentence_ids", lambda k: F.concat(F.lit(","), k.cast("string"), F.lit(","))), "")
    names = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
    # from left to right the longest rule at each place; its identifiers are used up
    hit = F.transform(F.regexp_extract_all(seq, F.lit("|".join(found)), F.lit(0)), lambda x: F.try_element_at(names, x))
    return d.select("id", "sentence_ids", F.array_sort(F.array_distinct(hit)).alias("licenses"))


def duck_sql() -> str:
    """The same by plain steps: whole sentences first, then each known sentence looked for at every sentence's start."""
    known = ", ".join(f"({k}, '{normal(x)}', {n}, {len(parts)})" for k, x_ in SENTENCES.items() for parts in [re.split(r"[.!?;]+\s", x_.rstrip(".:"))] for n, x in enumerate(parts, 1))
    rules = ", ".join(f"('{x}', '{n}', {x.count(',,') + 1})" for x, n in sequences().items())
    space = r"[.!?;]+[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(translate(chr(10) || coalesce(text, '') || chr(10), '{UPPER}|', '{LOWER} '), '{space}', '|' || chr(10), 'g') AS t FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(t, chr(10)) AS a FROM d)),
n AS (SELECT doc_id, i, trim(regexp_replace(replace(x, '|', ' '), '[^a-z0-9]+', ' ', 'g')) AS x, ends_with(x, '|') AS stop, contains(x, '|') AS cut FROM l),
k AS (SELECT * FROM (VALUES {known}) AS v(id, x, part, parts)),
w AS (SELECT doc_id, i, i AS j, x AS y FROM n WHERE x <> '' AND EXISTS (SELECT 1 FROM k WHERE starts_with(k.x, n.x))
  UNION ALL SELECT w.doc_id, w.i, n.i, y || ' ' || n.x FROM w JOIN n ON n.doc_id = w.doc_id AND n.i = w.j + 1 JOIN n AS b ON b.doc_id = w.doc_id AND b.i = w.j WHERE NOT b.stop AND n.x <> '' AND EXISTS (SELECT 1 FROM k WHERE starts_with(k.x, y || ' ' || n.x))),
m AS (SELECT doc_id, i, j, id, part, parts FROM w JOIN k ON w.y = k.x),
f AS (SELECT a.doc_id, a.i, a.id FROM m a WHERE a.parts = 1 OR (a.part = 1 AND EXISTS (SELECT 1 FROM m b WHERE b.doc_id = a.doc_id AND b.id = a.id AND b.part = 2 AND b.i = a.j + 1))),
s AS (SELECT doc_id, list(id ORDER BY i) AS ids FROM f GROUP BY 1),
q AS (SELECT documents.doc_id, coalesce(ids, []) AS ids, coalesce(array_to_string(list_transform(ids, lambda k: ',' || k || ','), ''), '') AS seq FROM documents LEFT JOIN s USING (doc_id)),
r AS (SELECT * FROM (VALUES {rules}) AS v(seq, name, size)),
g AS (SELECT doc_id, seq AS rest, CAST(NULL AS VARCHAR) AS name FROM q UNION ALL
  SELECT doc_id, CASE WHEN b.seq IS NULL THEN regexp_replace(rest, '^,[0-9]+,', '') ELSE substr(rest, length(b.seq) + 1) END, b.name FROM g, LATERAL (SELECT max_by(struct_pack(seq := r.seq, name := r.name), r.size) AS u FROM r WHERE starts_with(rest, r.seq)) c, LATERAL (SELECT u.seq AS seq, u.name AS name) b WHERE rest <> ''),
h AS (SELECT doc_id, list_sort(list_distinct(list(name) FILTER (name IS NOT NULL))) AS names FROM g GROUP BY 1)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licenses FROM q JOIN h USING (doc_id)"""
