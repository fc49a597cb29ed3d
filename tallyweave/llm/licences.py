"""8. License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences: at ``.``, ``!``, ``?`` before white space, at lines without a letter or
digit, before list items, and around copyright lines. A line end alone is white space, so wrapped
sentences are whole, and comment marks at the start of a line are no letters. Sentences are normalised
(lower case, what is no ASCII letter or digit as one space, an item's number away), and known licence sentences become
their identifiers. A sentence that is not known is looked up in its parts, at ``:`` and ``;``, and
those in their lines, so that a reference on a line of its own is found, too.

The sequence of a text's identifiers, in order and without what is unknown, is matched against ordered
rules: a rule is a sequence of identifiers that must occur in one run. The first rule that matches
names the text's licence; all rules that match are listed.

The vocabulary is a parameter of bounded size, part of the plan; texts are judged where they are
read, with no shuffle.

Defined cases: a null, empty or unknown text has no sentences, no licence and the class ``none``;
repeated rows get equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents

MAX_TERMS = 2000

# The licences' own words.
#: Identifier and normalised sentence.
SENTENCES = (
    ("apache-2.0-ref", "licensed under the apache license version 2 0"),
    ("apache-2.0-ref", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0-use", "you may not use this file except in compliance with the license"),
    ("apache-2.0-copy", "you may obtain a copy of the license at"),
    ("apache-2.0-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-ref", "released under the mit license"),
    ("mit-ref", "licensed under the mit license"),
    ("mit-ref", "this project is licensed under the mit license"),
    ("mit-title", "the mit license"),
    ("mit-title", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("gpl-3-ref", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3-ref", "licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc-4-ref", "licensed under cc by nc 4 0"),
    ("cc-by-4-ref", "licensed under cc by 4 0"),
    ("cc-by-sa-4-ref", "licensed under cc by sa 4 0"),
    ("cc0-ref", "licensed under cc0 1 0"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-liable", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3-ref", "licensed under the bsd 3 clause license"),
    ("bsd-2-ref", "licensed under the bsd 2 clause license"),
    ("gpl-2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2-ref", "licensed under the gnu general public license version 2"),
    ("lgpl-3-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-warranty", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl-see", "see the gnu lesser general public license for more details"),
    ("lgpl-3-ref", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-see", "see the gnu affero general public license for more details"),
    ("agpl-3-ref", "licensed under the gnu affero general public license version 3"),
    # the sentence ends in "v. 2.0", which is cut after the v
    ("mpl-2.0-form", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl-2.0-copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl-2.0-copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("mpl-2.0-ref", "licensed under the mozilla public license version 2 0"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc-ref", "licensed under the isc license"),
    ("0bsd-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib-ref", "licensed under the zlib license"),
    ("epl-2.0-ref", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("epl-2.0-ref", "licensed under the eclipse public license 2 0"),
    ("bsl-1.0-ref", "distributed under the boost software license version 1 0"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("unlicense-use", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("public-domain", "this work is in the public domain"),
    ("all-rights", "all rights reserved"),
)

#: Licence, class, identifiers in a run. The first that matches decides.
RULES = (
    ("Apache-2.0", "permissive", ("apache-2.0-ref", "apache-2.0-use", "apache-2.0-copy")),
    ("MIT", "permissive", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", "copyleft", ("gpl-free", "gpl-warranty")),
    ("GPL-2.0-or-later", "copyleft", ("gpl-2-free", "gpl-warranty")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl-3-free", "lgpl-warranty")),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl-2.1-free", "lgpl-warranty")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl-3-free", "gpl-warranty")),
    ("MPL-2.0", "copyleft", ("mpl-2.0-form", "mpl-2.0-copy")),
    ("ISC", "permissive", ("isc-grant", "isc-as-is")),
    ("0BSD", "permissive", ("0bsd-grant", "isc-as-is")),
    ("Zlib", "permissive", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("Unlicense", "permissive", ("unlicense-free", "unlicense-use")),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-4-ref",)),
    ("GPL-3.0", "copyleft", ("gpl-3-ref",)),
    ("AGPL-3.0", "copyleft", ("agpl-3-ref",)),
    ("LGPL-3.0", "copyleft", ("lgpl-3-ref",)),
    ("GPL-2.0", "copyleft", ("gpl-2-ref",)),
    ("MPL-2.0", "copyleft", ("mpl-2.0-ref",)),
    ("EPL-2.0", "copyleft", ("epl-2.0-ref",)),
    ("BSL-1.0", "permissive", ("bsl-1.0-ref",)),
    ("ISC", "permissive", ("isc-ref",)),
    ("Zlib", "permissive", ("zlib-ref",)),
    ("BSD-3-Clause", "permissive", ("bsd-3-ref",)),
    ("BSD-2-Clause", "permissive", ("bsd-2-ref",)),
    ("Apache-2.0", "permissive", ("apache-2.0-ref",)),
    ("MIT", "permissive", ("mit-ref",)),
    ("MIT", "permissive", ("mit-title", "mit-grant")),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-4-ref",)),
    ("CC-BY-4.0", "permissive", ("cc-by-4-ref",)),
    ("CC0-1.0", "permissive", ("cc0-ref",)),
    ("Public-Domain", "permissive", ("public-domain",)),
    ("All-Rights-Reserved", "proprietary", ("all-rights",)),
)


#: Patterns that both engines of the tests read alike: blank lines, list items, copyright lines become the mark ``END``.
END = "\x01"
BREAKS = (
    r"\n[^a-z0-9\n]*\n",
    r"\n[ \t]*([-+\x{2022}]|[0-9]{1,2}[.)]|\([0-9a-z]{1,2}\))[ \t]",
    r"(^|\n)[^a-z0-9\n]*copyright[ \t]*(\(c\)|\x{A9}|[0-9])[^\n.]*",
)
ITEM = "^([0-9]{1,2}|[a-h]|i|ii|iii|iv|v|vi) "
#: A run of marks is tried from its start alone, so that long runs take linear time.
SENTENCE_END, PART_END = END + r"|(?<![.!?])[.!?]++(?=[ \t\n]|\z)", r"[:;](?=[ \t\n]|\z)"


def normal(s: F.Column) -> F.Column:
    return F.regexp_replace(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), ITEM, "")


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """One row per input row: id, sentence_ids (in order, comma-joined), licence, licence_class, licences (comma-joined, in rule order)."""
    if len(sentences) + len(rules) > MAX_TERMS:
        raise ValueError(f"scan_licences: more than {MAX_TERMS} sentences and rules")
    known: dict[str, str] = {s: i for i, s in sentences}
    if not all(known) or any("," in i for i in known.values()):
        raise ValueError("scan_licences: a sentence is empty or an identifier has a comma")
    table = F.create_map(*[F.lit(x) for s, i in known.items() for x in (s, i)])
    # a sentence as (identifier if known, itself)
    looked_up = lambda s: F.struct(table[normal(s)].alias("i"), s.alias("s"))
    nothing = F.expr("cast(array() as array<string>)")

    def ids_of(parts: F.Column, *ends: str) -> F.Column:
        def ids(x: F.Column) -> F.Column:
            if not ends:
                return F.when(x["i"].isNotNull(), F.array(x["i"])).otherwise(nothing)
            inner = ids_of(F.split(x["s"], ends[0]), *ends[1:])
            further = F.when(x["s"].rlike(ends[0]) if len(ends) == 1 else x["s"].rlike(f"(?:{ends[0]})|{ends[1]}"), inner)
            return F.when(x["i"].isNotNull(), F.array(x["i"])).otherwise(F.coalesce(further, nothing))

        return F.flatten(F.transform(F.transform(parts, looked_up), ids))

    text = F.regexp_replace(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"\r\n?", "\n")
    for pattern in BREAKS:
        text = F.regexp_replace(text, pattern, END)
    ids = ids_of(F.split(text, SENTENCE_END), PART_END, r"\n")
    t = df.select(F.col(id_col).alias("id"), F.array_join(ids, ",").alias("ids"))
    run = F.concat(F.lit(","), F.col("ids"), F.lit(","))
    hits = [F.when(F.contains(run, F.lit("," + ",".join(seq) + ",")), F.lit(name)) for name, _, seq in rules]
    t = t.withColumn("all", F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    kinds = F.create_map(*[F.lit(x) for name, kind in {r[0]: r[1] for r in rules}.items() for x in (name, kind)])
    first = F.get("all", F.lit(0))
    return t.select(
        F.col("id").alias(id_col),
        F.col("ids").alias("sentence_ids"),
        first.alias("licence"),
        F.coalesce(kinds[first], F.lit("none")).alias("licence_class"),
        F.array_join("all", ",").alias("licences"),
    )


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_documents(spark, sf_dir))


def _sql() -> str:
    known = {s: i for i, s in SENTENCES}
    table = ", ".join(f"'{s}': '{i}'" for s, i in known.items())
    hits = ", ".join(f"CASE WHEN contains(',' || ids || ',', ',{','.join(seq)},') THEN '{name}' END" for name, _, seq in RULES)
    kinds = " ".join(f"WHEN '{name}' THEN '{kind}'" for name, kind in {r[0]: r[1] for r in RULES}.items())
    normal = lambda s: f"regexp_replace(trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g')), '{ITEM}', '')"
    text = r"regexp_replace(lower(coalesce(text, '')), '\r\n?', chr(10), 'g')"
    for pattern in BREAKS:
        text = f"regexp_replace({text}, '{pattern}', chr(1), 'g')"
    lines = f"list_filter(list_transform(string_split(q, chr(10)), lambda l: known[{normal('l')}]), lambda i: i IS NOT NULL)"
    inner = rf"flatten(list_transform(string_split_regex(p, '[:;]([ \t\n]|$)'), lambda q: CASE WHEN known[{normal('q')}] IS NOT NULL THEN [known[{normal('q')}]] ELSE {lines} END))"
    return rf"""
WITH m AS (SELECT MAP {{{table}}} AS known), t AS (
  SELECT doc_id, string_split_regex({text}, '\x01|[.!?]+([ \t\n]|$)') AS parts FROM documents
), i AS (
  SELECT doc_id, array_to_string(flatten(list_transform(parts, lambda p: CASE WHEN known[{normal('p')}] IS NOT NULL THEN [known[{normal('p')}]] ELSE {inner} END)), ',') AS ids FROM t, m
), r AS (
  SELECT doc_id, coalesce(ids, '') AS ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS found FROM i
), a AS (
  SELECT doc_id, ids, found[1] AS licence, found FROM r
)
SELECT doc_id, ids AS sentence_ids, licence,
  CASE licence {kinds} ELSE 'none' END AS licence_class,
  array_to_string(list_filter(found, lambda x, k: list_position(found, x) = k), ',') AS licences
FROM a
"""


SQL = _sql()
