"""License scans by sentence rules, with DataFrame functions only.

Marks of comments before a line (``*``, ``//``, ``#`` and the like) are taken
away.  A text is cut into sentences (at full stops, question and exclamation
marks before white space, at blank lines, and around an SPDX line).  A sentence
is normalised: lower case, anything but letters a-z and digits becomes one
space.  Known sentences have identifiers; in a sentence that is not known, known
ones are found at word borders (the longest of those that begin first, none
after "not"), so that a header below a copyright line is found; an SPDX line has
to be known as a whole.  The text becomes a string of
identifiers, unknown sentences are marks between them.  A licence rule is an
ordered list of identifiers; it holds where they follow each other with at
most ``GAP`` unknown sentences between two.

``SQL`` knows the first table of sentences and whole lines only; both agree on
texts without commented headers, sentences run together and the later sentences.

No row meets another, so nothing is shuffled and no group can be hot.

Nulls and odd rows: a null or empty text has no sentences and no licence
(empty strings).  A null doc_id and repeated rows are rows like any other;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 2

# Names that licence notices use, by SPDX identifier.
NAMES = {
    "MIT": ["the mit license"],
    "Apache-2.0": ["the apache license version 2 0", "the apache license 2 0"],
    "BSD-2-Clause": ["the bsd 2 clause license"],
    "BSD-3-Clause": ["the bsd 3 clause license"],
    "ISC": ["the isc license"],
    "MPL-2.0": ["the mozilla public license version 2 0", "the mozilla public license 2 0"],
    "GPL-2.0-only": ["the gnu general public license version 2"],
    "GPL-3.0-only": ["the gnu general public license version 3"],
    "LGPL-2.1-only": ["the gnu lesser general public license version 2 1"],
    "LGPL-3.0-only": ["the gnu lesser general public license version 3"],
    "AGPL-3.0-only": ["the gnu affero general public license version 3"],
    "Unlicense": ["the unlicense"],
}
# The Creative Commons terms, and how notices begin.
CC_TERMS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-ND": "attribution noderivatives", "BY-NC": "attribution noncommercial",
            "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
BEGINNINGS = ["licensed under", "released under", "distributed under", "this work is licensed under", "this project is licensed under",
              "this software is licensed under", "this file is licensed under"]
# Sentences of licence texts and headers, normalised.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
                 "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
                 "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
                 "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
                 "included in all copies or substantial portions of the software",
    "mit-grant-alone": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                       "documentation files the software to deal in the software without restriction including without limitation the "
                       "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                       "persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the "
                    "warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an "
                     "action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
                     "dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                 "conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
                  "disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                 "derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
                    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-use": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
                    "as is basis without warranties or conditions of any kind either express or implied",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
                "of merchantability or fitness for a particular purpose",
}
# Rules, as ordered identifiers.
RULES = [
    ("MIT", ["mit-grant", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant-alone", "mit-notice", "mit-warranty", "mit-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"]),
    ("Apache-2.0", ["apache-use", "apache-basis"]),
]


def known_sentences() -> dict:
    """Normalised sentence -> identifier: the fixed ones, and notices built from names."""
    out = {text: key for key, text in SENTENCES.items()}
    for version in (2, 3):
        out["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            f"published by the free software foundation either version {version} of the license or at your option any later version"] = f"gpl-{version}-later"
    names = {spdx: list(texts) for spdx, texts in NAMES.items()}
    for term, words in CC_TERMS.items():
        for version in ("3.0", "4.0"):
            spoken = version.replace(".", " ")
            names[f"CC-{term}-{version}"] = [f"cc {term.lower().replace('-', ' ')} {spoken}", f"a creative commons {words} {spoken} license",
                                             f"a creative commons {words} {spoken} international license"]
    for spdx, texts in names.items():
        for text in texts:
            for beginning in BEGINNINGS:
                out[f"{beginning} {text}"] = f"notice-{spdx}"
        out["spdx license identifier " + spdx.lower().replace("-", " ").replace(".", " ")] = f"notice-{spdx}"
    return out


def rules() -> list:
    """(licence, ordered identifiers): the fixed ones, GPL headers, and every notice alone."""
    out = list(RULES) + [(f"GPL-{v}.0-or-later", [f"gpl-{v}-later", "gpl-hope"]) for v in (2, 3)]
    return out + sorted({(key.removeprefix("notice-"), (key,)) for key in known_sentences().values() if key.startswith("notice-")})


def numbers() -> dict:
    """Identifier -> number, in order of first mention."""
    return {key: i + 1 for i, key in enumerate(dict.fromkeys(known_sentences().values()))}


def rule_pattern(identifiers, known: dict) -> str:
    """Over a string in which a known sentence is ``<number>`` and an unknown one ``_``."""
    return ("_{0,%d}" % GAP).join(f"<{known[i]}>" for i in identifiers)


# Sentences that the SQL twin does not know.
_VERSIONS = [("gpl", "GPL", "", "2", "2.0"), ("gpl", "GPL", "", "3", "3.0"), ("lgpl", "LGPL", "lesser ", "2 1", "2.1"),
             ("lgpl", "LGPL", "lesser ", "3", "3.0"), ("agpl", "AGPL", "affero ", "3", "3.0")]
_TITLES = {"GPL-2.0": "gnu general public license version 2 june 1991", "GPL-3.0": "gnu general public license version 3 29 june 2007",
           "LGPL-2.1": "gnu lesser general public license version 2 1 february 1999",
           "LGPL-3.0": "gnu lesser general public license version 3 29 june 2007", "AGPL-3.0": "gnu affero general public license version 3 19 november 2007"}
MORE_SENTENCES = {
    "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
    "fitness for a particular purpose": "gpl-hope",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-verbatim",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
    "above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the "
    "above copyright notice and this permission notice appear in all copies": "isc-grant",
    "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this "
    "software": "isc-liability",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-form",
    "if a copy of the mpl was not distributed with this file": "mpl-copy",
    "means each individual or legal entity that creates contributes to the creation of or owns covered software": "mpl-contributor",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for "
    "any purpose commercial or non commercial and by any means": "unlicense-use",
}
MORE_RULES = [
    ("ISC", ["isc-grant", "isc-warranty", "isc-liability"]),
    ("MPL-2.0", ["mpl-form", "mpl-copy"]),
    ("MPL-2.0", ["mpl-contributor"]),
    ("Unlicense", ["unlicense-domain", "unlicense-use"]),
]


def all_sentences() -> dict:
    """``known_sentences`` and the later ones: GNU headers with any subject, titles of GNU texts, later versions."""
    out = known_sentences()
    out.update(MORE_SENTENCES)
    for key, name, kind, spoken, version in _VERSIONS:
        license_name, terms = f"gnu {kind}general public license", "you can redistribute it and or modify it under the terms of the "
        published = "as published by the free software foundation"
        out[f"{terms}{license_name} {published} either version {spoken} of the license or at your option any later version"] = f"{key}-{spoken}-later"
        for only in (f"version {spoken} {published}", f"{published} version {spoken} of the license", f"{published} version {spoken}"):
            out[f"{terms}{license_name} {only}"] = f"{key}-{spoken}-only"
        for ending in ("or later", "or any later version", "or at your option any later version"):
            for beginning in BEGINNINGS:
                out[f"{beginning} the {license_name} version {spoken} {ending}"] = f"notice-{name}-{version}-or-later"
        out[f"spdx license identifier {name.lower()} {version.replace('.', ' ')} or later"] = f"notice-{name}-{version}-or-later"
        out[_TITLES[f"{name}-{version}"]] = f"{key}-{spoken}-title"
    return out


def all_rules() -> list:
    out = rules() + MORE_RULES
    for key, name, _, spoken, version in _VERSIONS:
        out += [(f"{name}-{version}-or-later", [f"{key}-{spoken}-later", "gpl-hope"]), (f"{name}-{version}-only", [f"{key}-{spoken}-only"]),
                (f"{name}-{version}-only", [f"{key}-{spoken}-title", "gnu-verbatim"]),
                (f"{name}-{version}-or-later", [f"notice-{name}-{version}-or-later"])]
    return out


# Every known sentence but SPDX lines has one of these; few others do.
_ANCHORS = "ed under|licens|permi|redistrib|software|warrant|mpl|copyright"
_LEADERS = r"(?md)^[ \t]*(?:<!--|\(\*|(?:dnl|rem)\b)?[ \t/*#;%!|>-]+"
_SPDX = r"(?md)^(spdx-license-identifier:[^\n]*)"
_STOP = r"[.!?]+[ \t\r\n]+|\n[ \t\r]*\n"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (sorted, joined by commas), sentence_ids (in the order
    of the text, joined by commas), n_sentences of every row of ``docs`` (doc_id, text)."""
    sentences = all_sentences()
    known = {key: i + 1 for i, key in enumerate(dict.fromkeys(sentences.values()))}
    table = F.create_map(*[F.lit(x) for text, key in sentences.items() for x in (text, f"<{known[key]}>")])
    inside = "|".join(sorted((text for text in sentences if not text.startswith("spdx ")), key=lambda text: (-len(text), text)))

    def marks(s):
        found = F.when(s.rlike(_ANCHORS) & ~s.startswith("spdx license identifier "),
                       F.regexp_extract_all(s, F.lit(rf"(?<![a-z0-9])(?<!\bnot )({inside})(?![a-z0-9])"), F.lit(1)))
        return F.coalesce(F.try_element_at(table, s), F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: F.try_element_at(table, x)), "")),
                          F.lit("_"))

    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), _LEADERS, ""), _SPDX, "\n\n$1\n\n")
    cut = F.filter(F.split(text, _STOP), lambda s: s.rlike("[a-z0-9]"))
    sentences = F.transform(cut, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    marked = docs.select("doc_id", F.transform(sentences, marks).alias("m")).select(
        "doc_id", F.array_join("m", "").alias("m"), F.size("m").cast("long").alias("n_sentences"))
    by_license: dict = {}
    for license_id, identifiers in all_rules():
        by_license.setdefault(license_id, []).append(rule_pattern(identifiers, known))
    any_known = F.col("m").contains("<")
    hits = F.array_compact(F.array(*[F.when(F.col("m").rlike("|".join(f"({p})" for p in patterns)), name)
                                     for name, patterns in sorted(by_license.items())]))
    ids = F.array_join(F.filter(F.split(F.regexp_replace("m", "[_<]+", ""), ">"), lambda x: x != ""), ",")
    return marked.select("doc_id", F.when(any_known, F.array_join(hits, ",")).otherwise("").alias("licenses"),
                         F.when(any_known, ids).otherwise("").alias("sentence_ids"), "n_sentences")


def op5_license_sentences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    known = numbers()
    rows = ", ".join(f"('{text}', '<{known[key]}>')" for text, key in known_sentences().items())
    by_license: dict = {}
    for license_id, identifiers in rules():
        by_license.setdefault(license_id, []).append(rule_pattern(identifiers, known))
    hits = ", ".join("CASE WHEN regexp_matches(m, '%s') THEN '%s' END" % ("|".join(f"({p})" for p in patterns), name)
                     for name, patterns in sorted(by_license.items()))
    return rf"""
WITH known(s, mark) AS (VALUES {rows}),
t AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS text FROM documents),
s AS (SELECT r, i, a[i] AS s FROM (SELECT r, string_split_regex(text, '[.!?]+[ \t\r\n]+|\n[ \t\r]*\n') AS a FROM t), unnest(range(1, len(a) + 1)) AS u(i)
  WHERE regexp_matches(a[i], '[a-z0-9]')),
whole AS (SELECT s.r, s.i, s.s, k.mark FROM s LEFT JOIN known k ON trim(regexp_replace(s.s, '[^a-z0-9]+', ' ', 'g')) = k.s),
lines AS (SELECT r, i, string_agg(k.mark, '' ORDER BY j) AS mark FROM
  (SELECT r, i, j, string_split(s, chr(10))[j] AS l FROM whole, unnest(range(1, len(string_split(s, chr(10))) + 1)) AS u(j) WHERE mark IS NULL) x
  JOIN known k ON trim(regexp_replace(x.l, '[^a-z0-9]+', ' ', 'g')) = k.s GROUP BY r, i),
m AS (SELECT w.r, string_agg(coalesce(w.mark, l.mark, '_'), '' ORDER BY w.i) AS m, count(*) AS n FROM whole w LEFT JOIN lines l ON w.r = l.r AND w.i = l.i GROUP BY w.r)
SELECT doc_id, coalesce(array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ','), '') AS licenses,
  coalesce(array_to_string(regexp_extract_all(m, '<([0-9]+)>', 1), ','), '') AS sentence_ids, coalesce(n, 0) AS n_sentences
FROM t LEFT JOIN m ON t.r = m.r
"""


SQL = _sql()
