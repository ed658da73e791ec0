"""WARC archives, license scans, registered queries, the pipeline."""
import io
import re
import uuid
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from terrapanel.llm import boosted_quality, decontamination, license_sentences, ngram_jaccard, queries, suffix_dedup, warc_revisits
from terrapanel.session import checkpoint_dir
from test_modelling import check_pieces
from tests_paths import SF


def duck(sf=SF):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    want = duck().execute(queries.SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(rows.columns)
    assert Counter(map(tuple, rows.select(*cols).collect())) == Counter(want.fetchall())


# ------------------------------------------------------------------ WARC

def test_archives_give_back_every_page(spark):
    long, odd = "<p>" + "x" * 1500, "y" * 1200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/b c\r\nX: y", long), (5, None, long), (3, "http://c", long), (5, None, long), (None, "http://d", long),
            (7, "http://e", odd), (8, "http://f", odd), (9, "http://g", None), (10, "http://h", ""), (11, "http://i", "small"),
            (12, "http://j", "small"), (13, "http://k", "é" * 600), (14, "http://l", "z" * 200_000), (None, None, "q" * 1100), (None, None, "q" * 1100)]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, latest int, key string").repartition(3)
    path = f"{checkpoint_dir(spark)}/warc-test/{uuid.uuid4().hex}"
    warc_revisits.write_archives(pages, path)
    got = warc_revisits.read_archives(spark, path).collect()
    want = Counter()
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        revisit = len(payload) >= 1000 and same and page != max(same)
        want[page, len(payload), "revisit" if revisit else "response", max(same) if revisit else None, None if revisit else payload] += 1
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want


def test_archives_of_no_pages_and_broken_records(spark):
    path = f"{checkpoint_dir(spark)}/warc-test/{uuid.uuid4().hex}"
    warc_revisits.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_revisits.read_archives(spark, path).collect() == []
    with pytest.raises(ValueError):
        list(warc_revisits.read_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")))
    with pytest.raises(ValueError):
        list(warc_revisits.read_records(io.BytesIO(b"garbage\r\n")))


# -------------------------------------------------------------- licenses

MIT = """Copyright (c) 2020 A Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_licenses_by_sentence_rules(spark, docs):
    texts = {1: MIT, 2: "Prose without an end\nLicensed under CC BY-NC 4.0.\nMore prose.", 3: "Released under the MIT License. And prose.",
             4: "# SPDX-License-Identifier: Apache-2.0", 5: None, 6: "", 7: "The MIT licence was mentioned here.", 8: "...!?\n\n.",
             9: MIT.split("IN NO EVENT")[0], 10: "Released under the MIT License.\n\nLicensed under the Apache License, Version 2.0."}
    got = {r.doc_id: r for r in license_sentences.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {k: got[k].licenses for k in texts} == {1: "MIT", 2: "CC-BY-NC-4.0", 3: "MIT", 4: "Apache-2.0", 5: "", 6: "", 7: "", 8: "", 9: "",
                                                   10: "Apache-2.0,MIT"}
    assert got[5].n_sentences == got[6].n_sentences == got[8].n_sentences == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = docs.select("doc_id", "text").collect()
    con.executemany("INSERT INTO documents VALUES (?, ?)", [tuple(r) for r in rows] + list(texts.items()))
    want = con.execute(license_sentences.SQL).fetchall()
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    mine = license_sentences.scan(both).select("doc_id", "licenses", "sentence_ids", "n_sentences").collect()
    assert Counter(map(tuple, mine)) == Counter(want)


APACHE = """Copyright 2020 X

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GNU = """Copyright (C) 2020 X
This file is part of Y.

Y is free software%s you can redistribute it and/or modify
it under the terms of the GNU %sGeneral Public License as published by
the Free Software Foundation, either version %s of the License, or
(at your option) any later version.

Y is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
ISC = """Copyright (c) 2020 X
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""


def commented(text, first, each, last):
    return "\n".join([*([first] if first else []), *((each + x).rstrip() for x in text.split("\n")), *([last] if last else []), "int x = 1;"])


def test_licenses_in_comments(spark):
    headers = {"Apache-2.0": APACHE, "MIT": MIT.replace("A Name\n\n", "A Name\n"), "ISC": ISC, "MPL-2.0": MPL, "Unlicense": UNLICENSE,
               "GPL-2.0-or-later": GNU % (";", "", "2"), "GPL-3.0-or-later": GNU % (":", "", "3"),
               "LGPL-2.1-or-later": GNU % (";", "Lesser ", "2.1"), "LGPL-3.0-or-later": GNU % (":", "Lesser ", "3"),
               "AGPL-3.0-or-later": GNU % (":", "Affero ", "3")}
    styles = [("", "", ""), ("/*", " * ", " */"), ("", "# ", ""), ("", "// ", ""), ("<!--", "  ", "-->"), ("", ";; ", ""), ("", "-- ", "")]
    rows = [(name, commented(text, *style)) for name, text in headers.items() for style in styles]
    rows += [("GPL-3.0-or-later", "// SPDX-License-Identifier: GPL-3.0-or-later\n// Copyright X\nint x;"),
             ("LGPL-2.1-or-later", "/* SPDX-License-Identifier: LGPL-2.1-or-later */"), ("", "# SPDX-License-Identifier: MIT-0"),
             ("GPL-2.0-or-later", "Foo is nice and released under the GNU General Public License, version 2 or later"),
             ("", "This is not licensed under the MIT License."), ("", "We were licensed under the MIT licenses.")]
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_sentences.scan(df).collect()}
    assert [(rows[i], got[i]) for i in range(len(rows)) if got[i] != rows[i][0]] == []


def test_every_known_sentence_has_an_anchor():
    assert all(re.search(license_sentences._ANCHORS, x) for x in license_sentences.all_sentences() if not x.startswith("spdx "))


def test_license_scan_has_no_python(spark):
    plan = license_sentences.op5_license_sentences(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert license_sentences.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# -------------------------------------------------------------- pipeline

def test_stages_one_by_one(spark, docs, labels, tmp_path_factory):
    """Each stage against the plain versions that the operators' tests use."""
    from test_dedup import plain_repeats

    path = f"{checkpoint_dir(spark)}/pipeline-test/{uuid.uuid4().hex}"
    items = docs.where("doc_id in (4, 10)").selectExpr("doc_id as item_id", "substring_index(text, ' ', 30) as text")
    labels.write.parquet(f"{path}/labels.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()]
        out = stage(spark, now, path)
        if name == "pack":
            check_pieces(now.select("doc_id", "text").collect(), out.collect())
            break
        assert out.columns == corpus_pipeline.COLUMNS
        after = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
        if name == "quality":
            bad = {(r.doc_id, r.text) for r in boosted_quality.score(now, labels, carry=("text",)).where("predicted = 0").collect()}
            assert Counter(after) == Counter(r for r in before if r not in bad)
        elif name == "near_duplicates":
            groups = ngram_jaccard.jaccard_components(now.select("doc_id", "text"))
            empty = groups.where("n_shingles = 0").count()
            assert len(after) == empty + groups.where("n_shingles > 0 and component_id is not null").select("component_id").distinct().count()
        elif name == "repeats":
            texts = [(t or "").encode() for _, t in before]
            left = Counter((d, bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore"))
                           for (d, _), t, gone in zip(before, texts, plain_repeats(texts, suffix_dedup.LENGTH), strict=True))
            assert Counter(after) == left
        else:
            bad = {r.doc_id for r in decontamination.leaks(now, items).collect()}
            assert Counter(after) == Counter(r for r in before if r[0] not in bad)
        now = out


def test_run_on_the_tables(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert pieces.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "decontaminate", "pack"]


def test_eleven_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
