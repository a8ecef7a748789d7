from vicinal.llm import licenses as L

DOCS = "doc_id bigint, text string"


def test_every_known_sentence_has_an_anchor_and_rules_use_known_ones():
    assert all(any(a in s.lower() for a in L.ANCHORS) for s in L.SENTENCES.values())
    assert {i for _, r in L.RULES for i in r} <= set(L.SENTENCES)


def text(ids, sep=".\n"):
    return sep.join(L.SENTENCES[i] for i in ids) + "."


def test_sequences_wrapping_and_edges(spark):
    mit = text((10, 11)).replace(" ", "\n", 12)
    bsd3, bsd2 = text((12, 13, 14, 15), ". "), text((12, 13, 14))
    rows = [
        (1, f"Prose here\nLICENSED under the apache license, version 2.0!\nmore | prose\nAll rights reserved."),
        (2, "header: " + mit + "\ntail"),
        (3, bsd3), (4, bsd2), (5, text((14, 13, 12))), (6, text((16, 17, 19), "; ")), (7, None), (8, ""), (9, "Licensed under nothing."),
        (10, "x " * 60000 + "\n" + L.SENTENCES[2] + ".\n" + "y " * 60000), (10, L.SENTENCES[2]), (None, text((5, 3))),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], DOCS + ", licenses int")
    got = {r.doc_id: (r.licenses, r.n_licenses) for r in L.scan(df).collect()}
    assert got[1] == got[None] == ("Apache-2.0,all-rights-reserved", 2)
    assert [got[i][0] for i in range(2, 11)] == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "", "GPL-3.0-or-later", "", "", "", "CC-BY-NC-4.0"]
    assert L.scan(df).count() == len(rows) and L.scan(df.limit(0)).count() == 0
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(L.scan_sql()).fetchall()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.licenses, r.n_licenses)) for r in L.scan(df).collect())


def found(spark, texts):
    rows = L.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    return [r.licenses for r in sorted(rows, key=lambda r: r.doc_id)]


def test_every_sentence_and_every_rule_is_found(spark):
    ids = {str(k): k for k in L.SENTENCES}
    df = spark.createDataFrame([(k, f"prose here.\n{s}.\nmore") for k, s in L.SENTENCES.items()], DOCS)
    got = {r.doc_id: (r.a, r.b) for r in df.select("doc_id", L._sequence(df.text, L.BY_LINE).alias("a"), L._sequence(df.text, L.WRAPPED).alias("b")).collect()}
    assert got == {k: (f",{13 if k == 32 else k},",) * 2 for k in ids.values()}
    assert all(n in g for (n, _), g in zip(L.RULES, found(spark, [text(r) for _, r in L.RULES]), strict=True))
    mpl = L.SENTENCES[29].replace("Public License", "Public\n * License")
    texts = ["// SPDX-License-Identifier: MIT\nint x;", "# SPDX-License-Identifier: Apache-2.0\n", f"/* {mpl}. If a copy\n * was not given", "SPDX-License-Identifier: Released under the MIT License."]
    assert found(spark, texts) == ["MIT", "Apache-2.0", "MPL-2.0", "MIT"]


def test_whole_licence_files(spark):
    import textwrap

    wrap = lambda *ids: "\n\n".join(textwrap.fill(L.SENTENCES[i] + ".", 70) for i in ids)
    head = "Copyright (c) 2020 Some Body"
    texts = [
        f"MIT License\n\n{head}\n\n{wrap(10, 11)}\n\nTHE SOFTWARE IS PROVIDED AS IS",
        f"{head}\n\n{wrap(12, 13, 14, 15)}\n", f"BSD 2-Clause License\r\n\r\n{head}\r\n\r\n{wrap(12, 32, 14)}".replace("\r\n", "\n").replace("\n", "\r\n"),
        f"{head}\n{wrap(20)}", "/*\n * " + f"{head}\n\n{wrap(10, 11)}".replace("\n", "\n * ") + "\n */",
        "About this\n\n" + textwrap.fill(L.SENTENCES[21], 40) + "\n\nNext part", f"{head}.\n" + wrap(10, 11).replace("\n", "\n\n"),
    ]
    assert found(spark, texts) == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MIT", "CC-BY-4.0", "MIT"]


def test_wrapped_and_double_spaced_notices_equal_sql(spark):
    import duckdb

    texts = ["Mine. All rights\nreserved.", "All  rights  reserved.", f"{L.SENTENCES[25]}.".replace("public ", "public\n"), f"{L.SENTENCES[26]}.".replace(" ", "  ")]
    assert found(spark, texts) == ["all-rights-reserved", "all-rights-reserved", "CC0-1.0", "Unlicense"]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert [r[1] for r in sorted(con.execute(L.scan_sql()).fetchall())] == found(spark, texts)


def test_a_shorter_notice_beside_a_longer_one(spark):
    """A BSD-2 notice of its own counts beside a BSD-3 notice, before or behind it, but the one within that doesn't."""
    two = ". ".join(L.SENTENCES[k] for k in (12, 13, 14)) + ".\n"
    three = ". ".join(L.SENTENCES[k] for k in (12, 13, 14, 15)) + ".\n"
    texts = [two, three, two + three, three + two, three + three, three + "Other words. " + two]
    got = {r.doc_id: r.licenses for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    both = "BSD-2-Clause,BSD-3-Clause"
    assert [got[i] for i in range(6)] == ["BSD-2-Clause", "BSD-3-Clause", both, both, "BSD-3-Clause", both]


def spoken(spark, texts):
    """found(), which must equal the SQL too."""
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    got = found(spark, texts)
    assert [r[1] for r in sorted(con.execute(L.scan_sql()).fetchall())] == got
    return got


def test_notices_as_they_are_written(spark):
    gpl3 = (
        "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n"
        "    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\n    This program is distributed in the hope that it will be useful,"
    )
    lgpl = (
        " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n"
        " * version 2.1 of the License, or (at your option) any later version.\n"
    )
    kernel = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.\n"
    bsd = f"{L.SENTENCES[12]}:\n\n   * {L.SENTENCES[13]}.\n   * {L.SENTENCES[14]}.\n   * Neither the name of %s nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"
    zlib = f"{L.SENTENCES[76]}. In no event will the authors be held liable.\n\n{L.SENTENCES[48]}:\n\n1. The origin must not be misrepresented; {L.SENTENCES[49]}.\n2. {L.SENTENCES[50]}.\n"
    texts = [gpl3, lgpl, kernel, bsd % "Google Inc.", bsd % "the University of Somewhere", zlib, gpl3.replace("General", "Affero General")]
    assert spoken(spark, texts) == ["GPL-3.0-or-later", "LGPL-2.1-or-later", "GPL-2.0-only", "BSD-3-Clause", "BSD-3-Clause", "Zlib", "AGPL-3.0-or-later"]


def test_named_licences_and_spdx_lines(spark):
    texts = [
        "This project is licensed under the MIT license.", "Distributed under the terms of the GNU General Public License v3.0.", "All source code is released under the BSD 3-Clause License!",
        "The data set is made available under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "Licensed under Apache 2.0.",
        "This project is not licensed under the MIT license.", "It was licensed under pressure.", "licensed under the apache",
    ]
    assert spoken(spark, texts) == ["MIT", "GPL-3.0-only", "BSD-3-Clause", "CC-BY-NC-SA-3.0", "Apache-2.0", "", "", "Apache-2.0"]
    lines = {"GPL-2.0+": "GPL-2.0-or-later", "GPL-2.0": "GPL-2.0-only", "LGPL-2.1+": "LGPL-2.1-or-later", "CC-BY-SA-2.5": "CC-BY-SA-2.5", "BSL-1.0": "BSL-1.0", "0BSD": "0BSD", "Nothing-1.0": ""}
    assert found(spark, [f"// SPDX-License-Identifier: {k}\nint x;" for k in lines]) == list(lines.values())


def test_spdx_expressions(spark):
    lines = {
        "MIT OR Apache-2.0": "Apache-2.0,MIT",
        "(MIT AND BSD-3-Clause) OR GPL-2.0-or-later WITH Classpath-exception-2.0": "BSD-3-Clause,GPL-2.0-or-later,MIT",
        "GPL-2.0+ OR Nothing-1.0 OR ISC OR Zlib OR 0BSD OR CC0-1.0": "0BSD,CC0-1.0,GPL-2.0-or-later,ISC,Zlib",
        "Apache-2.0 WITH LLVM-exception": "Apache-2.0",
        "MIT\nint either OR Apache-2.0;": "MIT",
    }
    assert found(spark, [f"/* SPDX-License-Identifier: {k} */\nint x;" for k in lines]) == list(lines.values())
    assert found(spark, ["no tag here: MIT OR Apache-2.0 licence"]) == [""]


def test_a_licence_around_another_counts_alone_and_identifiers_do_not_run_together(spark):
    texts = [text((10, 11, 61)), text((10, 11)), text((56, 61)), text((12, 13, 14, 57, 15)), text((12, 13, 14, 57, 15, 12, 13, 14)), text((12, 13, 14, 15)) + "\n" + text((12, 13, 14, 15))]
    assert spoken(spark, texts) == ["X11", "MIT", "curl", "BSD-4-Clause", "BSD-2-Clause,BSD-4-Clause", "BSD-3-Clause"]
    known = L.built_in().known
    assert len({tuple(L.normalised(s).split()) for s in L.SENTENCES.values()}) == len(L.SENTENCES) and all(L.normalised(k) == k for k in known)
    assert all(any(a in w.lower() for a in L.ANCHORS) for all_of in L.WORDINGS.values() for w in all_of)


def test_tables_from_whole_texts(spark):
    own = "Our Own Licence, first issue\n\nYou may read this licence aloud. You may not\nsing it: singing needs our leave.\n\n1. Reading at night is free of charge; at day it is not.\n"
    other = "You may read this licence aloud. Reading at night is free of charge; reading by day costs one penny.\n"
    texts = {"Own": own, "Penny": other}
    docs = ["Preface.\n\n" + own, own.replace("aloud. You may not\nsing", "aloud.\nYou\nmay not sing"), "# " + own.replace("\n", "\n# "), other, own.replace("night", "noon"), own + other, text((10, 11)) + "\n" + other, "", None]
    rows = L.scan(spark.createDataFrame(list(enumerate(docs)), DOCS), texts).collect()
    assert [r.licenses for r in sorted(rows, key=lambda r: r.doc_id)] == ["Own", "Own", "Own", "Penny", "", "Own,Penny", "MIT,Penny", "", ""]
    for bad in ("", "Two words. Licence."):
        try:
            L.from_texts({"x": bad})
            raise AssertionError(bad)
        except ValueError:
            pass


def test_whole_texts_of_the_system(spark):
    """Each licence text that the system keeps is found in itself, and in no other one but where that holds it whole."""
    from pathlib import Path

    import pytest

    files = sorted(f for f in Path("/usr/share/common-licenses").glob("*") if f.is_file() and not f.is_symlink())
    if not files:
        pytest.skip("no licence texts on this system")
    texts = {f.name: f.read_text("utf-8", "replace") for f in files}
    rows = L.scan(spark.createDataFrame([(i, "# Title\n\n" + t + "\nend") for i, t in enumerate(texts.values())], DOCS), texts).collect()
    for r in rows:
        assert [n for n in r.licenses.split(",") if n in texts] == [list(texts)[r.doc_id]]
