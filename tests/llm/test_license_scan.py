import pandas as pd

from mnemos.llm import license_scan as x
from tests.llm.util import spark_rows, sql_rows


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    found = spark_rows(x.op5_license_scan(spark, sf))
    assert found == sql_rows(x.OP5_SQL, sf) and any(r[2] for r in found)


def test_entire_texts_in_other_spelling(spark):
    mit = dict(x.TEXTS)["MIT"]
    other = mit.upper().replace("LICENSE", "LICENCE").replace("SUBLICENSE", "sub-licence").replace('"', "“").replace("NONINFRINGEMENT", "non-infringement").replace("<YEAR> <HOLDER>", "2020 A. Nother. All rights reserved")
    rows = [(1, mit), (1, mit), (2, other), (3, mit + " More."), (4, None), (5, ""), (None, "x\nreleased under the  MIT licence\nReleased under the MIT License."), (6, dict(x.TEXTS)["0BSD"]), (7, "word " * 100_000)]
    df = spark.createDataFrame([(k, t, "y") for k, t in rows], "doc_id long, text string, license_id string")
    found = x.scan(df).collect()
    got = sorted(((repr(r.doc_id), r.license_id, r.line_licenses, r.n_license_lines) for r in found), key=lambda r: r[0])
    want = [("1", "MIT", "", 0)] * 2 + [("2", "MIT", "", 0), ("3", None, "", 0), ("4", None, "", 0), ("5", None, "", 0), ("None", None, "MIT", 2), ("6", "0BSD", "", 0), ("7", None, "", 0)]
    assert got == sorted(want, key=lambda r: r[0])
    assert x.scan(df.limit(0)).count() == 0 and x.scan(df, texts=(), statements=()).where("license_id is not null or n_license_lines > 0").count() == 0
    docs = pd.DataFrame([r for r in rows if r[0] and r[0] > 1], columns=["doc_id", "text"])
    assert spark_rows(x.scan(df.where("doc_id > 1"))) == sql_rows(x.OP5_SQL, documents=docs)


def test_no_python_in_the_plan(spark):
    plan = x.op5_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_known_licences_are_not_only_those_of_the_test_tables(spark, tmp_path):
    from mnemos.llm import notices

    known = dict(notices.texts())
    lines = {
        "Apache-2.0": '# Licensed under the Apache License, Version 2.0 (the "License");', "GPL-2.0-only": "Released under the GPL version 2", "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "AGPL-3.0-or-later": "SPDX-License-Identifier: AGPL-3.0-or-later", "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public", "GPL-3.0-or-later": "Licensed under GPLv3 or later",
    }
    rows = [(i, t) for i, t in enumerate([*known.values(), *["some words\n" + x + "\nmore" for x in lines.values()], "licensed under nothing that is known"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r.license_id, r.line_licenses) for r in x.op5_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert [a for a, _ in found] == [*known, *[None] * (len(lines) + 1)] and {"Apache-2.0", "GPL-2.0-only", "LGPL-2.1-only", "MPL-2.0"} <= set(known)
    assert [b for _, b in found[len(known) :]] == [*lines, ""]
