"""Canonical forms and look-ups."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from labelspark.llm import license_scan
from tests.llm.data import awkward, table

MIT = next(t for i, t in license_scan.KNOWN if i == "MIT" and t.startswith("Permission"))


@pytest.mark.parametrize(
    "text",
    [
        MIT, MIT.upper(), MIT.replace(" ", "\n\t"), MIT.replace('"', ""),
        "Copyright (c) 2020 Someone\n" + MIT, "  © 1999-2001 X, Y\nAll rights reserved.\n\n" + MIT,
        MIT.replace("NONINFRINGEMENT", "NON-INFRINGEMENT"),
        MIT.replace("sublicense", "sublicence"),
    ],
)
def test_spellings_of_one_licence(spark, text):
    docs = table(spark, [(1, text)])
    got = license_scan.license_scan(docs, license_scan.known_digests(spark)).filter("unit = 0")
    assert got.first().license_id == "MIT"


def test_other_texts_are_none(spark):
    for text in (MIT[:-30], MIT + " More.", "", None, "Copyright 2020", "MIT"):
        docs = table(spark, [(1, text)])
        got = license_scan.license_scan(docs, license_scan.known_digests(spark)).collect()
        assert [(r.unit, r.license_id) for r in got] == [(0, None)]


def test_lines_and_awkward_rows(spark):
    rows = awkward() + [(500, "text\nlicensed under the  APACHE licence, version 2.0\nmore")]
    for clashing in (False, True):
        got = license_scan.license_scan(
            table(spark, rows, clashing), license_scan.known_digests(spark)
        )
        assert [(r.doc_id, r.unit) for r in got.filter("license_id IS NOT NULL").collect()] == [(500, 2)]
        assert got.filter("unit = 0").count() == len(rows)
    empty = license_scan.license_scan(table(spark, []), license_scan.known_digests(spark))
    assert empty.count() == 0


def test_plan_shuffles_no_text_and_runs_no_python(spark):
    found = license_scan.license_scan(table(spark), license_scan.known_digests(spark))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("SortMergeJoin|Python|Arrow", plan)


def test_canonical_form(spark):
    one = spark.range(1).select(license_scan.canonical(F.lit("The Licence,\n(v. 2.0)")).alias("c"))
    assert one.first().c == " the license version 2 0 "
    digests = {r.digest for r in license_scan.known_digests(spark).collect()}
    assert hashlib.sha256(b" released under the mit license ").hexdigest() in digests
