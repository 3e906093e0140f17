"""Whole licence texts as files give them."""

import pytest

from labelspark.llm import license_scan
from tests.llm.data import table

BODY = {i: t for i, t in license_scan.SHORT if len(t) > 500}
WHOLE = {p.stem: p.read_text("utf-8") for p in license_scan.TEXTS.glob("*.txt")}
HOLDER = "Copyright (c) 2021 Some One\n\n"


@pytest.fixture(scope="module")
def known(spark):
    rows = license_scan.known_digests(spark).collect()
    return spark.createDataFrame(rows, "digest string, license_id string")


def test_usual_files(spark, known):
    cases = [(n, t) for n, t in WHOLE.items()]
    cases += [
        ("MIT", "MIT License\n\n" + HOLDER + BODY["MIT"]),
        ("MIT", "The MIT License (MIT)\n\n" + HOLDER + BODY["MIT"] + "\n"),
        ("ISC", "ISC License\n\n" + HOLDER + BODY["ISC"]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + WHOLE["BSD-3-Clause"]),
        ("BSD-2-Clause", HOLDER + WHOLE["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")),
        ("Apache-2.0", WHOLE["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 X")),
        ("GPL-3.0", WHOLE["GPL-3.0"].split("END OF TERMS")[0].replace("https:", "http:")),
        ("Unlicense", WHOLE["Unlicense"].replace("\n", " ")),
    ]
    docs = table(spark, [(i, t) for i, (_, t) in enumerate(cases)])
    got = license_scan.license_scan(docs, known).filter("unit = 0").collect()
    assert {r.doc_id: r.license_id for r in got} == {i: n for i, (n, _) in enumerate(cases)}
    assert len(WHOLE) == 10


def test_a_line_more_is_another_text(spark, known):
    docs = table(spark, [(1, "MIT License\n\n" + BODY["MIT"] + "\nBut not on Sundays.")])
    assert license_scan.license_scan(docs, known).filter("unit = 0").first().license_id is None


def test_further_texts(spark):
    own = license_scan.known_digests(spark, (("LicenseRef-Own", "Do as you like."),))
    got = license_scan.license_scan(table(spark, [(1, "Do as you like!")]), own)
    assert got.filter("unit = 0").first().license_id == "LicenseRef-Own"
