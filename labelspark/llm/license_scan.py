"""License scan by canonical digests; DataFrame functions only.

A text is made canonical: lower case, copyright lines gone, equivalent spellings made one,
punctuation and white space turned into single blanks. Its SHA-256 is looked up among the
digests of known licence texts. Whole documents are looked up, and every line by itself, since
a notice often is one line of a longer text. The known texts are a few rows inside the plan, so
their side of the hash join is broadcast by its size and no text is shuffled.

Defined cases: null text is empty; a text that is empty once canonical has no licence; repeated
rows each give rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and short licence texts by SPDX identifier.
SHORT = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
                "one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
            "this software and associated documentation files (the \"Software\"), to deal in "
            "the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this "
            "permission notice shall be included in all copies or substantial portions of the "
            "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
            "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
            "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
            "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
            "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
            "SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted, provided that the above copyright notice "
            "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
            "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
            "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
            "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
            "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
            "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)

# Titles that stand above a licence's text, which does not hold them itself.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License",
                     "The 2-Clause BSD License", "Simplified BSD License",
                     'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License",
                     "The 3-Clause BSD License", "New BSD License",
                     'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
# Whole licence texts, one file for each identifier.
TEXTS = Path(__file__).parent / "licenses"
ENDING = re.compile("END OF TERMS AND CONDITIONS")


def _wordings(name: str, text: str) -> list[str]:
    """Forms in which the whole text of a licence is given: with and without a title, the
    appendix on how to apply it and numbers of clauses; lines as they are or joined to
    paragraphs (lines matter for what is taken as a copyright line)."""
    forms = [text]
    end = ENDING.search(text)
    if end:
        forms += [text[: end.end()], text[: end.start()]]
        forms.append(re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", text))
    if name.startswith("BSD"):
        forms.append(re.sub(r"(?m)^[0-9]\. ", "", text))
    forms += [f"{title}\n\n{form}" for title in TITLES.get(name, ()) for form in forms]
    joined = [
        "\n\n".join(" ".join(part.split()) for part in re.split(r"\n[ \t]*\n", form))
        for form in forms
    ]
    return list(dict.fromkeys(forms + joined))


def _known() -> tuple[tuple[str, str], ...]:
    """(identifier, text) of all known texts."""
    rows = list(SHORT)
    for name, text in SHORT:
        if len(text) > 500 and name in TITLES:
            rows += [(name, form) for form in _wordings(name, text)[1:]]
    for path in sorted(TEXTS.glob("*.txt")):
        rows += [(path.stem, form) for form in _wordings(path.stem, path.read_text("utf-8"))]
    return tuple(rows)


KNOWN = _known()

# Spellings that count as one, in canonical form (the second stands for both).
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"),
    ("sublicence", "sublicense"), ("non infringement", "noninfringement"),
    ("analogue", "analog"), ("organisation", "organization"), ("organisations", "organizations"),
    ("favour", "favor"), ("behaviour", "behavior"), ("modelled", "modeled"),
    ("per cent", "percent"), ("https", "http"), ("v 2 0", "version 2 0"), ("v 3", "version 3"),
)

# Lines that only say whose the text is, and signs that do not count. Both work
# on lower-cased text.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|by )|\(c\)|©)[^\n]*"
    r"|(^|\n)[ \t]*all rights reserved\.?[ \t]*(\n|$)"
)
SIGNS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f©‘’“”–—…«»]+"

def canonical(text: Column) -> Column:
    """One spelling for texts that say the same licence; blank at both ends, words between."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(lower, COPYRIGHT_LINE, "\n"), SIGNS, " ")
    plain = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    for other, usual in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {other} "), F.lit(f" {usual} "))
    return plain


def known_digests(spark: SparkSession, known: tuple = KNOWN) -> DataFrame:
    """(digest, license_id) of the known texts; one identifier per digest."""
    texts = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("t")) for i, t in known])
    rows = spark.range(1).select(F.explode(texts).alias("k"))
    return rows.groupBy(F.sha2(canonical(F.col("k.t")), 256).alias("digest")).agg(
        F.min("k.id").alias("license_id")
    )


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, unit, digest, license_id): unit 0 is the whole text and there for every row;
    units from 1 on are lines that are a known text. ``known`` is (digest, license_id), one row
    for each digest: ``known_digests`` of KNOWN or of further texts, or any other table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.concat(F.array(text), F.split(text, "\n", -1))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), units.alias("units")).select(
        "doc_id", F.posexplode("units").alias("unit", "said")
    )
    return (
        found.select("doc_id", "unit", F.sha2(canonical(F.col("said")), 256).alias("digest"))
        .join(known, "digest", "left")
        .filter((F.col("unit") == 0) | F.col("license_id").isNotNull())
        .select("doc_id", "unit", "digest", "license_id")
    )
