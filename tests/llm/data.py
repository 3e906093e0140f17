"""Rows with the awkward cases that every operator has to stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# The same with columns named like those that operators make.
CLASHING = SCHEMA + ", row long, kept boolean, digest string, fp long, name string, score double"


def words(n, seed, stems=("ba", "ko", "ti", "re", "mu", "sa", "ne", "lo")):
    pick = random.Random(seed)
    return " ".join("".join(pick.choices(stems, k=pick.randint(1, 4))) for _ in range(n))


def awkward():
    """(doc_id, text) with nulls, empty and long texts, ties and repeated rows."""
    long = words(30_000, 1)
    shared = words(70, 2)
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"),
        (6, "It's  one's\n\n'll  '' 12a3 é中\U0001f600 "),
        (7, words(200, 3)), (8, words(200, 3)), (9, words(200, 3).replace(" ", "\n")),
        (10, words(200, 3) + "  "), (11, long), (12, long + " end"),
        (13, words(60, 4) + " " + shared + " " + words(60, 5)),
        (14, words(50, 6) + " " + shared + " " + words(50, 7)),
        (15, shared), (16, "same line that is long enough to count as a key here\nrest"),
        (None, "text without an id"), (4, "one"), (17, "x" * 5000), (18, "İß́ \x1c\x85\xa0"),
        (19, None), (20, "a\x00b\x00\x00"),
    ]
    rows += [(100 + i, "Same line that is long enough to count as a key HERE \nown " + str(i)) for i in range(6)]
    return rows


def table(spark, rows=None, clashing=False):
    rows = awkward() if rows is None else rows
    if clashing:
        return spark.createDataFrame(
            [(i, t, "en", "s", 0, 7, False, "d", 3, "n", 0.5) for i, t in rows], CLASHING
        )
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def plain(df, *order):
    """All rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
