"""Prefix hashes and the pairing with the next document."""

import hashlib
import random

import pytest

from labelspark.llm import fingerprints as fp
from tests.llm.data import awkward, plain, table, words


def test_extensions_and_spans_equal_plain_comparison():
    pick = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(pick.choices("ab", k=pick.randint(0, 30))) for _ in range(2))
        i, j = pick.randint(0, len(a)), pick.randint(0, len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        x, y = fp.Prefixes.of(a), fp.Prefixes.of(b)
        assert fp.common_extension(x, i, y, j) == n
        size = pick.randint(0, 8)
        same = i + size <= len(a) and j + size <= len(b) and a[i:][:size] == b[j:][:size]
        assert fp.equal_spans(x, i, y, j, size) == same


def test_zeros_count():
    marks = {fp.fingerprint(fp.Prefixes.of(t)) for t in ("", "\0", "\0\0", "a", "a\0", "\0a")}
    assert len(marks) == 6


def test_likeness():
    mark = lambda t: fp.fingerprint(fp.Prefixes.of(t))
    a, b = words(300, 1), words(300, 2, ("xi", "pu", "ge", "dra", "wo"))
    assert fp.likeness(mark(a), mark(a)) == 1 == fp.likeness(mark(""), mark(""))
    assert fp.likeness(mark(a), mark("")) == 0
    assert fp.likeness(mark(a), mark(b)) < 0.1 < 0.3 < fp.likeness(mark(a), mark(fp.edited(a, b)))
    assert fp.likeness(mark(a), mark("new start " + a)) > 0.7
    assert fp.likeness(mark(a), mark(b)) == fp.likeness(mark(b), mark(a))


@pytest.mark.parametrize("clashing", [False, True])
def test_rows_equal_plain_python(spark, clashing):
    rows = awkward()
    got = fp.document_fingerprints(table(spark, rows, clashing)).collect()
    assert len(got) == len(rows)
    # Rows of one id may come in either order; here they are equal.
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + u[:half]
        n = 0
        while n < min(len(t), len(changed)) and t[n] == changed[n]:
            n += 1
        marks = [fp.fingerprint(fp.Prefixes.of(x)) for x in (t, changed, u)]
        want.append((
            i, len(t), hashlib.sha256(changed.encode()).hexdigest(), marks[0], marks[1],
            fp.likeness(marks[0], marks[1]), fp.likeness(marks[0], marks[2]), n,
        ))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_one_row_and_none(spark):
    row = fp.document_fingerprints(table(spark, [(5, "abcd")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1
    assert fp.document_fingerprints(table(spark, [])).count() == 0


def test_text_is_shuffled_once(spark, monkeypatch):
    plans = []
    real = fp.materialize
    monkeypatch.setattr(
        fp, "materialize",
        lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1],
    )
    fp.document_fingerprints(table(spark))
    assert plans[0].count("Exchange") == 1


def test_many_ranges(spark):
    rows = [(i, words(i % 7, i)) for i in range(500)]
    got = plain(fp.document_fingerprints(table(spark, rows).repartition(7)))
    assert [r[0] for r in sorted(got)] == list(range(500))
