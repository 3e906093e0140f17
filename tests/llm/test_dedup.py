"""Exact, line and substring dedup against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest

from labelspark.llm import exact_dedup, line_dedup, substring_dedup
from tests.llm.data import awkward, plain, table, words


def body(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_exact_dedup_equals_grouping(spark, block):
    rows = awkward() + [(200 + i, "copy " * 50 + " " * i) for i in range(40)]
    got = exact_dedup.exact_dedup(table(spark, rows), block).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[body(t)].append((-len(t or ""), i is None, i, t))
    want = []
    for key, members in groups.items():
        best = min(members, key=lambda m: m[:2] + (m[2] or 0,))
        sha = hashlib.sha256(key.encode()).hexdigest()
        want += [(m[2], best[2], len(members), sha) for m in members]
    assert sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr
    ) == sorted(want, key=repr)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_nothing_and_of_clashing_columns(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    a = exact_dedup.exact_dedup(table(spark)).drop("row", "keep_row")
    b = exact_dedup.exact_dedup(table(spark, clashing=True)).drop("row", "keep_row")
    assert plain(a) == plain(b)


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.exact_dedup(table(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def by_lines(rows, min_chars=40, min_documents=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(
        {c: c + 32 for c in range(65, 91)}
    )
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    stays = {
        k: max(x for x in ids if x is not None) for k, ids in held.items()
        if len(ids) >= min_documents
    }
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in stays or stays[key(x)] == i]
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((i, len(lines), len(lines) - len(kept), sha))
    return sorted(out, key=repr)


def test_line_dedup_equals_plain_python(spark):
    assert plain(line_dedup.digests(table(spark))) == by_lines(awkward())
    assert plain(line_dedup.digests(table(spark), 3, 2)) == by_lines(awkward(), 3, 2)
    assert plain(line_dedup.digests(table(spark, clashing=True))) == by_lines(awkward())
    assert line_dedup.digests(table(spark, [])).count() == 0


def test_line_dedup_gives_text_and_positions(spark):
    got = {r.doc_id: r for r in line_dedup.line_dedup(table(spark)).collect()}
    assert got[100].kept_text == "own 0" and got[100].dropped == [0]
    assert got[105].n_dropped == 0 and got[105].kept_text.startswith("Same line")
    assert got[1].kept_text == "" and got[1].n_lines == 1


def test_shared_passage_stays_once(spark):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark)).collect()}
    passage = words(70, 2)
    assert passage in got[13].text and got[13].spans == []
    assert passage not in got[14].text and got[14].keep_ids == [13]
    assert words(50, 6).split()[0] in got[14].text and got[14].text.endswith(words(50, 7)[-40:])
    assert len(got[15].text.split()) <= 2 * (substring_dedup.WINDOW + substring_dedup.GRAM - 2)
    assert got[1].text is None and got[2].text == ""
    assert got[8].keep_ids == [7] and got[8].text.strip() == ""
    raw = {i: t for i, t in awkward()}[14].encode()
    for span in got[14].spans:
        assert raw[span.start : span.end].decode() in passage


def test_every_shared_passage_of_fifty_words_is_cut(spark):
    rows, passages = [], []
    for k in range(60):
        p = words(51, 1000 + k)
        passages.append(p)
        for c in range(3):
            n = 3 * k + c
            rows.append((n, f"{words(20 + k, 5000 + n)} {p.upper() if c == 1 else p} {words(30, 9000 + n)}"))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    for k, p in enumerate(passages):
        assert got[3 * k].spans == [] and got[3 * k].text == rows[3 * k][1]
        for c in (1, 2):
            own = got[3 * k + c]
            # Where anchors at the ends differ, a unit's first holder may be the second copy.
            assert 3 * k in own.keep_ids and set(own.keep_ids) <= {3 * k, 3 * k + 1}
            assert p not in own.text.lower() and own.n_removed_chars > 0.3 * len(p)


def test_own_repeats_go_and_clean_documents_stay(spark):
    twice = words(300, 11)
    rows = [(1, words(400, 12)), (2, twice + "\n" + twice), (3, "one two three " * 100)]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].spans == []
    assert got[2].text == twice + "\n" and got[2].keep_ids == [2]
    # A periodic text keeps its first period.
    assert got[3].text.split() == ["one", "two", "three"]


def test_cleaned_keeps_all_columns_and_rows(spark):
    docs = table(spark, clashing=True)
    done = substring_dedup.cleaned(docs)
    assert done.columns == [*docs.columns, "_spans", "_removed"]
    assert done.count() == docs.count()
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def test_clashing_names_are_kept_or_refused(spark):
    docs = table(spark, [(1, words(60, 1)), (2, words(60, 1))]).selectExpr("*", "7 AS _spans", "8 AS `Row`")
    with pytest.raises(ValueError, match="_spans"):
        substring_dedup.cleaned(docs)
    done = substring_dedup.cleaned(docs, spans="cuts", removed="lost")
    assert done.columns == [*docs.columns, "cuts", "lost"]
    assert [(r._spans, r.Row, r.text) for r in done.orderBy("doc_id").collect()] == [
        (7, 8, words(60, 1)), (7, 8, "")
    ]


def test_units_are_found_in_plain_python(spark):
    """Digests are equal exactly where the words are; lines and paragraphs are among the units."""
    texts = [(i or "").split() for _, i in awkward()]
    docs = spark.createDataFrame(
        [(n, i, t) for n, (i, t) in enumerate(awkward())], "row long, doc_id long, text string"
    )
    seen, found = {}, set()
    for r in substring_dedup.units(docs).collect():
        unit = tuple(w.lower() for w in texts[r.row][r.start : r.start + r.size])
        assert len(unit) == r.size >= substring_dedup.UNIT_WORDS
        assert seen.setdefault((r.d1, r.d2), unit) == unit
        found.add((r.row, r.start, r.size))
    assert len(set(seen.values())) == len(seen) > 50
    for n, (_, text) in enumerate(awkward()):
        at, paragraph = 0, []
        for line in [*(text or "").split("\n"), ""]:
            size = len(line.split())
            if size >= substring_dedup.UNIT_WORDS:
                assert (n, at, size) in found
            if not size and paragraph:
                if sum(paragraph) >= substring_dedup.UNIT_WORDS:
                    assert (n, at - sum(paragraph), sum(paragraph)) in found
                paragraph = []
            elif size:
                paragraph.append(size)
            at += size
