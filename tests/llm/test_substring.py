"""Shared passages over many lines, and rows that share an id, by plain search."""

import random

from labelspark.llm import substring_dedup
from tests.llm.data import table, words


def wrapped(text, pick):
    """``text`` in lines of 5 to 19 words."""
    left, lines = text.split(), []
    while left:
        n = pick.randint(5, 19)
        lines.append(" ".join(left[:n]))
        left = left[n:]
    return "\n".join(lines)


def test_passages_over_short_lines_go_whole(spark):
    pick = random.Random(8)
    rows, passages = [], []
    for k in range(60):
        passages.append(words(51, 1000 + k).split())
        for c in range(3):
            n = 3 * k + c
            # Words of their own beside the passage, so that it ends where it ends.
            own = f"{words(20 + k, 5000 + n)} own{n}a {' '.join(passages[-1])} own{n}b {words(30, 9000 + n)}"
            rows.append((n, wrapped(own, pick)))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    for n, text in rows:
        left, passage = got[n].text.split(), passages[n // 3]
        if n % 3 == 0:
            assert got[n].text == text
        else:
            want = text.split()
            at = want.index(f"own{n}a") + 1
            assert left == want[:at] + want[at + len(passage) :]


def test_rows_with_one_id_are_cut_at_their_own_places(spark):
    passage = words(60, 70)
    other = " ".join(f"é中{i}ü" for i in range(200))
    rows = [
        (1, passage), (2, words(30, 71) + "\n" + passage + "\n" + words(30, 72)),
        (2, other), (2, passage + " new " + words(30, 74)), (2, None), (None, words(90, 73)),
        (None, words(90, 73)), (3, words(90, 73)),
    ]
    got = substring_dedup.substring_dedup(table(spark, rows)).collect()
    found = sorted((r.text.strip() for r in got if r.doc_id == 2 and r.text is not None))
    assert found == sorted([words(30, 71) + "\n\n" + words(30, 72), other, "new " + words(30, 74)])
    # Of repeated rows the first keeps the text.
    assert sorted(r.text for r in got if r.doc_id is None) == ["", words(90, 73)]
    assert [r.text for r in got if r.doc_id == 3] == [""]
    assert [r.spans for r in got if r.text == other] == [[]]


def made(seed):
    """Texts of few and many words with repeats among and inside them, lines and periods."""
    pick = random.Random(seed)
    parts = [words(pick.randint(20, 90), 100 * seed + k) for k in range(8)]
    parts += ["la le " * 40, words(7, seed), wrapped(words(80, 7 * seed), pick)]
    rows = []
    for n in range(40):
        text = []
        for _ in range(pick.randint(0, 5)):
            text.append(pick.choice(parts) if pick.random() < 0.6 else words(pick.randint(1, 60), pick.random()))
            text.append(pick.choice(["\n", "\n\n", " ", " \n \n"]))
        rows.append((pick.choice([n, n, 3, None]), "".join(text)))
    return rows


def test_against_plain_search(spark, tmp_path):
    """All repeated lines, paragraphs and passages of 48 words go, and nothing is lost."""
    for seed in (1, 2):
        folder = str(tmp_path / str(seed))
        table(spark, made(seed)).coalesce(1).write.parquet(folder)
        docs = spark.read.parquet(folder)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        done = [r for r in substring_dedup.cleaned(docs).collect()]
        assert [r.doc_id for r in sorted(done, key=lambda r: repr(r.doc_id))] == [
            i for i, _ in sorted(rows, key=lambda r: repr(r[0]))
        ]
        key = lambda n: (rows[n][0] is not None, rows[n][0] or 0, n)
        rank = {n: k for k, n in enumerate(sorted(range(len(rows)), key=key))}
        lowered = [[w.lower() for w in t.split()] for _, t in rows]
        first = {}
        for n in sorted(rank, key=rank.get):
            for size in (20, 48):
                for i in range(len(lowered[n]) - size + 1):
                    first.setdefault(tuple(lowered[n][i : i + size]), (rank[n], i))
            for at, size in units_of(rows[n][1]):
                first.setdefault(("unit", *lowered[n][at : at + size]), (rank[n], at))
        gone_of = removed_words(spark, docs)
        for n, (_, text) in enumerate(rows):
            gone = gone_of[n]
            w = lowered[n]
            for i in range(len(w) - 47):
                if first[tuple(w[i : i + 48])] < (rank[n], i):
                    assert any(gone[i : i + 48])
            for at, size in units_of(text):
                if first[("unit", *w[at : at + size])] < (rank[n], at):
                    assert all(gone[at : at + size])
            for i in range(len(w)):
                if gone[i]:
                    windows = [j for j in range(max(0, i - 19), i + 1) if j + 20 <= len(w) and all(gone[j : j + 20])]
                    assert any(first[tuple(w[j : j + 20])] < (rank[n], j) for j in windows)


def units_of(text):
    """(first word, words) of lines and paragraphs of 20 words or more."""
    at, out, start = 0, [], None
    for line in [*text.split("\n"), ""]:
        n = len(line.split())
        if n >= 20:
            out.append((at, n))
        if n and start is None:
            start = at
        elif not n and start is not None:
            if at - start >= 20:
                out.append((start, at - start))
            start = None
        at += n
    return out


def removed_words(spark, docs):
    """For each row in the order read, which of its words are removed."""
    numbered = docs.selectExpr("monotonically_increasing_id() AS row", "doc_id", "text")
    sizes = [len((r.text or "").split()) for r in numbered.orderBy("row").collect()]
    spans = {r.row: r.spans for r in substring_dedup.removals(numbered).collect()}
    order = [r.row for r in numbered.orderBy("row").collect()]
    out = []
    for row, size in zip(order, sizes):
        gone = [False] * size
        for s in spans.get(row, []):
            gone[s.start : s.end] = [True] * (s.end - s.start)
        out.append(gone)
    return out
