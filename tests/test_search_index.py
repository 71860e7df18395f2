"""Pages from the index against a scan of everything, what is read for them, and cursors."""

import pytest

from tidemark.operators import search as S
from tidemark.operators import search_index as X

KIND = "id long, key long, title string, organization array<string>, category string, source string"


def scan(rows, aliases, q):
    """Every entry scored one by one, in Python."""
    norm = lambda t: " ".join(S.prepare_query(t or ""))
    words, out = S.prepare_query(q), []
    for i, key, title, orgs, category, source in rows:
        fields = [("title", norm(title)), *(("organization", norm(o)) for o in orgs or []), ("category", norm(category)), ("source", norm(source))]
        fields += [("alias", norm(" ".join(n))) for m, n in aliases if (k := norm(m).replace(" ", "")) and any(k in t.replace(" ", "") for _, t in fields)]

        def best(w, k):
            worth = lambda f, t: 0 if w.replace(" ", "") not in t.replace(" ", "") else S.WEIGHTS[f][k] if w in t else int(S.WEIGHTS[f][k] * S.COMPACT_SHARE + 0.5)
            return max(worth(f, t) for f, t in fields)

        per = [best(w, 1) for w in words]
        if any(per):
            out.append((-(sum(per) + (best(" ".join(words), 0) if len(words) > 1 else 0) + (S.ALL_WORDS * len(words) if all(per) else 0)), key, i))
    return [(i, -s) for s, _, i in sorted(out)]


def test_pages_equal_a_scan_and_read_a_part(spark, tmp_path):
    rare = {17: "zebra crossing", 230: "the zebra", 399: "quagga"}
    rows = [(i, -i, rare.get(i, f"the notice number {i} of the week {i % 9}"), [f"dept {i % 5}", "school"][: 1 + i % 2], ["news", "jobs"][i % 2], f"board {i % 3}") for i in range(600)]
    rows += [(600, -600, None, None, None, None), (601, -601, "", [], "", ""), (602, -602, "한국 장학금 안내", ["학과"], "news", "board 1"), (603, -603, "a", ["x"], "jobs", "b")]
    aliases = [("zebra", ["striped horse"]), ("dept 3", ["third dept", "drei"]), ("장학", ["돈"]), ("", ["never"])]
    index = X.build(spark.createDataFrame(rows, KIND), aliases, f"file://{tmp_path}/index", "r9")
    total = index.table("postings").count()
    for q in ("the zebra", "striped horse", "drei week", "no tice", "돈", "a", "none such"):
        want = scan(rows, aliases, q)
        got = X.search(index, q, 10)
        assert [(r.id, r.score) for r in got.rows.orderBy("position").collect()] == want[:10], q
        assert (got.next_cursor is not None) == (len(want) > 10)
        if got.next_cursor:
            assert [(r.id, r.score) for r in X.search(index, q, 10, got.next_cursor).rows.orderBy("position").collect()] == want[10:20], q
    # a rare word's page is settled without the postings of the frequent one
    assert X.search(index, "striped horse", 1).read["opened"] <= 2
    read = X.search(index, "zebra quagga", 2).read
    assert 0 < read["postings"] < total / 20
    both = X.search(index, "dept notice", 10, organization=["dept 4"])
    assert [r.id for r in both.rows.collect()] == [i for i, _ in scan([r for r in rows if r[3] and "dept 4" in r[3]], aliases, "dept notice")][:10]
    assert X.search(index, " ... ", 10).rows.count() == 0


def test_cursors_are_of_one_revision():
    assert X.offset_of(None, "r1") == 0 and X.offset_of(X.cursor(40, "r:1"), "r:1") == 40
    with pytest.raises(X.StaleCursor):
        X.offset_of(X.cursor(40, "r1"), "r2")
