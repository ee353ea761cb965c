import pytest

from docquarry.operators.ingest import Indexer
from docquarry.operators.search import Searcher, SearchRequest, Tables
from docquarry.operators.store import IndexStore
from docquarry.sources import changes
from docquarry.sources.changes import begin, difference
from docquarry.streaming.watch import IGNORED, INDEXED, REMOVED, debounced, resolve, wait_for, watch


def test_difference():
    assert difference({"a": [1, 1], "b": [1, 1]}, {"a": [1, 2], "c": [0, 0]}) == [("a", "modify"), ("b", "delete"), ("c", "create")]


def test_sessions(spark):
    rows = spark.createDataFrame([(f"2026-01-01 00:00:{s:02}", p) for s, p in ((0, "a"), (2, "b"), (5, "a"), (9, "c"), (20, "a"))], "t string, path string").selectExpr("timestamp(t) AS ts", "path")
    found = debounced(rows, "3 seconds").orderBy("session_start").collect()
    assert [sorted(r["paths"]) for r in found] == [["a", "b"], ["c"], ["a"]]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_sessions_of_many_rows(spark, kind):
    """Each of 300 sessions has 1000 events, a second apart and in no order, a few instants twice; its last gap is the one allowed."""
    at = "(id DIV 1000) * 3000 + (id * 7919 % 1000) + CASE WHEN id * 7919 % 1000 = 999 THEN 599 ELSE 0 END"
    rows = spark.range(0, 300000, 1, 6).selectExpr(f"CAST(timestamp_seconds(1767225600 + {at}) AS {kind}) AS ts", "CAST(id % 5 AS STRING) AS path")
    found = debounced(rows.unionByName(rows.limit(2000)), "10 minutes").selectExpr("unix_seconds(CAST(session_start AS TIMESTAMP)) AS a", "unix_seconds(CAST(session_end AS TIMESTAMP)) AS b", "size(paths) AS n")
    assert sorted(map(tuple, found.collect())) == [(1767225600 + k * 3000, 1767225600 + k * 3000 + 2198, 5) for k in range(300)]


def test_resolve(spark, tmp_path):
    folder, store = tmp_path / "in", IndexStore(spark, str(tmp_path / "index"))
    (folder / "sub").mkdir(parents=True)
    indexer = Indexer(spark, store)
    (folder / "a.txt").write_text("처음")
    (folder / "b.zip").write_text("x")
    # events say what they like: what is there now counts
    assert resolve(indexer, [str(folder / "." / "a.txt"), str(folder / "b.zip"), str(folder / "sub"), str(folder / "none.txt")]) == {str(folder / "a.txt"): INDEXED, str(folder / "b.zip"): IGNORED, str(folder / "sub"): IGNORED, str(folder / "none.txt"): IGNORED}
    (folder / "a.txt").unlink()
    assert resolve(indexer, [str(folder / "a.txt")]) == {str(folder / "a.txt"): REMOVED} and store.read("documents").count() == 0


def started(spark, tmp_path, **how):
    folder, store, seen = tmp_path / "in", IndexStore(spark, str(tmp_path / "index")), []
    folder.mkdir(exist_ok=True)
    return folder, store, seen, watch(Indexer(spark, store), str(folder), str(tmp_path / "checkpoint"), 300, seen.append, **how)


def test_watch(spark, tmp_path):
    """Changes right after the start, with no pause, are seen."""
    folder, store, seen, query = started(spark, tmp_path)
    try:
        (folder / "~$notice.txt").write_text("잠깐")
        (folder / "notice.txt").write_text("도서관 휴관 안내")
        (folder / "~$notice.txt").unlink()
        found = lambda: {k: v for batch in seen for k, v in batch.items()}
        assert wait_for(lambda: str(folder / "notice.txt") in found(), 120), query.exception()
        assert found()[str(folder / "notice.txt")] == INDEXED and set(found().values()) <= {INDEXED, IGNORED}
        assert Searcher(Tables.of(store)).search(SearchRequest("휴관")).count() == 1
        n = len(seen)
        (folder / "notice.txt").unlink()
        assert wait_for(lambda: len(seen) > n, 120) and seen[n] == {str(folder / "notice.txt"): REMOVED}
        assert Searcher(Tables.of(store)).search(SearchRequest("휴관")).count() == 0 and len(seen) == n + 1  # reading wakes nothing
    finally:
        query.stop()


def test_changes_during_the_first_scan(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    late = tmp_path / "in" / "late.txt"
    whole = Indexer.index_directory

    def slow(self, root, *args, **how):
        outcome = whole(self, root, *args, **how)
        late.write_text("늦게 온 파일")
        return outcome

    monkeypatch.setattr(Indexer, "index_directory", slow)
    _, store, seen, query = started(spark, tmp_path)
    try:
        assert wait_for(lambda: any(batch.get(str(late)) == INDEXED for batch in seen), 120), query.exception()
    finally:
        query.stop()
    assert [n for n in (tmp_path / "checkpoint" / "seen").iterdir() if n.suffix == ".json"]


def test_offsets_are_numbers(tmp_path):
    folder, seen = tmp_path / "in", str(tmp_path / "seen")
    folder.mkdir()
    begin(seen, str(folder))
    source = changes._Changes({"path": str(folder), "seen": seen})
    assert source.read({"n": 0})[1] == {"n": 0}
    for n in range(15):
        (folder / f"{n}.txt").write_text("x")
        rows, end = source.read({"n": n})
        assert [(p, k) for p, k, _ in rows] == [(str(folder / f"{n}.txt"), "create")] and end == {"n": n + 1}
    assert len(list(source.readBetweenOffsets({"n": 3}, {"n": 9}))) == 6
    source.commit({"n": 15})
    assert len(list((tmp_path / "seen").iterdir())) == changes.KEPT + 1
