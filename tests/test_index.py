"""Folders to hits, as the tables of an index go through their versions."""

import os
import random

import pytest
from pyspark.sql import functions as F
from samples import docx, morphology, pptx, xlsx

from docquarry.config import Config
from docquarry.errors import ConflictError, IndexingError, SearchError
from docquarry.operators.admission import COMPRESSED, OVERSIZED, TEMP, UNSUPPORTED, admit
from docquarry.operators.ingest import Indexer, Outcome
from docquarry.operators.search import Searcher, SearchRequest, Tables
from docquarry.operators.stats import demotion_counts, tier_counts
from docquarry.operators.store import FAN, Change, IndexStore
from docquarry.schema import LAYOUT, TABLES
from docquarry.sources.scan import scan_folder


@pytest.fixture
def made(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = IndexStore(spark, str(tmp_path / "index"))

    def index(files=None, morph=None, **how):
        for name, content in (files or {}).items():
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
        return Indexer(spark, store, morphology=morph).index_directory(str(folder), **how)

    def hits(query, morph=None, mode="content", limit=10, **how):
        rows = Searcher(Tables.of(store), morph, **how).search(SearchRequest(query, mode, limit)).collect()
        return [(r["filename"], r["match_kind"], r["snippet"]) for r in rows]

    return folder, store, index, hits


NOTICE = "도서관 휴관 일정을 알린다. 도서관 휴관 중에는 반납함을 쓴다."


def test_admission(spark):
    names = {"~$notes.docx": TEMP, "report.tmp": TEMP, "archive.ZIP": COMPRESSED, "report.txt": None, "a.exe": UNSUPPORTED, "~$a.zip": TEMP}
    rows = admit(spark.createDataFrame([(f"/d/{n}", 10) for n in names] + [("/d/big.txt", 50 * 2**20 + 1)], "path string, length long")).collect()
    assert {r["filename"]: r["skip_reason"] for r in rows} == names | {"big.txt": OVERSIZED}


def test_formats(made):
    folder, store, index, hits = made
    files = {"안내.txt": NOTICE, "기타.txt": "버스 노선 변경", "일정.xlsx": xlsx([["도서관", "휴관"]]), "공지.docx": docx(("도서관 휴관",)), "화면.pptx": pptx({1: "도서관 휴관"}), "깨짐.pdf": b"broken", "묶음.zip": b"PK", "~$안내.txt": b"x", "copy/안내2.txt": NOTICE}
    assert index(files) == Outcome(6, 1, 2)
    found = hits("도서관 휴관")
    assert len(found) == 4 and all(">>" in s and k == "EXACT" for _, k, s in found)  # one path of the two copies
    assert {r["index_tier"]: r["n"] for r in tier_counts(store.read("documents")).collect()} == {"FULL": 5, "META": 1}
    assert [tuple(r) for r in demotion_counts(store.read("documents")).collect()] == [("PARSE_FAIL", 1)]
    assert {n for n, *_ in hits("안내*", mode="filename")} == {"안내.txt", "안내2.txt"}
    assert [n for n, *_ in hits("깨짐 tier:meta", mode="filename")] == ["깨짐.pdf"] and hits("휴관 tier:meta") == [] and hits("휴관 drm:true") == []
    assert [n for n, *_ in hits("휴관 ext:xlsx")] == ["일정.xlsx"] and len(hits("휴관 path:copy")) == 1 and len(hits("휴관 modified>1999-06-01 modified<2998")) == 4
    assert {n for n, *_ in hits("ext:xlsx")} == {"일정.xlsx"} and len(hits("휴관", limit=-1)) == 4
    with pytest.raises(SearchError):
        hits("ext:xlsx", strict=True)
    with pytest.raises(SearchError):
        hits("NOT x")
    assert index() == Outcome(6, 1, 2) and store.read("documents").count() == 6  # again, nothing changes
    os.remove(folder / "기타.txt")
    index()
    assert store.read("paths").count() == 7
    index(prune_missing=True)
    assert store.read("paths").count() == 6 and store.read("documents").count() == 5 and hits("노선") == []


def test_changed_content_leaves_no_orphan(made):
    _, store, index, hits = made
    index({"a.txt": "습도는 41.8%였다."})
    assert hits("41.8%")[0][2] == "습도는 >>41.8%<<였다."
    index({"a.txt": "습도는 63.4%였다."})
    assert hits("41.8%") == [] and len(hits("63.4%")) == 1 and store.read("documents").count() == 1 and store.read("paths").count() == 1
    keys = store.read("content_postings").select("key").distinct()
    assert keys.count() == 1 and store.read("content_stats").count() == 1


def test_marks_and_hits_shuffle_no_rows(spark, made):
    folder, store, index, hits = made
    index({"a.txt": "봄 여름", "b.txt": "여름 겨울", "c.txt": "겨울"})
    Indexer(spark, store).remove_paths(spark.createDataFrame([(str(folder / "a.txt"),)], "path string"))
    plan = store.read("content_postings")._jdf.queryExecution()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan.executedPlan().toString() and {r["term"] for r in store.read("content_postings").where("field = 'body'").collect()} == {"여름", "겨울"}
        found = Searcher(Tables.of(store)).search(SearchRequest("여름"))
        bodies = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin [document_id" in line]
        assert bodies and [r["snippet"] for r in found.collect()] == [">>여름<< 겨울"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_removal(spark, made):
    folder, store, index, hits = made
    index({"a.txt": "봄 여름", "b.txt": "봄 여름", "c.txt": "겨울"})
    remove = lambda *names: Indexer(spark, store).remove_paths(spark.createDataFrame([(str(folder / n),) for n in names], "path string"))
    remove("a.txt", "unknown.txt")
    assert len(hits("여름")) == 1 and store.read("documents").count() == 2
    remove("b.txt")
    assert hits("여름") == [] and store.read("documents").count() == 1 and store.read("document_bodies").count() == 1 and hits("a", mode="filename") == []


def test_word_forms(made):
    _, store, index, hits = made
    index({"봉사.txt": "누나는 이웃을 도왔다.", "야간.txt": "형은 이웃을 도왔고, 잠들었다.", "안내.txt": NOTICE, "측정.txt": "연구소에서 수온을 쟀다.", "공연.txt": "합창단에서 노래했다.", "서가.txt": "오디오북과 색인 카드를 모두 정리한다."}, morphology)
    assert {n for n, *_ in hits("돕")} == {"봉사.txt", "야간.txt"}
    assert hits("돕다") == []
    found = {n: (k, s) for n, k, s in hits("돕다", morphology)}
    assert found["야간.txt"][0] == "MORPHOLOGICAL" and ">>도왔고,<<" in found["야간.txt"][1] and found.keys() == {"봉사.txt", "야간.txt"}
    assert [k for _, k, _ in hits("도서관 휴관", morphology)] == ["EXACT"] and [k for _, k, _ in hits("연구소", morphology)] == ["EXACT"]
    assert {n: k for n, k, _ in hits("합창단", morphology)}["공연.txt"] == "MORPHOLOGICAL"
    assert ">>정리<<한다" in hits("정리함", morphology)[0][2] and ">>오디오북<<과" in hits("오디오북", morphology)[0][2]
    assert "공연.txt" in {n for n, *_ in hits("합창")}  # by bigrams


def test_bigrams_only(made):
    _, store, index, hits = made
    index({"a.txt": "누나는 이웃을 도왔다."})
    assert hits("돕") == [] and len(hits("도왔")) == 1


def test_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"))
    assert store.migrate() == LAYOUT and store.migrate() == LAYOUT and store.version() == 1
    assert store.get_body("x") is None
    store.put_body("x", "one")
    store.put_body("x", "two")
    assert store.get_body("x") == "two" and store.read("paths").count() == 0
    (tmp_path / "i" / "versions" / "000000000009.json").write_text('{"version": 9, "layout": 99, "tables": {}}')
    with pytest.raises(IndexingError):
        store.migrate()


def test_whole_tables_of_the_first_layout(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"))
    spark.createDataFrame([("x", "kept")], "document_id string, body string").write.parquet(f"{store.root}/tables/document_bodies/3-a")
    spark.createDataFrame([(3, 1, "document_bodies", "tables/document_bodies/3-a"), (2, 1, "document_bodies", "nowhere")], "version long, layout int, table string, location string").write.parquet(f"{store.root}/catalog")
    assert store.migrate() == LAYOUT and store.get_body("x") == "kept"


def bodies(store):
    return {r["document_id"]: r["body"] for r in store.read("document_bodies").collect()}


def test_segments_and_marks(spark, tmp_path):
    """Any run of changes reads like a dictionary, whatever was merged meanwhile, and old versions stay as they are."""
    rng, store, want = random.Random(3), IndexStore(spark, str(tmp_path / "i")), {}
    store.migrate()
    early = None
    for step in range(2 * FAN + 3):
        keys = rng.sample("abcdefgh", 3)
        new = {k: f"{k}{step}" for k in keys[:2]} if step % 4 else {}
        rows = spark.createDataFrame(list(new.items()), TABLES["document_bodies"])
        store.publish({"document_bodies": Change(rows, spark.createDataFrame([(k,) for k in keys], "k string"))})
        want = {k: v for k, v in want.items() if k not in keys} | new
        parts = store.snapshot().tables["document_bodies"]
        assert bodies(store) == want and len(parts["segments"]) < FAN and len(parts["gone"]) < FAN
        if step == 5:
            early = store.snapshot(), dict(want)
    assert {r[0]: r[1] for r in early[0].read("document_bodies").collect()} == early[1]
    store.compact()
    parts = store.snapshot().tables["document_bodies"]
    assert bodies(store) == want and len(parts["segments"]) == 1 and not parts["gone"]
    assert store.vacuum(keep=1) == 0 and store.vacuum(keep=1, hours=-1) > 0 and bodies(store) == want and len(os.listdir(tmp_path / "i" / "tables" / "document_bodies")) == 1


def test_of_two_writers_one_begins_again(spark, made):
    folder, store, index, hits = made
    index({"a.txt": "봄 여름"})
    base = store.snapshot()
    store.publish({}, base)
    with pytest.raises(ConflictError):
        store.publish({}, base)
    (folder / "b.txt").write_text("가을")
    first, took = store.snapshot, []

    def late():  # another writer comes between the first look and the publication
        found = first()
        if not took:
            took.append(found)
            Indexer(spark, IndexStore(spark, store.root)).remove_paths(spark.createDataFrame([(str(folder / "a.txt"),)], "path string"))
        return found

    store.snapshot = late
    try:
        Indexer(spark, store).index_document(str(folder / "b.txt"))
    finally:
        del store.snapshot
    assert hits("여름") == [] and [n for n, *_ in hits("가을")] == ["b.txt"] and store.read("documents").count() == 1


def test_a_change_writes_only_its_rows(made):
    _, store, index, hits = made
    index({f"{i}.txt": f"같은 글 {i}" for i in range(30)})
    before = {e["location"] for parts in store.snapshot().tables.values() for e in parts["segments"]}
    index({"7.txt": "새로운 글"})
    tables = store.snapshot().tables
    assert before <= {e["location"] for parts in tables.values() for e in parts["segments"]}
    new = {n: [e for e in parts["segments"] if e["location"] not in before] for n, parts in tables.items()}
    rows = {n: store.rows(n, es, []).count() for n, es in new.items()}
    assert rows["documents"] == rows["document_bodies"] == rows["content_stats"] == 1 and rows["filename_postings"] == rows["filename_stats"] == 0
    assert [n for n, *_ in hits("새로운")] == ["7.txt"] and len(hits("글", limit=-1)) == 30 and store.read("documents").count() == 30


def test_scan(spark, tmp_path):
    (tmp_path / "_a").mkdir()
    (tmp_path / "_a" / ".b c%20.txt").write_bytes(b"hello")
    os.symlink(tmp_path / "_a" / ".b c%20.txt", tmp_path / "link.txt")
    rows = scan_folder(spark, str(tmp_path)).withColumn("id", F.sha2("content", 256)).collect()
    assert [r["path"] for r in rows] == [str(tmp_path / "_a" / ".b c%20.txt")] and rows[0]["id"].startswith("2cf24dba") and rows[0]["modified_at"].endswith("Z")
    assert scan_folder(spark, str(tmp_path), content=False).first()["content"] is None and scan_folder(spark, str(tmp_path), max_length=3).first()["content"] is None


def test_config(tmp_path):
    assert Config.load(tmp_path / "none") == Config()
    (tmp_path / "c.toml").write_text('max_file_size_mb = 1\nindex_path = "x"\nother = 2\n')
    assert Config.load(tmp_path / "c.toml").max_bytes == 2**20


def test_command_line(made, capsys, monkeypatch, tmp_path):
    from docquarry import cli

    folder, store, index, _ = made
    index({"안내.txt": NOTICE})
    at = ["--index", store.root]
    assert cli.main([*at, "index", str(folder)]) == 0 and cli.main([*at, "search", "휴관"]) == 0 and cli.main([*at, "search", "없음"]) == 0 and cli.main([*at, "stats"]) == 0
    queries = tmp_path / "q.txt"
    queries.write_text("휴관\n\n도서*\n")
    assert cli.main([*at, "bench", str(folder), "--queries", str(queries), "--repeat", "1"]) == 0
    out = capsys.readouterr().out
    assert "full 1, meta 0, skip 0" in out and "[정확 일치]" in out and "no results" in out and "FULL: 1" in out and "P95" in out and "2 runs" in out
