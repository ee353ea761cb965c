"""Boolean matching and ranks against SQLite's full-text index."""

import random
import sqlite3

import pytest

from docquarry.operators import match, postings
from docquarry.plans.parser import parse, query_tree
from docquarry.schema import FIELD_WEIGHTS

FIELDS = list(FIELD_WEIGHTS)
WORDS = ["ab", "abc", "b", "cd", "x", "y", "été"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    rows = [(f"d{i:02}", text(9), text(5), text(3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, body string, morph string, morph_kiwi string")
    built, sizes = postings.build(df, "id", FIELDS).cache(), postings.key_stats(df, "id", FIELDS).cache()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body, morph, morph_kiwi, id UNINDEXED)")
    db.executemany("INSERT INTO t(id, body, morph, morph_kiwi) VALUES (?, ?, ?, ?)", rows)
    return built, sizes, db


QUERIES = ["ab", "ab cd", "ab AND cd", "ab OR x", "ab NOT x", "ab OR cd x", "x NOT ab y", '"ab cd"', '"ab cd x" OR y', "ab*", '"x ab"*', "ab ab", "ete", "nothing", 'x AND "%"', 'x "%"', '"%" OR x', 'x NOT "%"', '"%" NOT x', '"b b" OR "x y" NOT cd', "y OR b AND ab NOT x"]


@pytest.mark.parametrize("query", QUERIES)
def test_like_sqlite(corpus, query):
    built, sizes, db = corpus
    want = {r[0]: r[1] for r in db.execute("SELECT id, bm25(t, 1.0, 0.3, 0.5) FROM t WHERE t MATCH ?", [parse(query).expression])}
    got = {r["key"]: r["rank"] for r in match.search(built, sizes, query_tree(parse(query)), FIELD_WEIGHTS).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)


def test_nothing_and_literal(corpus):
    built, sizes, _ = corpus
    assert match.search(built, sizes, query_tree(parse('"%"'))).count() == 0
    both = match.search(built, sizes, query_tree(parse("ab OR x")), literal=query_tree(parse("ab")))
    alone = match.search(built, sizes, query_tree(parse("ab"))).select("key")
    assert both.where("literal").count() == alone.count() and both.where("literal").join(alone, "key").count() == alone.count()


def test_plan_reads_postings_once(corpus, spark, tmp_path):
    built, sizes, _ = corpus
    postings.laid_out(built).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    for query in ("ab AND er*", '"ab cd" OR x'):
        plan = match.search(stored, sizes, query_tree(parse(query)), ranked=False)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "PushedFilters: [IsNotNull(key), Or(" in plan, plan
    assert match.phrase_counts(stored, query_tree(parse('"ab cd"'))).where("times < 1").count() == 0


def test_whole_index_is_grouped_in_place(spark, monkeypatch):
    """As ``build`` has it, of odd texts too, and only texts are shuffled; in parts and chunks of any size."""
    rows = [("a", "x y x É", ""), ("b", None, "z"), ("c", "...", None), ("d", "", ""), ("e", "word " * 500, "x"), *((f"k{i}", f"t{i % 7} u t{i % 3}", "v") for i in range(300))]
    df = spark.createDataFrame(rows, "id string, body string, morph string")
    want = sorted(map(tuple, postings.build(df, "id", ["body", "morph"]).collect()))
    for chunk, size in ((1 << 20, 10), (7, 3 * postings.PART_BYTES)):
        monkeypatch.setattr(postings, "CHUNK_TOKENS", chunk)
        found = postings.whole(df, "id", ["body", "morph"], size)
        assert sorted(map(tuple, found.collect())) == want
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    sums = postings.sums(found, df.select("id"))
    assert sorted(sums.collect()) == sorted(postings.key_stats(df, "id", ["body", "morph"]).collect())
