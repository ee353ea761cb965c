import random

import duckdb

from docquarry.llm import lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1] <= 1


def expected(rows, near_words=10):
    places = {}
    for doc_id, text in rows:
        for n, line in enumerate((text or "").encode().split(b"\n")):
            words = tuple(line.lower().split())
            if doc_id is not None and len(words) >= 5:
                places[doc_id, n] = words
    first = {}
    for place in sorted(places):
        first.setdefault(places[place], place)
    distinct = sorted(first, key=first.get)
    near = {}
    for i, w in enumerate(distinct):
        found = [first[v] for v in distinct[:i] if min(len(v), len(w)) >= near_words and within_one(v, w)]
        if found:
            near[w] = min(found)
    out = set()
    for place, words in places.items():
        if words in near:
            out.add((*place, *near[words], len(words), 1))
        elif first[words] < place:
            out.add((*place, *first[words], len(words), 0))
    return out


def test_like_all_pairs(spark, documents, empty):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.choice((4, 5, 9, 10, 11, 14)))) for _ in range(30)]
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    for i in range(200, 260):
        own = []
        for _ in range(4):
            words = rng.choice(base).split()
            at = rng.randrange(len(words))
            words = [words, words[:at] + words[at + 1 :], [*words[:at], "new", *words[at:]], [*words[:at], "zz", *words[at + 1 :]]][rng.randrange(4)]
            own.append((" ".join(words)).upper() if rng.random() < 0.2 else "  ".join(words))
        rows.append((i, "\n".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in lines.duplicate_lines(docs).select("doc_id", "line_no", "keep_doc_id", "keep_line_no", "n_words", "edits").collect()}
    assert got == expected(rows) and any(r[5] for r in got)
    assert lines.duplicate_lines(empty).count() == 0


def test_runs_of_one_word(spark):
    """Deleting either of two equal words gives one variant, at two places."""
    rows = [(1, "a a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "a a a b c d e f g h i j"), (4, "b c d e f g h i j a"), (5, "x a b c d e f g h i j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in lines.duplicate_lines(docs).select("doc_id", "line_no", "keep_doc_id", "keep_line_no", "n_words", "edits").collect()}
    assert got == expected(rows)


def test_stage(spark, documents, empty):
    out = lines.without_duplicate_lines(documents)
    assert out.columns == documents.columns and out.count() == documents.count() and lines.without_duplicate_lines(empty).count() == 0
    passage = " ".join(f"w{i}" for i in range(55))
    docs = spark.createDataFrame([(1, f"short\n{passage}\nmine alone it is here", 9), (2, f"{passage}\nother words stand in here\nshort", 9), (3, f"short\n{passage}", 9), (4, None, None), (5, "short", 5), (6, passage, 9)], "doc_id long, text string, n_chars long")
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.without_duplicate_lines(docs).collect()}
    assert kept[1] == (f"short\n{passage}\nmine alone it is here", 9) and kept[2][0] == "other words stand in here\nshort" and kept[2][1] == len(kept[2][0])
    assert kept[3] == ("short", 5) and kept[4] == (None, None) and kept[5] == ("short", 5) and kept[6] == ("", 0)


def test_stage_keeps_every_line_that_is_not_named(spark):
    """Short lines stay, and columns may be called anything."""
    notice = " ".join(f"w{i}" for i in range(30))
    poem = f"rose\n{notice}\nis a rose\n"
    docs = spark.createDataFrame([(1, f"title\n{notice}", "a", 1, "x"), (2, poem, "b", 2, "y"), (3, poem, None, None, None)], "doc_id long, text string, lines string, id int, c1 string")
    out = lines.without_duplicate_lines(docs)
    kept = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert out.columns == docs.columns and kept == {1: (1, f"title\n{notice}", "a", 1, "x"), 2: (2, "rose\nis a rose\n", "b", 2, "y"), 3: (3, "rose\nis a rose\n", None, None, None)}


def test_ids_with_several_texts(spark):
    """Each text's lines count, and a place is told apart by its line."""
    a, b = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    rows = [(1, f"{a}\n{b} x"), (2, f"{b}\nq q q q q"), (2, f"{a} z\nz z z z z"), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"], r["keep_doc_id"], r["keep_line_no"]) for r in lines.duplicate_lines(docs).collect()}
    assert got == {(2, 0, 1, 0), (2, 0, 1, 1), (3, 0, 1, 1)}


def test_frequent_lines_are_dealt_out(spark):
    """One line, and one template with a word of its own, in nearly all documents: no task gets them all."""
    same, template = " ".join(f"s{i}" for i in range(12)), " ".join(f"t{i}" for i in range(14))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('{same}\n{template} ', id, ' end') AS text").repartition(4)
    got = lines.duplicate_lines(docs).groupBy("edits").count().collect()
    assert {r["edits"]: r["count"] for r in got} == {0: 2999, 1: 2999}


def test_like_sql(spark):
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = {tuple(r) for r in db.execute(f"SELECT doc_id, line_no, keep_doc_id, keep_line_no, n_words, edits FROM ({lines.OP8_SQL})").fetchall()}
    got = {tuple(r) for r in lines.op8_line_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "line_no", "keep_doc_id", "keep_line_no", "n_words", "edits").collect()}
    assert got == want
