import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.snippet import around, literal_span, result_snippet, snippet, widened
from docquarry.operators.stats import nearest_rank, nearest_rank_py
from docquarry.plans.ast import Phrase

TEXTS = ["발행절차", "가 나", "채권 발행", "", " ", "Café a_b 3.2% ① ß ø ł", "x", "ｆｕｌｌ ÉÈÇ Ñandú", "a b\tc", None, "Łódź ạ́ ǖ", "é"]


def test_tokens_like_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", "t", T.index_tokens(F.col("t")).alias("a"), T.bigrams(F.col("t")).alias("b")).collect()
    for r in rows:
        assert r["a"] == T.index_tokens_py(r["t"] or ""), r
        assert r["b"] == T.bigrams_py(r["t"] or ""), r


@pytest.mark.parametrize(("text", "grams"), [("발행절차", ["발행", "행절", "절차"]), ("가 나", ["가", "나"]), ("채권 발행", ["채권", "발행"])])
def test_bigrams(text, grams):
    assert T.bigrams_py(text) == grams


def test_fold():
    assert T.index_tokens_py("Café a_b 3.2% ① ß ø") == ["cafe", "a", "b", "3", "2", "①", "ß", "ø"]


def test_names_and_sizes(spark):
    rows = spark.createDataFrame([("/a/b.TXT", 512), ("c", 2048), ("/x/.hidden", 5 << 20), ("/x/a.tar.gz", 3 << 40)], "p string, n long")
    found = rows.select(T.extension(T.filename(F.col("p"))).alias("e"), T.human_bytes(F.col("n")).alias("b")).collect()
    assert [tuple(r) for r in found] == [("txt", "512.0B"), ("", "2.0KB"), ("", "5.0MB"), ("gz", "3.0TB")]
    assert [T.human_bytes_py(n) for n in (512, 2048, 5 << 20)] == ["512.0B", "2.0KB", "5.0MB"]


def test_nearest_rank(spark):
    assert [nearest_rank_py(list(range(1, 101)), p) for p in (50, 95, 100)] == [51, 95, 100] and nearest_rank_py([], 50) == 0
    values = [5, 1, 1, 1, 9, 2, 2, None, 7, 7, 7, 3]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = {r["percent"]: r["value"] for r in nearest_rank(df, "v", (0, 10, 50, 95, 100)).collect()}
    assert got == {p: nearest_rank_py([v for v in values if v is not None], p) for p in (0, 10, 50, 95, 100)}
    assert [r["value"] for r in nearest_rank(df.where("v > 99"), "v", (50,)).collect()] == [0.0]


def test_snippets():
    text = " ".join(f"w{i}" for i in range(40))
    assert snippet(text, [Phrase(("w20",))]) == "..." + " ".join(f"w{i}" for i in range(15, 20)) + " >>w20<< " + " ".join(f"w{i}" for i in range(21, 27)) + "..."
    assert snippet(text, [Phrase(("w39",))]).endswith(">>w39<<") and snippet(text, [Phrase(("w39",))]).startswith("...w28")
    assert snippet(text, [Phrase(("zz",))]) == " ".join(f"w{i}" for i in range(12)) + "..."
    assert snippet("채권 발행 절차", [Phrase(("채권", "발행"))]) == ">>채권 발행<< 절차"
    assert snippet("채권 발행 절차", [Phrase(("채권",)), Phrase(("발행",))]) == ">>채권<< >>발행<< 절차"
    assert snippet("a a a", [Phrase(("a", "a"))]) == ">>a a a<<"
    assert snippet(text, [Phrase(("w5",)), Phrase(("w30",))]).startswith("w0 ")


def test_fallback_and_widening():
    assert literal_span("One TWO", ["none", "two"]) == (4, 3)
    assert around("x" * 50 + "hit" + "y" * 50, 50, 3) == "..." + "x" * 40 + ">>hit<<" + "y" * 40 + "..."
    assert widened(">>레이<<아웃과", ["레이아웃"]) == ">>레이아웃<<과"
    assert widened("a >>b", ["bc"]) == "a >>b"
    assert result_snippet("GDP 성장률은 3.2%였다.", [Phrase(("3", "2"))], ["3.2%"]) == "GDP 성장률은 >>3.2%<<였다."


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab cd. ef: gh".split()), max_size=40), st.lists(st.sampled_from(["ab", "cd", "ef"]), min_size=1, max_size=3))
def test_snippet_keeps_the_text(words, wanted):
    text = " ".join(words)
    shown = snippet(text, [Phrase((w,)) for w in wanted])
    assert shown.replace(">>", "").replace("<<", "").strip(".").strip() in text


def test_analyser_of_the_settings(monkeypatch):
    import pickle

    from docquarry.functions import morph

    for name in morph.VARIABLES:
        monkeypatch.delenv(name, raising=False)
    assert morph.configured() is None
    monkeypatch.setenv(morph.VARIABLES[0], "samples:analyser_of")
    assert morph.configured() is None
    monkeypatch.setenv(morph.VARIABLES[1], "somewhere")
    assert isinstance(pickle.loads(pickle.dumps(morph.configured()))(), morph.Morphology)
    monkeypatch.setenv(morph.VARIABLES[0], "samples:nothing")
    assert morph.configured() is None
