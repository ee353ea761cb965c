from collections import Counter

import corpus_pipeline
from docquarry.llm import queries, toxicity
from docquarry.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    """Each stage against what its operator says of that stage's own input."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF))
        assert out.columns == columns, name
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.toxicity_scores(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
            assert bad and {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} - bad
        docs = out
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    last = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect())
    assert last.keys() == {r["doc_id"] for r in docs.collect()}


def test_queries():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 11)} and set(queries.SQL) <= set(queries.QUERIES)
