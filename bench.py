"""Times the headline queries over ``$BENCH_SF_DIR`` and prints one JSON line.

``value`` is the sum of the queries' seconds.  ``search_p95_ms`` and ``index_docs_per_s`` are measured
as the baseline defines them: six kinds of query, ten hits each, 20 times, first runs included, on an
index that is built once; ``search_first_ms`` is the slowest first run.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from docquarry import queries as engine
from docquarry.operators import stats
from docquarry.operators.ingest import FIELDS, content_fields
from docquarry.operators.postings import build, key_stats, laid_out
from docquarry.operators.search import Searcher, SearchRequest, Tables

HEADLINE = ("tok_terms_df", "tok_bigrams", "doc_identity_dedup", "document_table", "match_and", "match_phrase", "match_prefix", "bm25_topk", "bm25_weighted", "search_content_dedup", "session_debounce", "latest_per_document")
SEARCHES = ("erin", '"of the"', "the AND erin", "der OR que", "the NOT and", "er*")
REPEAT = 20


def build_index(spark: SparkSession, sf_dir: str, root: str) -> tuple[Tables, int]:
    """The index of the test documents, written and read again."""
    docs = engine.documents(spark, sf_dir).persist()
    fields = content_fields(docs.where("index_tier = 'FULL'"))
    names = engine.paths(spark, sf_dir).select("path", "filename")
    made = {
        "documents": docs.drop("body"), "paths": engine.paths(spark, sf_dir), "bodies": docs.where("body IS NOT NULL").select("document_id", "body"),
        "content_postings": laid_out(build(fields, "document_id", FIELDS)), "content_stats": key_stats(fields, "document_id", FIELDS),
        "filename_postings": laid_out(build(names, "path", ["filename"])), "filename_stats": key_stats(names, "path", ["filename"]),
    }
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    n = docs.count()
    docs.unpersist()
    return Tables(**{name: spark.read.parquet(f"{root}/{name}") for name in made}), n


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("docquarry-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine.QUERIES["tier_counts"](spark, sf_dir).collect()  # starts the JVM's code
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        engine.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    with tempfile.TemporaryDirectory() as root:
        began = time.perf_counter()
        tables, n = build_index(spark, sf_dir, root)
        seconds["index_build"] = round(time.perf_counter() - began, 3)
        searcher = Searcher(tables.cached())
        timing = stats.latencies(lambda q: searcher.hits(SearchRequest(q, limit=10)), SEARCHES, REPEAT)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale[1]) if scale else None,
        "search_p50_ms": round(timing["p50_ms"], 1), "search_p95_ms": round(timing["p95_ms"], 1), "search_first_ms": round(timing["first_ms"], 1), "index_docs_per_s": round(stats.throughput(n, seconds["index_build"]), 1),
    }))


if __name__ == "__main__":
    main()
