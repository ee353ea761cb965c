"""Command line: ``index``, ``search``, ``stats``, ``watch`` and ``bench``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .config import Config
from .functions.morph import configured
from .functions.text import human_bytes_py
from .operators import stats
from .operators.ingest import Indexer
from .operators.search import CONTENT, FILENAME, Searcher, SearchRequest, Tables
from .operators.store import IndexStore
from .schema import TABLES
from .sources.corpus import read_queries
from .sources.scan import scan_folder
from .streaming.watch import DEBOUNCE_MS, watch

# --- fixed values: labels of how a hit matched
KINDS = {"EXACT": "[정확 일치]", "MORPHOLOGICAL": "[형태소 분석]"}


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="docquarry")
    parser.add_argument("--config", default="docquarry.toml")
    parser.add_argument("--index", help="folder of the index; the configuration's by default")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index a folder")
    index.add_argument("folder")
    index.add_argument("--prune-missing", action="store_true")
    index.add_argument("--force", action="store_true", help="extract known contents again")
    search = commands.add_parser("search", help="search the index")
    search.add_argument("query")
    search.add_argument("--mode", choices=(CONTENT, FILENAME), default=CONTENT)
    search.add_argument("--limit", type=int, default=10)
    commands.add_parser("stats", help="counts by tier and reason")
    follow = commands.add_parser("watch", help="index a folder and follow its changes")
    follow.add_argument("folder")
    follow.add_argument("--debounce-ms", type=int, default=DEBOUNCE_MS)
    bench = commands.add_parser("bench", help="time indexing and searches")
    bench.add_argument("folder")
    bench.add_argument("--queries")
    bench.add_argument("--repeat", type=int, default=20)
    return parser


def print_hits(searcher: Searcher, request: SearchRequest) -> None:
    found = False
    for hit in searcher.hits(request) if request.limit >= 0 else searcher.search(request).toLocalIterator():
        found = True
        print(f"{hit['path']} {KINDS[hit['match_kind']]}")
        if hit["snippet"]:
            print(f"    {hit['snippet']}")
    if not found:
        print("no results")


def print_stats(store: IndexStore) -> None:
    documents = store.read("documents")
    tiers = stats.tier_counts(documents).collect()  # a row a tier
    if not tiers:
        print("no documents")
    for row in sorted(tiers):
        print(f"{row['index_tier']}: {row['n']}")
    for row in sorted(stats.demotion_counts(documents).collect()):  # a row a reason
        print(f"  {row['demotion_reason']}: {row['n']}")


def stored_bytes(store: IndexStore) -> int:
    """Size of the newest version's tables."""
    from pyspark.sql import functions as F

    files = [f for name in TABLES for f in store.read(name).inputFiles()]
    if not files:
        return 0
    read = store.spark.read.format("binaryFile").load(files).select(F.col("length"))
    return stats.corpus_bytes(read).first()[0]


def bench(spark: SparkSession, store: IndexStore, config: Config, folder: str, queries: str | None, repeat: int) -> dict:
    began = time.perf_counter()
    outcome = Indexer(spark, store, config, morphology=configured()).index_directory(folder)
    seconds = time.perf_counter() - began
    searcher = Searcher(Tables.of(store).cached(), configured())
    timing = stats.latencies(lambda q: searcher.hits(SearchRequest(q)), read_queries(spark, queries), repeat)
    corpus = stats.corpus_bytes(scan_folder(spark, folder, content=False)).first()[0]
    size = stored_bytes(store)
    return {"index_s": seconds, "docs_per_s": stats.throughput(outcome.full + outcome.meta, seconds), **timing, "corpus_bytes": corpus, "index_bytes": size, "ratio": size / corpus if corpus else 0.0}


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    config = Config.load(args.config)
    spark = SparkSession.builder.appName("docquarry").getOrCreate()
    store = IndexStore(spark, args.index or config.index_path)
    store.migrate()
    if args.command == "index":
        outcome = Indexer(spark, store, config, morphology=configured()).index_directory(args.folder, args.prune_missing, args.force)
        print(f"full {outcome.full}, meta {outcome.meta}, skip {outcome.skip}")
        store.vacuum()
    elif args.command == "search":
        print_hits(Searcher(Tables.of(store), configured()), SearchRequest(args.query, args.mode, args.limit))
    elif args.command == "stats":
        print_stats(store)
    elif args.command == "watch":
        query = watch(Indexer(spark, store, config, morphology=configured()), args.folder, f"{store.root}/watch-checkpoint", args.debounce_ms, lambda outcome: print(*(f"{k}: {v}" for k, v in outcome.items()), sep="\n"))
        query.awaitTermination()
    else:
        found = bench(spark, store, config, args.folder, args.queries, args.repeat)
        print(f"index: {found['docs_per_s']:.1f} documents/s in {found['index_s']:.1f} s")
        print(f"search: P50 {found['p50_ms']:.0f} ms, P95 {found['p95_ms']:.0f} ms over {found['runs']} runs: {'PASS' if found['passed'] else 'FAIL'}")
        print(f"size: corpus {human_bytes_py(found['corpus_bytes'])}, index {human_bytes_py(found['index_bytes'])}, ratio {found['ratio']:.2f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
