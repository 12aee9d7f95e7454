"""Headline queries, timed on stored tables with a stored index. Prints one JSON line.

The index and the catalogue are written once, as a catalogue service would have them; what is timed is each query to
its last row: ten shapes of search with their pages, then analytics, autocompletion and related documents. `value` is
their sum without index_build, as in earlier rounds; `with_index_build` has it. `large` repeats the shapes over each
document BENCH_COPIES times under new ids (10 copies of sf0.1 are the 100,000 documents that the baseline's bound is for).
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import bucket
from skerry.operators import search as S
from skerry.plans import catalogue
from skerry.plans.search_queries import NAME_SIZES, SIZE_LABELS, STATES
from skerry.plans.views import NOW, docs
from skerry.sources.files import write_postings

COPIES = int(os.environ.get("BENCH_COPIES", "10"))
SF_DIR, CPUS, REPEATS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_REPEATS", "3"))
OTHERS = ["catalogue_totals", "catalogue_categories", "extension_counts", "health_states", "metrics_hours", "metrics_rates", "peers_by_address", "moderation_histogram", "change_log_compaction"]


def search_shapes(spark: SparkSession, work: str, copies: int) -> tuple[float, int, dict[str, Callable[[], DataFrame]]]:
    """Seconds to build the stored tables, how many documents they have, and the shapes that are asked of them."""
    began = time.perf_counter()
    docs(spark, SF_DIR, copies).repartitionByRange(int(CPUS) * copies, "doc_id").write.parquet(f"{work}/docs")
    d = spark.read.parquet(f"{work}/docs")
    write_postings(S.postings(d), f"{work}/index", int(CPUS) * copies)
    # hot columns and postings stay in memory, as a service would keep them: dealt by document, so that searches shuffle neither, and sorted by token
    index = spark.read.parquet(f"{work}/index").repartition(int(CPUS), "doc_id").sortWithinPartitions("field", "token").persist()
    narrow = d.drop("body").repartition(int(CPUS), "doc_id").persist()
    index.count()
    n_docs, took = narrow.count(), time.perf_counter() - began
    one = lambda **g: S.Search([S.Group(**g)])
    page = lambda search, sort="seeders": S.page(S.run(narrow, index, search, NOW), sort).select("doc_id", "name")
    return took, n_docs, {
        "search_empty_facets": lambda: S.facets(every := S.run(narrow, index, S.Search(), NOW), every, bucket(F.col("size"), NAME_SIZES, SIZE_LABELS), SIZE_LABELS, STATES),
        "search_common_word": lambda: page(one(words=["the"])),
        "search_two_words": lambda: page(one(words=["the", "with"])),
        "search_prefix": lambda: page(one(prefix="wor")),
        "search_phrase": lambda: page(one(phrases=["in the"])),
        "search_or": lambda: page(S.Search([S.Group(words=["der"]), S.Group(words=["que"])])),
        "search_size_seeders": lambda: page(S.Search([S.Group(words=["and"])], ranges={"size": (1000, 5000), "seeders": (10, None)})),
        "search_rare_word": lambda: page(one(words=["moron"])),
        "search_by_size": lambda: page(one(words=["of"]), "size"),
        "search_age_category": lambda: page(S.Search(categories=["fr"], ranges={"age": (None, 7_776_000)})),
        "autocomplete": lambda: S.suggest(index, narrow.filter("not deleted and not hidden"), "th"),
        "related": lambda: S.related(index, narrow.filter("not deleted and not hidden"), 2, n_docs),
    }


def timed(shapes: dict[str, Callable[[], DataFrame]]) -> dict[str, float]:
    """Median seconds of each; the first run isn't counted."""
    took = {}
    for name, make in shapes.items():
        times = []
        for _ in range(REPEATS + 1):
            began = time.perf_counter()
            make().toArrow()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    return took


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp()
    try:
        built, n_docs, shapes = search_shapes(spark, f"{work}/small", 1)
        took = timed(shapes | {name: (lambda f: lambda: f(spark, SF_DIR))(catalogue.queries()[name]) for name in OTHERS})
        total = sum(took.values())
        result = {"metric": "headline_queries_total", "value": round(total, 3), "unit": "sec", "with_index_build": round(total + built, 3), "queries": {"index_build": round(built, 4), **took}, "documents": n_docs, "sf": SF_DIR.rpartition("sf")[2], "cpus": int(CPUS), "repeats": REPEATS}
        if COPIES > 1:
            spark.catalog.clearCache()
            built, n_docs, shapes = search_shapes(spark, f"{work}/large", COPIES)
            result["large"] = {"documents": n_docs, "index_build": round(built, 4), **timed(shapes)}
        print(json.dumps(result))
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    main()
