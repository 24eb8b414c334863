"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.  Shared fact tables are
built (and timed) first, so a query's figure is its own work.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = """
block_ids block_edges graph_summary jump_bypass chain_merge immediate_dominators natural_loops irreducible_units
exception_edges range_entries subtype_closure member_resolution override_pairs override_families unmet_obligations
family_renaming call_components reaching_definitions live_slots backward_slice type_bounds exception_propagation
duplicate_blocks line_lookup visible_locals original_line_map scope_free_names counter_class_names mapping_rows
artifact_precedence entry_directories import_table
""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from classlake.plans import QUERIES
    from classlake.plans.facts import facts

    only = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    f = facts(spark, sf)
    timed("facts", lambda: [x.count() for x in (f.edge, f.node, f.method, f.ref, f.up)])
    for name in only:
        timed(name, lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
