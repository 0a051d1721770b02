"""Time the queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

Every query runs once to warm up and then BENCH_RUNS times, written to the
noop sink; the median counts. With BENCH_DUCKDB=1 the SQL twins are timed as
well. Queries that write tables or run streams time those steps too.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES, SQL  # noqa: E402
from tickloom.session import local_session  # noqa: E402

HEADLINE = (
    "hourly_average events_by_name_tags events_max_age events_latest_n latest_by_tag latest_by_tag_ties "
    "event_name_counts raw_event_page scalar_aggregates scalar_aggregates_ties shipment_aggregates series_fan_out "
    "interval_10m interval_hour interval_day interval_week interval_month interval_year line_gap_fill bar_gap_fill "
    "mutator_chain mutator_delta mutator_pct_change gauge_widget pie_widget scatter_widget table_slice_end "
    "table_unsliced table_top_k_choices view_summary retention_kept retention_deleted_counts run_stats query_stats "
    "store_appends retention_in_place stream_push stream_interval_hour "
    "parse_logs parse_logs_syslog skip_until_logs push_accept push_quarantine counter_rates sample_unpivot"
).split()


def timed(action) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")

    def spark_run(name):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        spark_run(name)
        seconds[name] = round(statistics.median(timed(lambda n=name: spark_run(n)) for _ in range(runs)), 3)
    report = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()

    if os.environ.get("BENCH_DUCKDB"):
        sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))
        import compare

        con = compare.connect(sf_dir)
        con.execute(f"SET threads = {cpus}")
        duck = {}
        for name in names:
            con.execute(SQL[name]).to_arrow_table()
            duck[name] = round(statistics.median(timed(lambda n=name: con.execute(SQL[n]).to_arrow_table()) for _ in range(runs)), 3)
        report["duckdb"] = duck
        report["duckdb_value"] = round(sum(duck.values()), 3)
    print(json.dumps(report))


if __name__ == "__main__":
    main()
