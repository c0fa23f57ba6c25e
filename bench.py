"""Benchmark: run the headline queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and print one JSON line.

Each query is run to completion through the ``noop`` sink (every row is
produced, nothing is collected to the driver). ``BENCH_ALL=1`` times every
registered query instead of the headline set.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "q03_sales_by_region_total", "q01_monthly_sales_profit", "q05_sales_by_nation", "q06_loss_nations",
    "q09_customer_order_value", "q18_product_region_spread", "q23_order_gaps", "q25_ship_delay",
    "q48_region_type_popularity", "st1_welch_t_sales_asia_europe", "st3_chi_square_region_type",
    "a1_describe_quantity", "a7_quantiles_price", "a9_argmax_first", "a14_value_counts_pct",
    "j2_join_left", "j7_anti_unlabelled", "n4_ffill_by_user", "w5_top_orders", "w6_lag_previous_order",
    "u4_set_symmetric_difference", "u_array_set_ops", "k1_list_methods", "x2_column_reduce",
    "t1_text_profile", "t17_char_frequency", "r1_findall_counts", "r10_strip_punct",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("TMPDIR", tempfile.mkdtemp(prefix="gridwork-bench-"))
    from gridwork import get_session
    from gridwork.plans.registry import QUERIES, load_all

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)), app_name="gridwork-bench")
    load_all()
    names = sorted(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    # Warm-up (not timed, not headline queries): JIT-compile the scan, join,
    # aggregate and decimal code paths once, as on a long-running cluster.
    for warm in ("m2_shape", "j1_join_inner", "e1_arithmetic", "q17_repeat_buyers"):
        QUERIES[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "n_queries": len(times)}))


if __name__ == "__main__":
    main()
