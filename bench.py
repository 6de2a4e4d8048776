"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "c01_get_contacts",
    "c06_bin_size",
    "j01_fill_empty_contacts",
    "j03_intersect_intervals",
    "j07_nearest_peaks",
    "j09_orient_peaks",
    "j10_flag_loops",
    "a02_coverage_normalize",
    "a03_balanced_sample",
    "a05_observed_over_expected",
    "a15_triangle_track",
    "f03_chipseq_binned",
    "f04_chipseq_small",
    "f06_eigenvector_small",
    "f07_site_orientation",
    "f14_assemble_features",
    "r01_delete_contacts",
    "r13_ectopic_scores",
    "r14_permutation_test",
    "f13_anchor_sequence_arrays",
    "m02_predict_transformed",
    "v02_smoothing",
    "v03_scc",
    "v04_band_errors",
    "v08_downsample_normalized",
]


def main() -> None:
    from contactloom.plans import catalog
    from contactloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cores, shuffle_partitions=cores)

    def run(name: str) -> float:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("c03_position_range")  # starts the executor threads and the code generator
    seconds = {name: run(name) for name in names}
    total = round(sum(seconds.values()), 3)
    result = {"metric": "total_wall_time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}
    if "f14_assemble_features" in seconds:
        # contacts with a full feature row per second, the measure the reference publishes
        rows = catalog.QUERIES["f12_is_loop"](spark, sf_dir).count()
        result["feature_rows"] = rows
        result["feature_rows_per_sec"] = round(rows / seconds["f14_assemble_features"], 1)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
