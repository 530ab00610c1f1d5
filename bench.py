"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose the tables, the cores and the
number of timed runs per query (the median is reported, after one warm-up).
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from probity.plans import load_registry  # noqa: E402
from probity.session import local_session  # noqa: E402

HEADLINE = (
    "fairness_report", "fairness_custom_rules", "fairness_group_metrics",
    "profile_lineitem", "profile_all_tables", "top_values_orders",
    "encode_first_appearance", "stratified_split",
    "pii_report_documents", "pii_pattern_hits", "hipaa_report_documents",
    "k_anonymity_lineitem", "k_anonymity_configs", "l_diversity", "dp_laplace_noise", "anonymised_price_bins",
    "privacy_checks",
    "trace_matrix", "trace_summary", "trace_root_causes", "trace_behaviour_patterns",
    "history_suites", "history_compare_runs", "report_suites", "report_recommendations", "remediation_steps",
    "audit_report", "audit_breakdown", "model_lineage", "project_counts",
    "elicit_dataset_checks", "elicit_model_checks", "template_requirements",
    "score_linear", "score_python_model", "shap_linear_importance", "shap_any_model", "explain_local_surrogates",
    "audit_suite_rows",
)


def main():
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("probity-bench", cpus, partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_registry().QUERIES
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, directory).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 4)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(directory.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
