"""Time the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from headcount.plans.registry import queries
from headcount.session import local_session

HEADLINE = (
    "flt_response_profile",
    "flt_cross_classify",
    "prj_row_total",
    "prj_week_index",
    "join_lookup",
    "agg_tally2",
    "agg_freq_multi",
    "agg_describe",
    "agg_describe_by",
    "agg_describe_household",
    "agg_brief_by",
    "agg_share_within",
    "agg_missing",
    "agg_topk",
    "mix_f2f",
    "mix_total",
    "plot_box",
    "plot_hist_by",
    "mdl_table",
    "mdl_nb_null",
    "mdl_nb_uni",
    "mdl_nb_coef",
    "mdl_ols_coef",
    "mdl_lrt",
    "mdl_aic",
    "mdl_zinb_coef",
    "mdl_irr_zinb",
    "dist_nb",
    "dist_zinb",
    "dist_zero",
    "dist_compare_multi",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="headcount-bench")
    registered = queries()
    # Start the JVM's code paths once; a first query pays for class loading, not for its plan.
    registered["agg_describe_by"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        start = time.perf_counter()
        registered[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
