"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "g1_bill_summary", "g2_vote_coverage", "g3_member_activity", "s1_search_index", "t2_bill_directory_page",
    "j1_vote_directory", "j3_ballot_group_on_vote_date", "j13_party_window_summary", "g10_choice_breakdown",
    "t5_member_directory_by_absent", "w3_career_segments", "r8_composition_seats", "r6_vote_group_alignment",
    "x3_document_sections", "x6_section_diff", "x9_text_health", "j22_roster_reconciliation", "j24_vote_bill_candidates",
    "j25_bills_named_in_text", "g23_duplicate_identifiers", "r3_scored_names", "r12_health_queue_issues",
]


def main() -> None:
    from annalist.session import local_session
    from annalist.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "annalist-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.spark_queries()
    # one untimed pass over a small query, so that the first one does not pay for the start
    queries["j34_counts_of_two_sources"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
