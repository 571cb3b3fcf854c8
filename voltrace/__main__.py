"""python -m voltrace VERB: the analyses as commands over a folder of tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from voltrace.plans import catalog

#: Verbs and the queries that they write, one folder each.
VERBS = {
    "data identity": ("name_normalize", "phrase_mentions", "resolve_margin", "rule_cascade_classify", "call_date_choice"),
    "data ingest": ("transcript_turns", "turns_speaker_summary", "join_rate_audit"),
    "data verify": ("range_validation", "manifest_hash"),
    "prices coverage": ("universe_full_outer", "price_coverage", "coverage_summary"),
    "prices crosscheck": ("return_crosscheck", "crosscheck_gate"),
    "targets build": ("realized_vol_targets", "target_reason_counts", "target_join_rate", "target_reconciliation"),
    "splits build": ("split_temporal_embargo", "split_ticker_disjoint", "split_combined", "split_report", "split_leakage_check"),
    "featurize sections": ("section_boundary", "chunk_greedy_pack", "boundary_snippets"),
    "featurize text": ("surface_stats_grouping_sets", "sentiment_cube", "embedding_pool_by_label", "content_hash_dedup"),
    "audio qc": ("audio_log_quality",),
    "evaluate": ("metric_grid", "spearman_by_quarter", "diebold_mariano_stat", "baseline_gate"),
    "evaluate-text": ("ridge_alpha_select", "mlp_head"),
    "evaluate-fusion": ("gated_fusion", "stacking"),
    "controls": ("shuffle_control", "identity_probe", "within_group_shuffle"),
    "grid": ("stage_grid_union", "per_year_breakdown", "holm_adjust"),
    "report": ("report_pivot",),
    "kappa": ("cohen_kappa", "cohen_kappa_linear", "pairwise_kappa", "kappa_gate"),
}
#: Queries that must give no finding: rows whose numbers must all be 0, or a column that must be true.
GATES = {"split_leakage_check": None, "crosscheck_gate": "passes", "kappa_gate": "passes", "baseline_gate": "passes"}


def passed(name: str, found: DataFrame) -> bool:
    row = found.first()
    return bool(row[GATES[name]]) if GATES[name] else not any(row)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="voltrace", description=__doc__)
    parser.add_argument("verb", nargs="+", help="one of: " + ", ".join([*VERBS, "run QUERY", "list"]))
    parser.add_argument("--tables", default=".", help="folder with the input tables as Parquet")
    parser.add_argument("--out", help="folder for the results; without it they are shown")
    given = parser.parse_args(args)
    verb = " ".join(given.verb)
    if verb == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    names = (given.verb[1],) if given.verb[0] == "run" and len(given.verb) == 2 else VERBS.get(verb)
    if names is None or any(n not in catalog.QUERIES for n in names):
        parser.error(f"unknown verb or query: {verb}")
    spark = spark or SparkSession.builder.appName("voltrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    failed = []
    for name in names:
        found = catalog.QUERIES[name](spark, given.tables)
        if given.out:
            found.write.mode("overwrite").parquet(f"{given.out}/{name}")
            found = spark.read.parquet(f"{given.out}/{name}")
        else:
            print(name)
            found.show(20, truncate=60)
        if name in GATES and not passed(name, found):
            failed.append(name)
    if failed:
        print("gates failed: " + ", ".join(failed), file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
