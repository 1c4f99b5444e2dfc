"""Headline timings; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from secstream.operators import ingest as G  # noqa: E402
from secstream.operators import lake as L  # noqa: E402
from secstream.operators import scoring as V  # noqa: E402
from secstream.operators.alerts import alert_positions  # noqa: E402
from secstream.operators.risk import risk_scores, scored_firings  # noqa: E402
from secstream.operators.sequence import baseline_deviation, impossible_travel, session_hijack  # noqa: E402
from secstream.operators.threshold import threshold_alerts  # noqa: E402
from secstream.plans.queries import TOLERANCE, WEEKLY, WINDOW, _scratch, all_queries, lab  # noqa: E402
from secstream.session import local_session, materialise  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    x = lab(spark, SF_DIR)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    # Inputs are laid down before the clock starts, as a broker or a lake would hold them.
    messages = materialise(x.messages, "messages")
    events = materialise(x.ev, "events")
    alerts = x.alerts
    response = x.response
    archive = x.archive
    named = all_queries()
    day = events.agg(F.date_sub(F.to_date(F.max("ts")), 1)).first()[0]
    split = f"{_scratch(spark)}/split"
    L.write_days(events, split, rows_per_file=50)  # compaction alone is timed: the day lies in many files
    jobs = {
        "ingest": lambda: drain(G.ingest_batch(messages).good),
        "threshold_rules": lambda: drain(threshold_alerts(events.drop("labels", "raw"), WEEKLY)),
        "sequence_detections": lambda: [drain(d) for d in (impossible_travel(events), session_hijack(events), baseline_deviation(events, x.history))],
        "user_baseline": lambda: drain(named["user_baseline"](spark, SF_DIR)),
        "fold_and_risk": lambda: drain(risk_scores(scored_firings(materialise(alert_positions(alerts), "positions")))),
        "score_match": lambda: drain(V.matched_alerts(events, response.stored, x.now, WINDOW, TOLERANCE)),
        "archive_days": lambda: L.write_days(events, f"{_scratch(spark)}/bench"),
        "schema_conformance": lambda: drain(named["schema_conformance"](spark, SF_DIR)),
        "daily_maintenance": lambda: drain(named["daily_maintenance"](spark, SF_DIR)),
        "compact_day": lambda: L.compact_day(spark, split, day),
        "brute_force_hunt": lambda: drain(named["brute_force_hunt"](spark, SF_DIR)),
        "noisy_sources": lambda: drain(named["noisy_sources"](spark, SF_DIR)),
        "scan_full": lambda: archive.agg(F.count("*")).collect(),
        "scan_pruned": lambda: archive.filter(L.day_between(day, day)).agg(F.count("*")).collect(),
        "scan_by_time": lambda: archive.filter(F.to_date("ts") == F.lit(day)).agg(F.count("*")).collect(),
    }
    times = {}
    for name, job in jobs.items():
        best = None
        for _ in range(1 if name == "compact_day" else 2):
            began = time.perf_counter()
            job()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    rows = messages.count()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline jobs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "ingest_messages_per_sec": round(rows / times["ingest"]),
                "events": events.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
