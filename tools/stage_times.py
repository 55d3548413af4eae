"""Per-stage wall time of one registered query, read from Spark's event log (no UI involved).

usage: python tools/stage_times.py <query> [sf_dir]
The event log goes to a fresh folder under /tmp; the longest stages are printed.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, ".")

from tsengine.plans.catalog import QUERIES  # noqa: E402
from tsengine.session import local_session  # noqa: E402


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="tsengine-eventlog-")
    spark = local_session(8, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false"})
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wall = time.perf_counter() - t0
    spark.stop()
    stages, jobs = {}, 0
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        if os.path.isdir(path) or path.endswith(".crc"):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    if "Completion Time" in info and "Submission Time" in info:
                        stages[info["Stage ID"]] = (info["Completion Time"] - info["Submission Time"], info["Number of Tasks"], info["Stage Name"][:90])
                elif ev.get("Event") == "SparkListenerJobStart":
                    jobs += 1
    print(f"{name}: second run {wall:.2f}s; jobs over both runs {jobs}, stages {len(stages)}")
    for sid, (ms, tasks, label) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:12]:
        print(f"  stage {sid:4d} {ms:6d} ms  tasks {tasks:4d}  {label}")


if __name__ == "__main__":
    main()
