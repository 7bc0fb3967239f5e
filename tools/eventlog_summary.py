"""Summarise a Spark event log (job and stage wall times) from a scratch folder.

usage: python tools/eventlog_summary.py <event-log-dir>
"""

from __future__ import annotations

import glob
import io
import json
import sys

import zstandard


def _lines(path: str):
    if path.endswith(".zstd"):
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main(root: str) -> None:
    files = sorted(glob.glob(f"{root}/**/events_*", recursive=True))
    jobs, stages = {}, {}
    for f in files:
        for line in _lines(f):
            e = json.loads(line)
            kind = e["Event"]
            if kind == "SparkListenerJobStart":
                jobs[e["Job ID"]] = [e["Submission Time"], None, len(e["Stage IDs"])]
            elif kind == "SparkListenerJobEnd":
                jobs[e["Job ID"]][1] = e["Completion Time"]
            elif kind == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                stages[si["Stage ID"]] = (si["Stage Name"][:60], si["Number of Tasks"],
                                          si.get("Completion Time", 0) - si.get("Submission Time", 0))
    t0 = min(v[0] for v in jobs.values())
    for j, (s, end, n) in sorted(jobs.items()):
        print(f"job {j:4d} start {s - t0:7d}ms dur {(end or s) - s:6d}ms stages {n}")
    print(f"{len(stages)} stages, sum of stage time {sum(v[2] for v in stages.values())}ms")
    for k, v in sorted(stages.items()):
        print(k, v)


if __name__ == "__main__":
    main(sys.argv[1])
