"""What a driver program wants around the queries: timings of stages, the machine's means, readiness, and phase reports."""

from __future__ import annotations

import argparse
import json
import os
import platform
import resource
import shutil
import sys
import time
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from framewright.functions.text import fingerprint, redacted


@dataclass
class Measured:
    """Wall and CPU seconds, and the driver's largest resident size, of each named stage."""

    stages: list[dict] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str):
        wall, cpu, failed = time.perf_counter(), time.process_time(), True
        try:
            yield
            failed = False
        finally:
            peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * (1 if sys.platform == "darwin" else 1024)
            self.stages.append({"stage": name, "wall_seconds": time.perf_counter() - wall, "cpu_seconds": time.process_time() - cpu, "rss_peak_bytes": peak, "failed": failed})

    def total(self) -> float:
        return sum(s["wall_seconds"] for s in self.stages)


def capabilities() -> dict:
    """The machine and a profile for it: QUALITY with a GPU and 16 GB, BALANCED with 8 GB and 4 CPUs, else LOW."""
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 1024**3
    cpus, gpu = os.cpu_count() or 1, shutil.which("nvidia-smi") is not None
    profile = "QUALITY" if gpu and memory >= 16 else "BALANCED" if memory >= 8 and cpus >= 4 else "LOW"
    return {"operating_system": platform.system(), "cpu_architecture": platform.machine(), "logical_cpu_count": cpus, "memory_gb": round(memory, 2), "gpu_available": gpu, "recommended_profile": profile}


def readiness(folder: str, tools: tuple[str, ...] = (), modules: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas"), min_free_bytes: int = 2 << 30) -> dict:
    """PASS, WARNING or FAIL of each thing that a run needs; ready if nothing required fails."""
    from importlib.util import find_spec

    checks = [{"name": "python", "status": "PASS" if sys.version_info >= (3, 11) else "FAIL"}]
    checks += [{"name": t, "status": "PASS" if shutil.which(t) else "FAIL"} for t in tools]
    checks += [{"name": m, "status": "PASS" if find_spec(m) else "FAIL"} for m in modules]
    writable = os.path.isdir(folder) and os.access(folder, os.W_OK)
    checks.append({"name": "storage", "status": "PASS" if writable else "FAIL"})
    free = shutil.disk_usage(folder).free if writable else 0
    checks.append({"name": "free_disk", "status": "PASS" if free >= min_free_bytes else "WARNING"})
    failures = [c["name"] for c in checks if c["status"] == "FAIL"]
    return {"ready": not failures, "checks": checks, "failures": failures, "warnings": [c["name"] for c in checks if c["status"] == "WARNING"]}


def config_snapshot(params, version: str, **more) -> dict:
    """The parameters without secrets, and a fingerprint that tells one configuration from another."""
    shown = redacted({**asdict(params), **more})
    return {"version": version, "config_fingerprint": fingerprint(shown), "parameters": shown}


#: Queries that make up the report of each phase.
REPORTS = {
    3: ("score_distribution", "event_stats", "timeline_stats", "timeline_quality", "example_event_times"),
    4: ("window_stats", "boundary_stats", "generation_stats", "ranking_stats", "phase4_quality"),
    5: ("raw_transcript_stats", "speech_stats", "alignment_stats", "context_stats", "phase5_quality"),
    6: ("model_input_stats", "temporal_context_stats", "analysis_stats", "decision_stats", "phase6_quality"),
    7: ("extraction_stats", "quality_stats", "fingerprint_stats", "pair_stats", "group_stats", "final_stats"),
    8: ("layout_stats",),
}


def report(spark, folder: str, phase: int, rows: int = 20) -> dict[str, list[dict]]:
    """The first rows by job of each of a phase's queries."""
    from framewright.queries import QUERIES

    out = {}
    for name in REPORTS[phase]:
        df = QUERIES[name](spark, folder)
        out[name] = [r.asDict(True) for r in df.orderBy(df.columns[0]).limit(rows).collect()]
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Print the report of a phase as JSON.")
    p.add_argument("phase", type=int, choices=sorted(REPORTS))
    p.add_argument("folder")
    p.add_argument("--rows", type=int, default=20)
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(report(spark, a.folder, a.phase, a.rows), default=str, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
