"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores (default 8).
Every query runs in full, with its result discarded by the `noop` sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wirelens.plans import catalog  # noqa: E402
from wirelens.session import build_session  # noqa: E402

HEADLINE = [
    "flows",
    "protocol_breakdown",
    "capture_summary",
    "top_ports",
    "syslog_entries",
    "window_features",
    "vertical_port_scan",
    "horizontal_port_scan",
    "syn_scan",
    "xmas_scan",
    "syn_flood",
    "udp_flood",
    "icmp_flood",
    "http_flood",
    "ssh_brute_force",
    "http_brute_force",
    "malicious_port",
    "beaconing",
    "data_exfiltration",
    "dns_tunneling_volume",
    "dns_tunneling_oversized_queries",
    "all_alerts",
    "threats",
    "anomalies",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="wirelens-bench-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        rows = catalog.QUERIES[name](spark, sf_dir)
        rows.write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("top_ports")  # start-up of the JVM and of code generation is not measured
    names = sys.argv[1:] or HEADLINE
    seconds = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
