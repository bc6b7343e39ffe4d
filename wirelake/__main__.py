"""Entries of a capture file or of demo traffic as JSON lines.

    python -m wirelake --pcap-file traffic.pcap --filter 'status == error' --out entries
    python -m wirelake --demo 10000 --out entries
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.exporting import documents
from .operators.history import matching
from .session import prepare
from .sources.demo import demo_entries
from .wire import dissect, pcap


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="wirelake", description=__doc__.splitlines()[0])
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--pcap-file", help="capture file, or a folder or pattern of them")
    source.add_argument("--demo", type=int, metavar="N", help="N entries of synthetic traffic")
    p.add_argument("--demo-rps", type=int, default=25, help="synthetic entries per second")
    p.add_argument("--filter", default="", help="only entries that pass")
    p.add_argument("--no-redact", action="store_true", help="leave credentials as they are")
    p.add_argument("--out", required=True, help="folder for the JSON lines")
    a = p.parse_args(argv)
    spark = prepare(SparkSession.builder.appName("wirelake").getOrCreate())
    if a.pcap_file:
        entries = dissect.capture_entries(pcap.read_packets(spark, a.pcap_file), not a.no_redact)
    else:
        entries = demo_entries(spark, a.demo, a.demo_rps)
    documents(matching(entries, a.filter)).write.text(a.out)


if __name__ == "__main__":
    main()
