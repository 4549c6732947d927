"""spark-submit entry point: ingest a data set and print its assets as JSON lines."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from .session import session
from .sources.datasets import ingest


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("dataset_path")
    p.add_argument("--format", default="auto")
    p.add_argument("--contributor-id", required=True)
    p.add_argument("--ledger")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--output", help="write the assets as Parquet instead")
    a = p.parse_args(argv)
    assets = ingest(session(), a.dataset_path, a.format, a.contributor_id, a.ledger, a.strict)
    if a.output:
        assets.write.parquet(a.output)
    else:
        for line in assets.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
