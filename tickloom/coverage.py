"""Writes COVERAGE.md: inventory id to query names."""

from __future__ import annotations

import re

# ids covered by functions and tests rather than by a query of their own
BY_TEST = {
    "S-10": "readers.read_table", "S-11": "sinks.write_parquet, test_stream_bars_and_snapshot_sink", "R-2": "streams.snapshot_sink, test_stream_bars_and_snapshot_sink",
    "T-10": "evidence.chunk_items, test_chunks_stay_in_budget",
}


def main() -> None:
    from tickloom.plans.catalogue import COVERS, oracle_texts

    sql = oracle_texts()
    ids: dict[str, list[str]] = {}
    for name, text in COVERS.items():
        for i in text.split():
            ids.setdefault(i, []).append(name + ("" if name in sql else " (rows only)"))
    for i, what in BY_TEST.items():
        ids.setdefault(i, []).append(what)
    key = lambda i: (re.match(r"[A-Z]+", i).group(), int(re.search(r"\d+", i).group()))
    lines = ["# Coverage", "", "| Id | Queries or functions |", "|---|---|"]
    lines += [f"| {i} | {', '.join(ids[i])} |" for i in sorted(ids, key=key)]
    with open("COVERAGE.md", "w") as f:
        f.write("\n".join(lines) + "\n")
    print(len(COVERS), "queries,", len(sql), "with SQL,", len(ids), "ids")


if __name__ == "__main__":
    main()
