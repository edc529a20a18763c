"""Command line: set get delete exists keys scan compact stats, and range, flush, compact-full."""

from __future__ import annotations

import argparse
import sys

from tideline.errors import StoreError
from tideline.session import build_session
from tideline.store import Stats, Store

DEFAULT_PATH = ".tideline"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tideline")
    p.add_argument("--path", default=DEFAULT_PATH)
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("set", ("key", "value")), ("get", ("key",)), ("delete", ("key",)), ("exists", ("key",)), ("keys", ()), ("scan", ()), ("flush", ()), ("compact", ()), ("compact-full", ()), ("stats", ())):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
    c = sub.add_parser("range")
    c.add_argument("--start")
    c.add_argument("--end")
    return p


def render(s: Stats) -> list[str]:
    """One `name = value` line for each figure."""
    figures = {
        "memtable.entries": s.memtable_entries,
        "memtable.bytes": s.memtable_bytes,
        "memtable.hits": s.memtable_hits,
        "log.bytes": s.wal_size,
        "files": s.sst_count,
        "files.bytes": s.total_sst_size,
        **{f"level.{x.level}.files": x.files for x in s.levels},
        "reads.files_skipped": s.bloom_rejects,
        "reads.files_read": s.block_reads,
        "compactions": s.compactions_completed,
        "compactions.full": s.full_compactions,
        "write_amplification": "none" if s.write_amplification is None else f"{s.write_amplification:.3f}",
    }
    return [f"{name} = {value}" for name, value in figures.items()]


def run(store: Store, a: argparse.Namespace) -> list[str]:
    """The lines that a command prints."""
    if a.command == "set":
        store.set(a.key, a.value)
        return ["OK"]
    if a.command == "get":
        value = store.get(a.key)
        return ["(null)" if value is None else value]
    if a.command == "delete":
        return ["OK" if store.delete(a.key) else "(null)"]
    if a.command == "exists":
        return ["true" if store.exists(a.key) else "false"]
    if a.command == "stats":
        return render(store.stats())
    {"flush": store.flush, "compact": store.compact, "compact-full": store.compact_full}[a.command]()
    return ["OK"]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session(a.master, 8)
    spark.sparkContext.setLogLevel("ERROR")
    try:
        with Store.open(spark, a.path) as store:
            if a.command == "keys":
                for r in store.keys().toLocalIterator():
                    print(r["key"])
            elif a.command in ("scan", "range"):
                rows = store.scan() if a.command == "scan" else store.range(a.start, a.end)
                for r in rows.toLocalIterator():
                    print(f"{r['key']}: {r['value']}")
            else:
                print("\n".join(run(store, a)))
    except StoreError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
