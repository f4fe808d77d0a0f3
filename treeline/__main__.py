"""Command line: ``python -m treeline COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from .plans import api, selfcheck
from .plans.fixture_dir import demo
from .plans.repository import Repository, RepositoryError


def session() -> SparkSession:
    found = SparkSession.builder.appName("treeline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    return found


def local_time(timestamp: float) -> str:
    return time.strftime("%Y-%m-%d %H:%M", time.localtime(timestamp))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="treeline")
    top.add_argument("--repo", help="repository folder; else the nearest .vault upwards")
    top.add_argument("--lock-timeout", type=float, default=30.0, help="seconds to wait for another writer")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, flags: tuple[str, ...] = ()) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a.rstrip("?"), **({"nargs": "?"} if a.endswith("?") else {}))
        for f in flags:
            p.add_argument(f"--{f}", action="store_true")
        p.add_argument("--json", action="store_true")
        return p

    command("init")
    command("snapshot", "folder").add_argument("-m", "--message", default="")
    timed = command("benchmark")
    for name, usual in (("objects", 3000), ("reads", 1000), ("versions", 5)):
        timed.add_argument(f"--{name}", type=int, default=usual)
    command("stress-test").add_argument("--processes", type=int, default=4)
    for name, args, flags in (
        ("snapshot-rm", ["id"], ()), ("list", [], ()), ("diff", ["a", "b"], ()), ("restore", ["ref", "folder"], ("preview", "yes")), ("verify", [], ()), ("recover-check", ["ref"], ()), ("gc", [], ()),
        ("trace", ["hash"], ()), ("info", ["ref"], ()), ("pack", ["name?"], ()), ("log", ["path"], ()), ("status", [], ("deep",)), ("explain", ["ref"], ()), ("show", ["ref"], ()), ("tag", ["name", "ref"], ()), ("demo", ["folder"], ()), ("serve", [], ()),
    ):
        command(name, *args, flags=flags)
    return top


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[int, object]:
    c = args.command
    if c == "demo":
        return 0, {"files": demo(args.folder)}
    if c == "benchmark":
        return 0, selfcheck.benchmark(spark, args.objects, args.reads, args.versions)
    if c == "stress-test":
        found = selfcheck.stress_test(spark, args.processes)
        return int(not found["passed"]), found
    path = args.repo or (os.path.join(os.getcwd(), ".vault") if c == "init" else Repository.find(os.getcwd()))
    if c == "init":
        return 0, {"repository": Repository.init(spark, path).path}
    if path is None:
        raise RepositoryError("no repository here or above")
    repo = Repository(spark, path, args.lock_timeout)
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    if c == "snapshot":
        return 0, repo.snapshot(args.folder, args.message)
    if c == "snapshot-rm":
        return 0, repo.remove(int(args.id))
    if c == "list":
        return 0, [{**r, "time": local_time(r["timestamp"])} for r in repo.list()]
    if c == "diff":
        return 0, api.diff_json(repo, args.a, args.b)
    if c == "restore":
        if args.preview:
            return 0, rows(repo.preview(args.ref, args.folder).orderBy("path"))
        if not args.yes and input("Type RESTORE to write: ") != "RESTORE":
            return 1, {"error": "not confirmed"}
        return 0, {"written": repo.restore(args.ref, args.folder)}
    if c == "verify":
        found = api.verify_json(repo)
        return int(found["result"] != "ok"), found
    if c == "recover-check":
        report, issues = repo.recover_check(args.ref)
        return int(not report["recoverable"]), {**report, "issues": issues}
    if c == "gc":
        return 0, repo.gc()
    if c == "trace":
        return 0, repo.trace(args.hash)
    if c in ("info", "show"):
        record = repo.load(repo.resolve(args.ref))
        return 0, record if c == "info" else {**record, "entries": rows(repo.show(record["id"]))}
    if c == "pack":
        return 0, repo.pack(args.name)
    if c == "log":
        found = repo.log(args.path)
        return 0, {**found, "entries": [{**e, "time": local_time(e["timestamp"])} for e in found["entries"]]}
    if c == "status":
        return 0, repo.status(args.deep)
    if c == "explain":
        return 0, repo.explain(args.ref)
    if c == "tag":
        return 0, repo.tag(args.name, repo.resolve(args.ref))
    server = api.serve(repo)
    print(f"http://127.0.0.1:{server.server_port}/", flush=True)
    server.serve_forever()
    return 0, None


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        code, body = run(args, session())
    except (RepositoryError, TimeoutError, RecursionError) as error:
        code, body = 1, {"error": str(error)}
    print(json.dumps(body, sort_keys=True, indent=2, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
