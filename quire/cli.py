"""The command line: one verb a call, or a prompt without one.  Exit code 0: something found, 1: nothing, 2: misuse or no index."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from quire.bench_search import measure
from quire.engine import Engine, load_session, pick, save_session
from quire.lifecycle import Store, newest, order_key, read_lock, remote_tags
from quire.plans import dsl
from quire.plans.filters import Filters
from quire.serve import passage
from quire.sources.corpus import CorpusError, NoIndex

VERBS = "search verify get read cite catalog info build serve completion bench fetch releases use pull current gc prune".split()

#: What each shell reads to complete the first word.
COMPLETIONS = {
    "bash": "complete -W '{verbs}' quire",
    "fish": "complete -c quire -f -n __fish_use_subcommand -a '{verbs}'",
    "zsh": "#compdef quire\ncompadd -- {verbs}",
}


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    for flag in ("--json", "--explain", "--plain", "--copy"):
        shared.add_argument(flag, action="store_true")
    shared.add_argument("--mode")
    shared.add_argument("--canon")
    for flag, name in (("--author", "authors"), ("--type", "types"), ("--work", "works"), ("--title", "titles")):
        shared.add_argument(flag, dest=name, action="append", default=[])
    shared.add_argument("--script", choices=("s", "t"))
    shared.add_argument("--save", choices=("last",))
    shared.add_argument("--from", dest="source", choices=("last",))
    shared.add_argument("--index", type=int)
    shared.add_argument("--root", default=os.environ.get("QUIRE_ROOT", "index"), help="folder of the built indexes")
    top = argparse.ArgumentParser(prog="quire")
    verbs = top.add_subparsers(dest="verb")
    add = lambda name, *args: [sub := verbs.add_parser(name, parents=[shared]), *[sub.add_argument(a, **k) for a, k in args]][0]
    add("search", ("query", {"nargs": "?"}))
    add("verify", ("quote", {}))
    add("get", ("line_id", {"nargs": "?"}), ("-C", {"dest": "context", "type": int, "default": 0}))
    add("read", ("work_id", {}), ("juan", {"type": int}))
    add("cite", ("line_id", {"nargs": "?"}))
    add("catalog")
    add("info")
    add("build", ("--corpus", {"required": True}), ("--scope", {"required": True}), ("--golden", {}))
    add("serve", ("--http", {"metavar": "HOST:PORT"}), ("--allow-remote", {"action": "store_true"}))
    add("completion", ("shell", {"nargs": "?", "choices": sorted(COMPLETIONS), "default": "bash"}))
    add("bench", ("queries", {"nargs": "*"}), ("--samples", {"type": int, "default": 50}))
    add("fetch", ("tag", {}), ("--path", {"required": True}))
    add("releases", ("--remote", {}), ("--lock", {}))
    add("use", ("tag", {}))
    add("pull", ("--lock", {"required": True}))
    add("current")
    for name in ("gc", "prune"):
        add(name, ("tags", {"nargs": "*"}), ("--dry-run", {"action": "store_true"}))
    return top


def _filters(args: argparse.Namespace) -> Filters:
    return Filters(canons=(args.canon,) if args.canon else (), works=tuple(args.works), authors=tuple(args.authors), types=tuple(args.types), titles=tuple(args.titles))


def _show(args: argparse.Namespace, hits: list[dict]) -> None:
    if args.json:
        print(json.dumps({"hits": hits}, ensure_ascii=False))
    elif args.copy:
        for h in hits:
            print(f"{h['line_id']} {h['title']}卷{h['juan']}：{h['text_raw']}\n{h['citation']}")
    else:
        for rank, h in enumerate(hits, 1):
            print(f"{rank:>3} {h['line_id']} {h['title']} {h['text_raw']} {h['citation']}")


def _asked(engine: Engine, args: argparse.Namespace) -> int:
    if args.verb == "search" and args.source != "last":
        parsed = engine.parse(args.query or "", args.mode)
        if args.explain:
            print(json.dumps(asdict(parsed), ensure_ascii=False) if args.json else f"mode={parsed.mode} terms={list(parsed.terms)} within={parsed.within_chars} ordered={parsed.ordered}")
            return 0
        found = engine.search(parsed, _filters(args))
        hits = [r.asDict() for r in found.collect()]
        if args.save:
            save_session(engine, args.root, args.query or "", _filters(args), hits)
        colour = sys.stdout.isatty() and not (args.plain or args.json or args.copy)
        if hits and (colour or args.script == "s"):
            view = engine.shown(engine.spark.createDataFrame(hits, found.schema), args.script)
            hits = [r.asDict() for r in (engine.marked(view, parsed.terms) if colour else view).collect()]
        _show(args, hits)
        return 0 if hits else 1
    if args.verb == "verify":
        report = vars(engine.verify(args.quote))
        print(json.dumps(report, ensure_ascii=False) if args.json else ("original: " + report["exact_hit"]["line_id"] if report["is_original"] else "not original; closest: " + ", ".join(h["line_id"] for h in report["similar"])))
        return 0
    if args.verb in ("search", "get", "cite"):
        line_id = getattr(args, "line_id", None)
        if args.source == "last":
            line_id = pick(load_session(engine, args.root)["hits"], args.index or 1)["line_id"]
        if not line_id:
            raise dsl.ParseError("a line id is needed")
        if args.verb == "cite":
            cited = engine.cite(line_id)
            print(cited or "")
            return 0 if cited else 1
        rows = sorted((r.asDict() for r in engine.get(line_id, getattr(args, "context", 0)).collect()), key=lambda r: r["line_id"])
        if args.json and args.verb == "get":
            found = passage(rows)
            print(json.dumps(found if args.context else {"hit": found["hit"]}, ensure_ascii=False))
        else:
            _show(args, rows)
        return 0 if rows else 1
    if args.verb == "read":
        rows = [r.asDict() for r in engine.read(args.work_id, args.juan).collect()]
        _show(args, rows)
        return 0 if rows else 1
    if args.verb == "catalog":
        rows = [r.asDict() for r in engine.entries(_filters(args)).collect()]
        print(json.dumps({"entries": rows}, ensure_ascii=False) if args.json else "\n".join(f"{r['work_id']} {r['title']} {r['author']}" for r in rows))
        return 0 if rows else 1
    if args.verb == "info":
        print(json.dumps(engine.info(), ensure_ascii=False))
        return 0
    print(json.dumps({q: measure(engine, q, samples=args.samples) for q in args.queries}))
    return 0


def prompt(engine: Engine, root: str, source=None) -> int:
    """A bare line searches and is saved; :scope :open N :copy N :verify TEXT :q."""
    for line in source or sys.stdin:
        verb, _, rest = line.strip().partition(" ")
        try:
            if verb == ":q":
                break
            if verb == ":scope":
                print(engine.info()["artifact_id"])
            elif verb in (":open", ":copy"):
                hit = pick(load_session(engine, root)["hits"], int(rest or 1))
                print(f"{hit['line_id']} {hit['title']}卷{hit['juan']}：{hit['text_raw']}\n{hit['citation']}" if verb == ":copy" else hit["text_raw"])
            elif verb == ":verify":
                print("original" if engine.verify(rest).is_original else "not original")
            elif line.strip():
                hits = [r.asDict() for r in engine.search(line.strip()).collect()]
                save_session(engine, root, line.strip(), Filters(), hits)
                _show(argparse.Namespace(json=False, copy=False), hits)
        except (dsl.ParseError, CorpusError, ValueError) as problem:
            print(problem, file=sys.stderr)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in VERBS and not argv[0].startswith("-"):
        argv = ["search", *argv]
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0) and 2
    try:
        if args.verb == "completion":
            print(COMPLETIONS[args.shell].format(verbs=" ".join(VERBS)))
            return 0
        if args.verb in ("fetch", "releases", "use", "pull", "current", "gc", "prune"):
            return _lifecycle(args)
        spark = spark or SparkSession.builder.appName("quire").getOrCreate()
        if args.verb == "build":
            from quire.operators.build import build

            print(build(spark, args.corpus, args.scope, args.root, args.golden))
            return 0
        engine = Engine.open(spark, args.root if args.verb else os.environ.get("QUIRE_ROOT", "index"))
        if args.verb is None:
            return prompt(engine, os.environ.get("QUIRE_ROOT", "index"))
        if args.verb == "serve":
            from quire import serve

            if args.http:
                host, _, port = args.http.rpartition(":")
                serve.server(engine, host=host, port=int(port), allow_remote=args.allow_remote).serve_forever()
            else:
                serve.serve_stdio(engine)
            return 0
        return _asked(engine, args)
    except NoIndex as problem:
        print(f"{problem}; build one with: quire build --corpus DIR --scope NAME", file=sys.stderr)
        return 2
    except (dsl.ParseError, CorpusError, ValueError, OSError) as problem:
        print(problem, file=sys.stderr)
        return 2


def _lifecycle(args: argparse.Namespace) -> int:
    store = Store(args.root)
    if args.verb == "fetch":
        print(store.fetch(args.tag, args.path))
    elif args.verb == "use":
        print(store.use(newest(store.tags()) if args.tag == "latest" else args.tag))
    elif args.verb == "current":
        print(store.current() or "")
        return 0 if store.current() else 1
    elif args.verb == "pull":
        told = store.pull(read_lock(args.lock))
        print(" ".join(f"{k}={v}" for k, v in told.items()))
    elif args.verb in ("gc", "prune"):
        print("\n".join(store.prune(args.tags or None, args.dry_run)))
    else:
        known = remote_tags(args.remote) if args.remote else read_lock(args.lock) if args.lock else store.tags()
        for tag in sorted(known, key=lambda t: (order_key(t), t)):
            print(tag + (" *" if tag == store.current() else ""))
    return 0


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    sys.exit(main())
