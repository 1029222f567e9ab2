"""Command line: index, sync, index-md, search, overview, read, eval, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tessera.engine import MAX_K, Engine


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("-C", "--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "sync", "index-md", "overview", "serve"):
        sub.add_parser(name)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--type")
    s.add_argument("--module")
    s.add_argument("--tags", default="")
    s.add_argument("-k", type=int)
    s.add_argument("--include-excluded", action="store_true")
    s.add_argument("--lexical", action="store_true")
    r = sub.add_parser("read")
    r.add_argument("path")
    r.add_argument("--section")
    e = sub.add_parser("eval")
    e.add_argument("goldenset")
    e.add_argument("-k", type=int)
    return p


def load_goldenset(path: str) -> list[dict]:
    """A YAML or JSON list of {question, expected}; the keys pregunta and esperado are read too."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        rows = json.loads(text)
    else:
        import yaml

        rows = yaml.safe_load(text)
    names = {"pregunta": "question", "esperado": "expected"}
    cases = [{names.get(k, k): v for k, v in r.items()} for r in rows] if isinstance(rows, list) and all(isinstance(r, dict) for r in rows) else None
    if not cases or any(not isinstance(c.get(n), str) for c in cases for n in ("question", "expected")):
        raise ValueError(f"{path}: a list of question and expected is needed")
    return cases


def serve(engine: Engine) -> None:
    """Requests {tool, arguments} as JSON lines on standard input, answers on standard output."""
    engine.scheduler.startup()
    tools = {"docs_overview": engine.docs_overview, "search_docs": engine.search_docs, "read_doc": engine.read_doc}
    for line in sys.stdin:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            own = request.get("arguments", {})
            if own.get("k") is not None and not 1 <= own["k"] <= MAX_K:
                raise ValueError(f"k must be from 1 to {MAX_K}")
            engine.scheduler.maybe_sync()
            answer = {"text": tools[request["tool"]](**own)}
        except Exception as e:
            answer = {"error": str(e)}
        print(json.dumps(answer, ensure_ascii=False), flush=True)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        engine = Engine(session(), args.root)
        for w in engine.warnings:
            print(f"WARNING {w}", file=sys.stderr)
        if args.command == "index":
            r = engine.index()
            print(f"Indexed: {r.documents} documents, {r.chunks} chunks ({r.mode})")
            for path, errors in r.skipped:
                print(f"WARNING {path}: {'; '.join(errors)}", file=sys.stderr)
        elif args.command == "sync":
            print("\n".join(engine.sync().lines()))
        elif args.command == "index-md":
            path, skipped, wrote = engine.index_md()
            print(f"{path}: {'written' if wrote else 'unchanged'}")
            for p, errors in skipped:
                print(f"WARNING {p}: {'; '.join(errors)}", file=sys.stderr)
        elif args.command == "search":
            print(engine.search_docs(args.query, args.type, args.module, [t for t in args.tags.split(",") if t], args.k, args.include_excluded, args.lexical))
        elif args.command == "overview":
            print(engine.docs_overview())
        elif args.command == "read":
            print(engine.read_doc(args.path, args.section))
        elif args.command == "eval":
            try:
                cases = load_goldenset(args.goldenset)
            except (OSError, ValueError) as e:
                print(e, file=sys.stderr)
                return 2
            for mode, s in engine.evaluate(cases, args.k).items():
                print(f"{mode}: cases {s['cases']}, recall@{args.k or engine.config.k} {s['recall_at_k']:.2f}, MRR {s['mrr']:.3f}, failures {s['failures']}")
        else:
            serve(engine)
    except Exception as e:
        print(f"ERROR {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
