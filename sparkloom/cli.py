"""Command line: python -m sparkloom.cli COMMAND."""

from __future__ import annotations

import argparse
import json
import platform
import sys

from sparkloom import config as C
from sparkloom import project as P
from sparkloom import session
from sparkloom.errors import LoomError
from sparkloom.progress import Progress

VERSION = "0.1.0"
FORMATS = {"read": ["text", "markdown", "docx", "pdf (with PyMuPDF)"], "write": ["json", "jsonl", "csv"], "layouts": ["default", "openai_chat", "openai_legacy", "standard"]}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkloom", description="Question and answer datasets from documents, on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("process", help="make questions of a document or folder")
    p.add_argument("document")
    p.add_argument("-o", "--output", default="questions")
    p.add_argument("-f", "--format", choices=["json", "jsonl", "csv"])
    p.add_argument("-l", "--layout", choices=FORMATS["layouts"])
    p.add_argument("-c", "--config")
    p.add_argument("-p", "--project")
    p.add_argument("-r", "--run", help="a name under which a broken-off run is taken up again")
    p.add_argument("-m", "--master", default="local[*]")
    p.add_argument("-v", "--verbose", action="store_true")
    c = sub.add_parser("create-project", help="make a project's folders")
    c.add_argument("path", nargs="?", default=".")
    i = sub.add_parser("init-config", help="write a default configuration")
    i.add_argument("output", nargs="?", default="loom.yaml")
    sub.add_parser("interactive", help="ask for what is needed and run").add_argument("-m", "--master", default="local[*]")
    for name, text in (("formats", "formats and layouts"), ("info", "versions and the project"), ("version", "this version")):
        sub.add_parser(name, help=text)
    return top


def process(args: argparse.Namespace) -> dict:
    spark = session.build(args.master)
    project = P.Project(spark, args.project, C.load(args.config) if args.config else None)
    if args.verbose:
        project.progress = Progress.console()
    P.logger("DEBUG" if args.verbose else project.config.processing.log_level)
    result = project.process(args.document, args.run)
    path = project.save(result, args.output, args.format, args.layout)
    return {"output": path} | project.statistics(result)


def main(argv: list[str] | None = None, ask=input) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "process":
            print(json.dumps(process(args), indent=2))
        elif args.command == "interactive":
            given = parser().parse_args(["process", ask("Document or folder: "), "-o", ask("Output [questions]: ") or "questions", "-f", ask("Format [json]: ") or "json", "-m", args.master])
            print(json.dumps(process(given), indent=2))
        elif args.command == "create-project":
            print(P.create(args.path))
        elif args.command == "init-config":
            print(args.output if C.write_default(args.output) else f"{args.output} exists and was left as it is")
        elif args.command == "formats":
            print(json.dumps(FORMATS, indent=2))
        elif args.command == "info":
            import pyspark

            print(json.dumps({"version": VERSION, "python": platform.python_version(), "pyspark": pyspark.__version__, "project": str(P.find() or "")}, indent=2))
        else:
            print(VERSION)
        return 0
    except (LoomError, FileNotFoundError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
