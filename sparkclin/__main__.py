"""Command line: ``python -m sparkclin fp|tree|xml|json|snapshot|diff …``; files are resources or lists of elements."""

from __future__ import annotations

import argparse
import json
import sys

from sparkclin.fhirpath.interpreter import as_json, evaluate
from sparkclin.fhirpath.parser import parse, render
from sparkclin.operators.validation import differential, snapshot
from sparkclin.sources.formats import json_to_xml, xml_to_json


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="sparkclin")
    sub = top.add_subparsers(dest="command", required=True)
    for name, names in (("fp", ["expression", "file"]), ("tree", ["expression"]), ("xml", ["file"]), ("json", ["file"]), ("snapshot", ["base", "file"]), ("diff", ["base", "file"])):
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(n)
    a = top.parse_args(args)
    text = open(a.file).read() if "file" in a else ""
    if a.command == "fp":
        print(*[as_json(v) for v in evaluate(a.expression, xml_to_json(text) if text.lstrip().startswith("<") else text)], sep="\n")
    elif a.command == "tree":
        print(render(parse(a.expression)))
    elif a.command == "xml":
        print(json_to_xml(text))
    elif a.command == "json":
        print(xml_to_json(text))
    else:
        base = json.load(open(a.base))
        print(json.dumps((snapshot if a.command == "snapshot" else differential)(base, json.loads(text)), indent=2))


if __name__ == "__main__":
    main(sys.argv[1:])
