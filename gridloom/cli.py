"""Command line: ``python -m gridloom -q VERB -w WORKSPACE ...``; options can repeat where a verb takes lists."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .engine import Engine
from .schema import DEFAULT_CAPACITY, ArraySchema, Dimension, SchemaError

# Option letters and names; the options that each verb requires, and those it may have.
OPTIONS = {
    "A": "array-name", "a": "attribute-name", "c": "capacity", "C": "coordinate", "D": "dim-domain-bound", "d": "dim-name", "E": "expression", "e": "tile-extent",
    "f": "filename", "N": "number", "o": "order", "r": "range-bound", "R": "result-name", "t": "type", "w": "workspace",
}
VERBS = {
    "define_array": ("wAoadDt", "ec"), "load": ("wAf", ""), "update": ("wAf", ""), "subarray": ("wArR", ""), "filter": ("wAER", ""), "join": ("wAR", ""),
    "nearest_neighbors": ("wACNR", ""), "retile": ("wA", "oce"), "export_to_csv": ("wAf", ""), "clear_array": ("wA", ""), "delete_array": ("wA", ""),
}
_REPEATED = "AaCDderta"
ABOUT = {
    "define_array": "Registers an array: names, domain bounds (two for each dimension), types (one for each attribute, then the dimensions'), order; tile extents make its tiles regular, else they have a capacity.",
    "load": "Loads a CSV file or folder as an array's first batch.",
    "update": "Adds a CSV file or folder as a further batch: new cells, other values for cells, or deletions (all attributes $).",
    "subarray": "Stores the cells within closed ranges (two bounds for each dimension) as a new array.",
    "filter": "Stores the cells for which an expression over the attributes isn't zero as a new array.",
    "join": "Stores the cells that two arrays both have, with the attributes of both, as a new array.",
    "nearest_neighbors": "Stores the given number of cells nearest to a point as a new array.",
    "retile": "Gives an array another order, capacity or tile extents.",
    "export_to_csv": "Writes an array's cells in global order.",
    "clear_array": "Removes an array's cells and keeps its definition.",
    "delete_array": "Removes an array.",
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    parser.add_argument("-q", "--query", required=True, choices=[*VERBS, "help"])
    parser.add_argument("topic", nargs="?", choices=list(VERBS), help="with help: a verb to explain")
    for letter, name in OPTIONS.items():
        parser.add_argument(f"-{letter}", f"--{name}", dest=f"opt_{ord(letter)}", action="append")
    return parser


def parse(argv: list[str]) -> tuple[str, dict[str, list[str]]]:
    """(verb, values by option letter); extra, missing and wrongly repeated options are errors."""
    found = _parser().parse_args(argv)
    given = {x: v for x in OPTIONS if (v := getattr(found, f"opt_{ord(x)}")) is not None}
    if found.query == "help":
        return "help", {"topic": [found.topic]} if found.topic else {}
    required, optional = VERBS[found.query]
    if missing := [OPTIONS[x] for x in required if x not in given]:
        raise SchemaError(f"{found.query} needs {', '.join(missing)}")
    if extra := [OPTIONS[x] for x in given if x not in required + optional]:
        raise SchemaError(f"Redundant arguments: {', '.join(extra)}")
    if twice := [OPTIONS[x] for x, v in given.items() if len(v) > 1 and x not in _REPEATED]:
        raise SchemaError(f"{', '.join(twice)} can be given once")
    arrays = 2 if found.query == "join" else 1
    if len(given["A"]) != arrays:
        raise SchemaError(f"{found.query} takes {arrays} array name" + "s" * (arrays > 1))
    return found.query, given


def explain(verb: str) -> str:
    """What a verb does, and its options: those that it needs, and those it may have."""
    required, optional = VERBS[verb]
    lines = [f"{verb}: {ABOUT[verb]}"]
    for title, letters in (("needs", required), ("may have", optional)):
        lines += [f"  {title} -{x}, --{OPTIONS[x]}" + (" (can repeat)" if x in _REPEATED else "") for x in letters]
    return "\n".join(lines)


def _number(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        raise SchemaError(f"{text!r} is no number") from None
    return int(value) if value.is_integer() and "." not in text else value


def _schema(given: dict[str, list[str]]) -> ArraySchema:
    bounds, names, types = [_number(x) for x in given["D"]], given["d"], given["t"]
    if len(bounds) != 2 * len(names):
        raise SchemaError("there are two domain bounds for each dimension")
    if len(types) != len(given["a"]) + 1:
        raise SchemaError("there is a type for each attribute, and one for the dimensions")
    return ArraySchema(
        given["A"][0], tuple(Dimension(n, *b) for n, b in zip(names, zip(bounds[::2], bounds[1::2], strict=True), strict=True)), tuple(zip(given["a"], types[:-1], strict=True)), types[-1], given["o"][0],
        tuple(_number(x) for x in given.get("e", ())) or None, int(_number(given.get("c", [str(DEFAULT_CAPACITY)])[0])),
    )


def run(spark: SparkSession, argv: list[str]) -> str:
    """Does what the arguments say and returns the line to print."""
    verb, given = parse(argv)
    if verb == "help":
        return explain(*given["topic"]) if "topic" in given else _parser().format_help()
    began = time.perf_counter()
    engine, name = Engine(spark, given["w"][0]), given["A"][0]
    one = lambda x: given[x][0]
    numbers = lambda x: [_number(v) for v in given[x]]
    actions = {
        "define_array": lambda: engine.define_array(_schema(given)),
        "load": lambda: engine.load(name, one("f")),
        "update": lambda: engine.update(name, one("f")),
        "subarray": lambda: engine.subarray(name, numbers("r"), one("R")),
        "filter": lambda: engine.filter(name, one("E"), one("R")),
        "join": lambda: engine.join(*given["A"], one("R")),
        "nearest_neighbors": lambda: engine.nearest_neighbors(name, numbers("C"), int(_number(one("N"))), one("R")),
        "retile": lambda: engine.retile(name, capacity=int(_number(one("c"))) if "c" in given else None, order=one("o") if "o" in given else None, extents=numbers("e") if "e" in given else None),
        "export_to_csv": lambda: engine.export_to_csv(name, one("f"), one_file=True),
        "clear_array": lambda: engine.clear_array(name),
        "delete_array": lambda: engine.delete_array(name),
    }
    actions[verb]()
    return f"{verb} of {' and '.join(given['A'])}: done in {time.perf_counter() - began:.2f} s"


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    try:
        print(run(spark, sys.argv[1:] if argv is None else argv))
    except SchemaError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0
