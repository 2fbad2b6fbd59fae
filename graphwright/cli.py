"""Command line: transform, generate-config, list-rules.

    python -m graphwright.cli transform INPUT [-o FILE] [-c FILE] [--enable-rule R] [--disable-rule R]
        [--format json|yaml] [--indent N] [--rdf-format F] [--language L] [--profile P] [--verbose]
"""

from __future__ import annotations

import argparse
import sys

from graphwright.plans.config import RULES, Config, default_config
from graphwright.sources.sinks import save_document


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphwright", description="Ontologies to JSON Schema, on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("transform", help="compile an ontology")
    t.add_argument("input")
    t.add_argument("-o", "--output")
    t.add_argument("-c", "--config")
    t.add_argument("--enable-rule", action="append", default=[], metavar="RULE")
    t.add_argument("--disable-rule", action="append", default=[], metavar="RULE")
    t.add_argument("--format", choices=["json", "yaml"], default="json")
    t.add_argument("--indent", type=int, default=2)
    t.add_argument("--rdf-format", choices=["auto", "xml", "turtle", "n3", "nt", "json-ld"], default="auto")
    t.add_argument("--language", default="en")
    t.add_argument("--profile", choices=["parity", "documented"], default="parity")
    t.add_argument("--verbose", action="store_true")
    g = sub.add_parser("generate-config", help="write the default configuration")
    g.add_argument("output")
    sub.add_parser("list-rules", help="rules in the order in which they apply")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list-rules":
        print("\n".join(f"{name:26} {text}" for name, text in RULES.items()))
        return 0
    if a.command == "generate-config":
        Config(default_config()).to_file(a.output)
        return 0
    config = Config.from_file(a.config) if a.config else Config()
    for rule in a.enable_rule:
        config.enable(rule)
    for rule in a.disable_rule:
        config.disable(rule)
    for rule in ("labels_to_titles", "comments_to_descriptions"):
        config.set_option(rule, "language", a.language)
    from pyspark.sql import SparkSession

    from graphwright.operators.tbox import TBox, counts
    from graphwright.plans.compile import Engine
    from graphwright.sources.rdf import read_rdf

    spark = SparkSession.builder.getOrCreate()
    tbox = TBox.of(read_rdf(spark, a.input, None if a.rdf_format == "auto" else a.rdf_format))
    schema = Engine(config, a.profile).transform(tbox)
    if a.verbose:
        print(", ".join(f"{r['n']} {r['what']}" for r in counts(tbox).collect()), file=sys.stderr)
        print(f"{len(schema.get('definitions', {}))} definitions, rules: {', '.join(config.enabled_rules())}", file=sys.stderr)
    if a.format == "yaml":
        import yaml

        text = yaml.dump(schema, sort_keys=False, allow_unicode=True)
    else:
        text = save_document(schema, None, a.indent)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
