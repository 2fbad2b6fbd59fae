"""Validation of JSON instances against a compiled schema (draft-07).

Definitions of common keywords become one expression over the parsed instance,
which tells what is valid without leaving the JVM.  Everything else, and
whatever is not valid, goes to a validator in Python workers, which finds the
first error.  There is no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULTS = "type string, uri string, idx long, valid boolean, path string, error string"


def _is(kind: str, x) -> bool:
    if kind == "integer":
        return isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer()
    if kind == "number":
        return isinstance(x, (int, float)) and not isinstance(x, bool)
    return {"string": isinstance(x, str), "boolean": isinstance(x, bool), "object": isinstance(x, dict), "array": isinstance(x, list), "null": x is None}[kind]


def _same(a, b) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


class Validator:
    """Errors of a value as (path, message), in the order of the schema's keywords."""

    def __init__(self, root: dict) -> None:
        self.root = root

    def resolve(self, ref: str):
        at = self.root
        for step in ref.removeprefix("#").strip("/").split("/"):
            if step:
                step = step.replace("~1", "/").replace("~0", "~")
                if not isinstance(at, dict) or step not in at:
                    return None
                at = at[step]
        return at

    def errors(self, x, schema, path: tuple = ()) -> Iterator[tuple[tuple, str]]:
        if schema is True:
            return
        if schema is False:
            yield path, "nothing is allowed here"
            return
        if "$ref" in schema:  # draft-07: siblings of $ref do not count
            target = self.resolve(schema["$ref"])
            if target is None:
                yield path, f"unresolvable reference {schema['$ref']!r}"
            else:
                yield from self.errors(x, target, path)
            return
        for keyword, rule in schema.items():
            check = getattr(self, "_" + keyword.lstrip("$"), None)
            if check:
                yield from check(x, rule, schema, path)

    def ok(self, x, schema) -> bool:
        return next(self.errors(x, schema), None) is None

    def _type(self, x, rule, _, path):
        kinds = rule if isinstance(rule, list) else [rule]
        if not any(_is(k, x) for k in kinds):
            yield path, f"{json.dumps(x)[:80]} is not of type {', '.join(kinds)}"

    def _enum(self, x, rule, _, path):
        if not any(_same(x, y) for y in rule):
            yield path, f"{json.dumps(x)[:80]} is not one of {rule}"

    def _const(self, x, rule, _, path):
        if not _same(x, rule):
            yield path, f"{json.dumps(rule)[:80]} was expected"

    def _properties(self, x, rule, _, path):
        if isinstance(x, dict):
            for name, schema in rule.items():
                if name in x:
                    yield from self.errors(x[name], schema, (*path, name))

    def _required(self, x, rule, _, path):
        if isinstance(x, dict):
            for name in rule:
                if name not in x:
                    yield path, f"'{name}' is a required property"

    def _additionalProperties(self, x, rule, schema, path):  # noqa: N802
        if isinstance(x, dict):
            patterns = schema.get("patternProperties", {})
            for name in x:
                if name not in schema.get("properties", {}) and not any(re.search(p, name) for p in patterns):
                    if rule is False:
                        yield path, f"additional property '{name}' is not allowed"
                    else:
                        yield from self.errors(x[name], rule, (*path, name))

    def _items(self, x, rule, schema, path):
        if isinstance(x, list):
            for i, y in enumerate(x):
                one = rule if not isinstance(rule, list) else rule[i] if i < len(rule) else schema.get("additionalItems", True)
                yield from self.errors(y, one, (*path, i))

    def _contains(self, x, rule, _, path):
        if isinstance(x, list) and not any(self.ok(y, rule) for y in x):
            yield path, "no item matches 'contains'"

    def _bound(self, good: bool, path, text: str):
        if not good:
            yield path, text

    def _minItems(self, x, n, _, path):  # noqa: N802
        yield from self._bound(not isinstance(x, list) or len(x) >= n, path, f"fewer than {n} items")

    def _maxItems(self, x, n, _, path):  # noqa: N802
        yield from self._bound(not isinstance(x, list) or len(x) <= n, path, f"more than {n} items")

    def _uniqueItems(self, x, rule, _, path):  # noqa: N802
        if rule and isinstance(x, list):
            seen = {json.dumps(y, sort_keys=True) for y in x}
            yield from self._bound(len(seen) == len(x), path, "items are not unique")

    def _minLength(self, x, n, _, path):  # noqa: N802
        yield from self._bound(not isinstance(x, str) or len(x) >= n, path, f"shorter than {n}")

    def _maxLength(self, x, n, _, path):  # noqa: N802
        yield from self._bound(not isinstance(x, str) or len(x) <= n, path, f"longer than {n}")

    def _pattern(self, x, rule, _, path):
        yield from self._bound(not isinstance(x, str) or re.search(rule, x) is not None, path, f"does not match {rule!r}")

    def _minimum(self, x, n, _, path):
        yield from self._bound(not _is("number", x) or x >= n, path, f"{x} is less than the minimum of {n}")

    def _maximum(self, x, n, _, path):
        yield from self._bound(not _is("number", x) or x <= n, path, f"{x} is greater than the maximum of {n}")

    def _allOf(self, x, rule, _, path):  # noqa: N802
        for schema in rule:
            yield from self.errors(x, schema, path)

    def _anyOf(self, x, rule, _, path):  # noqa: N802
        if not any(self.ok(x, s) for s in rule):
            yield path, "matches no schema of anyOf"

    def _oneOf(self, x, rule, _, path):  # noqa: N802
        n = sum(self.ok(x, s) for s in rule)
        if n != 1:
            yield path, f"matches {n} schemas of oneOf"

    def _not(self, x, rule, _, path):
        if self.ok(x, rule):
            yield path, "matches the schema of 'not'"


def is_circular(definitions: dict, name: str, seen: frozenset = frozenset()) -> bool:
    """A property or its items refer straight to the type itself, or allOf comes back to it."""
    if name in seen:
        return True
    if name not in definitions:
        return False
    own = f"#/definitions/{name}"
    for p in definitions[name].get("properties", {}).values():
        if p.get("$ref") == own or isinstance(p.get("items"), dict) and p["items"].get("$ref") == own:
            return True
    return any(is_circular(definitions, x["$ref"].rsplit("/", 1)[-1], seen | {name}) for x in definitions[name].get("allOf", []) if "$ref" in x)


class Unsupported(Exception):
    """A schema that only the validator can judge."""


#: Keywords without effect on validity.
_NOTES = {"title", "description", "$comment", "$schema", "$id", "format", "default", "examples", "definitions"}
#: Schemas within one definition, references followed, that an expression is made of at most.
_MOST = 120


class _Expression:
    """Whether a variant is valid, as a Column that is never null."""

    def __init__(self, definitions: dict) -> None:
        self.definitions, self.left = definitions, _MOST

    @staticmethod
    def _at(x: Column, name: str) -> Column:
        if not re.fullmatch(r"[A-Za-z0-9_@ :-]+", name):
            raise Unsupported(name)
        return F.try_variant_get(x, f"$['{name}']", "variant")

    @staticmethod
    def _kind(x: Column, kind: str) -> Column:
        if kind in ("object", "array"):
            return F.try_variant_get(x, "$", "map<string,variant>" if kind == "object" else "array<variant>").isNotNull()
        of = F.schema_of_variant(x)
        if kind in ("string", "boolean", "null"):
            return of == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[kind]
        number = of.rlike("^(BIGINT|DECIMAL|DOUBLE)")
        if kind == "number":
            return number
        if kind == "integer":
            value = F.try_variant_get(x, "$", "double")
            return number & (value == F.floor(value))
        raise Unsupported(kind)

    def _equals(self, x: Column, value) -> Column:
        if isinstance(value, bool):
            return self._kind(x, "boolean") & (F.try_variant_get(x, "$", "boolean") == value)
        if isinstance(value, str):
            return self._kind(x, "string") & (F.try_variant_get(x, "$", "string") == value)
        raise Unsupported(repr(value))

    def valid(self, x: Column, schema) -> Column:
        self.left -= 1
        if self.left < 0:
            raise Unsupported("too large")
        if isinstance(schema, bool):
            return F.lit(schema)
        if "$ref" in schema:
            name = schema["$ref"].removeprefix("#/definitions/")
            if name not in self.definitions:
                raise Unsupported(schema["$ref"])
            return self.valid(x, self.definitions[name])
        tests = [test for k, rule in schema.items() if k not in _NOTES for test in self._tests(x, k, rule, schema)]
        return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))

    def _tests(self, x: Column, k: str, rule, schema: dict) -> list[Column]:
        both, either = (lambda a, b: a & b), (lambda a, b: a | b)
        if k == "type":
            return [reduce(either, [self._kind(x, t) for t in (rule if isinstance(rule, list) else [rule])])]
        if k == "enum" and rule:
            return [reduce(either, [self._equals(x, y) for y in rule])]
        if k == "const":
            return [self._equals(x, rule)]
        if k == "required":
            return [~self._kind(x, "object") | reduce(both, [self._at(x, n).isNotNull() for n in rule], F.lit(True))]
        if k == "properties":
            some = [(self._at(x, n), y) for n, y in rule.items()]
            return [~self._kind(x, "object") | reduce(both, [at.isNull() | self.valid(at, y) for at, y in some], F.lit(True))]
        if k == "additionalProperties" and rule is False and "patternProperties" not in schema:
            keys = F.map_keys(F.try_variant_get(x, "$", "map<string,variant>"))
            return [F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))) == 0, F.lit(True))]
        items = F.try_variant_get(x, "$", "array<variant>")
        if k == "items" and isinstance(rule, dict):
            return [items.isNull() | F.forall(items, lambda y: self.valid(y, rule))]
        if k in ("minItems", "maxItems"):
            return [items.isNull() | (F.size(items) >= rule if k == "minItems" else F.size(items) <= rule)]
        if k in ("minimum", "maximum") and abs(rule) < 2**53:
            value = F.try_variant_get(x, "$", "double")
            return [~self._kind(x, "number") | (value >= rule if k == "minimum" else value <= rule)]
        if k in ("minLength", "maxLength"):
            n = F.length(F.try_variant_get(x, "$", "string"))
            return [~self._kind(x, "string") | (n >= rule if k == "minLength" else n <= rule)]
        if k in ("allOf", "anyOf", "oneOf"):
            parts = [self.valid(x, y) for y in rule]
            return [reduce(both, parts, F.lit(True)) if k == "allOf" else reduce(either, parts, F.lit(False)) if k == "anyOf" else reduce(lambda a, b: a + b, [p.cast("int") for p in parts], F.lit(0)) == 1]
        if k == "not":
            return [~self.valid(x, rule)]
        if hasattr(Validator, "_" + k.lstrip("$")):
            raise Unsupported(k)
        return []


def surely_valid(schema: dict) -> Column:
    """Over type and obj: true only for instances that are valid; false for what the validator must look at."""
    out, definitions, parsed = F.lit(False), schema.get("definitions", {}), F.try_parse_json("obj")
    for name in definitions:
        if not is_circular(definitions, name):
            try:
                out = F.when(F.col("type") == name, _Expression(definitions).valid(parsed, definitions[name])).otherwise(out)
            except Unsupported:
                continue
    return F.coalesce(out, F.lit(False))


def validate(instances: DataFrame, schema: dict) -> DataFrame:
    """RESULTS of every instance (type, uri, idx, obj): its first error, if any.

    Types whose definitions are circular are skipped as valid, with a warning
    in `error`; types without definition fail.
    """
    definitions = schema.get("definitions", {})
    skipped = {n for n in definitions if is_circular(definitions, n)}
    root = {"definitions": definitions}

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        validator = Validator(root)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.type not in definitions:
                    found = ((), f"no definition of type '{r.type}'")
                elif r.type in skipped:
                    out.append((r.type, r.uri, r.idx, True, None, "warning: circular definition, not validated"))
                    continue
                else:
                    try:
                        found = next(validator.errors(json.loads(r.obj), definitions[r.type]), None)
                    except RecursionError:
                        out.append((r.type, r.uri, r.idx, True, None, "warning: too deep, not validated"))
                        continue
                path = None if found is None else ".".join(map(str, found[0]))
                out.append((r.type, r.uri, r.idx, found is None, path, None if found is None else found[1]))
            yield pd.DataFrame(out, columns=["type", "uri", "idx", "valid", "path", "error"])

    # an instance that is surely valid never leaves the JVM; exchanges below are reused by both branches
    quick = surely_valid(schema)
    named = instances.select("type", "uri", "idx", "obj")
    good = named.where(quick).select("type", "uri", "idx", F.lit(True).alias("valid"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("error"))
    rest = named.where(~quick).select("type", "uri", "idx", F.coalesce("obj", F.lit("null")).alias("obj"))
    return good.unionByName(rest.mapInPandas(f, RESULTS))


def summary(results: DataFrame) -> DataFrame:
    """One row: valid, total, validated, errors, warnings."""
    warned = F.startswith(F.col("error"), F.lit("warning:"))
    return results.agg(
        F.coalesce(F.bool_and("valid"), F.lit(True)).alias("valid"), F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("validated"),
        F.count_if(~F.col("valid")).alias("errors"), F.count_if(F.coalesce(warned, F.lit(False))).alias("warnings"),
    )


def summary_by_type(results: DataFrame) -> DataFrame:
    """type, total, validated, errors."""
    return results.groupBy("type").agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("validated"), F.count_if(~F.col("valid")).alias("errors"))


def report(results: DataFrame, most: int = 50) -> str:
    """Totals and the first errors."""
    s = summary(results).first()
    out = [f"JSON Schema validation: {'passed' if s['valid'] else 'failed'}", f"instances: {s['validated']} of {s['total']} valid, {s['errors']} errors, {s['warnings']} warnings"]
    for r in results.where(~F.col("valid")).orderBy("type", "idx").limit(most).collect():
        out.append(f"  {r['type']}[{r['idx']}] {r['path'] or '(root)'}: {r['error']}")
    return "\n".join(out) + "\n"


def spark_type(schema: dict, definitions: dict, depth: int = 4) -> T.DataType:
    """The Spark type of a JSON Schema, usable in from_json; references beyond `depth` are strings."""
    if "$ref" in schema:
        target = definitions.get(schema["$ref"].rsplit("/", 1)[-1], {})
        return spark_type(target, definitions, depth - 1) if depth > 0 else T.StringType()
    if "oneOf" in schema:
        return T.StructType([T.StructField("@id", T.StringType())])
    from graphwright.operators.instances import _properties_of

    if "allOf" in schema or schema.get("type") == "object":
        props = _properties_of(definitions, schema, True, frozenset())
        return T.StructType([T.StructField(n, spark_type(p, definitions, depth - 1)) for n, p in props.items()])
    if schema.get("type") == "array":
        return T.ArrayType(spark_type(schema.get("items", {}), definitions, depth - 1))
    return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(schema.get("type"), T.StringType())
