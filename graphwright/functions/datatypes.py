"""XSD datatypes and their JSON Schema fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphwright.functions.vocab import XSD

#: JSON Schema of each XSD datatype (fixed values).
FRAGMENTS: dict[str, dict] = {
    "string": {"type": "string"},
    "boolean": {"type": "boolean"},
    "decimal": {"type": "number"},
    "float": {"type": "number"},
    "double": {"type": "number"},
    "integer": {"type": "integer"},
    "nonNegativeInteger": {"type": "integer", "minimum": 0},
    "positiveInteger": {"type": "integer", "minimum": 1},
    "nonPositiveInteger": {"type": "integer", "maximum": 0},
    "negativeInteger": {"type": "integer", "maximum": -1},
    "long": {"type": "integer"},
    "int": {"type": "integer"},
    "short": {"type": "integer"},
    "byte": {"type": "integer", "minimum": -128, "maximum": 127},
    "unsignedLong": {"type": "integer", "minimum": 0},
    "unsignedInt": {"type": "integer", "minimum": 0},
    "unsignedShort": {"type": "integer", "minimum": 0, "maximum": 65535},
    "unsignedByte": {"type": "integer", "minimum": 0, "maximum": 255},
    "date": {"type": "string", "format": "date"},
    "time": {"type": "string", "format": "time"},
    "dateTime": {"type": "string", "format": "date-time"},
    "duration": {"type": "string"},
    "anyURI": {"type": "string", "format": "uri"},
}

#: The datatypes that restriction fillers know; all other fillers are classes.
FILLERS = ("string", "integer", "decimal", "boolean", "date", "dateTime")

#: Spark types of literals by XSD datatype.
SPARK_TYPES = {
    "boolean": "boolean", "decimal": "decimal(38,18)", "float": "float", "double": "double", "integer": "decimal(38,0)",
    "nonNegativeInteger": "bigint", "positiveInteger": "bigint", "nonPositiveInteger": "bigint", "negativeInteger": "bigint",
    "long": "bigint", "int": "int", "short": "smallint", "byte": "tinyint", "unsignedLong": "decimal(20,0)", "unsignedInt": "bigint",
    "unsignedShort": "int", "unsignedByte": "smallint", "date": "date", "dateTime": "timestamp",
}


def local(uri: str) -> str:
    return uri.rsplit("#", 1)[-1] if "#" in uri else uri.rsplit("/", 1)[-1]


def fragment(uri: str | None) -> dict:
    """JSON Schema of a datatype property's range: by IRI, else by local name, else a string."""
    return dict(FRAGMENTS.get(local(uri), FRAGMENTS["string"])) if uri else dict(FRAGMENTS["string"])


def id_reference() -> dict:
    return {"type": "object", "properties": {"@id": {"type": "string", "format": "uri"}}, "required": ["@id"], "additionalProperties": False}


def object_reference(name: str | None) -> dict:
    """An object of the class, or a reference by @id."""
    return {"oneOf": [{"$ref": f"#/definitions/{name}"} if name else {"type": "object"}, id_reference()]}


def filler_reference(uri: str) -> dict:
    """What a restriction's filler allows: one of a few datatypes, or a class."""
    if uri.startswith(XSD) and local(uri) in FILLERS:
        return dict(FRAGMENTS[local(uri)])
    return object_reference(local(uri))


def fragment_table(spark: SparkSession) -> DataFrame:
    """datatype, json_type, format, minimum, maximum: the table as a DataFrame to join with."""
    rows = [(XSD + k, v["type"], v.get("format"), v.get("minimum"), v.get("maximum")) for k, v in FRAGMENTS.items()]
    return spark.createDataFrame(rows, "datatype string, json_type string, format string, minimum long, maximum long")
