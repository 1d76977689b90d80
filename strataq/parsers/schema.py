"""What the unified JSON of each file type holds: validation, tables of fields, suggestions for a query's field."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tree import FIELDS, REQUIRED

ATTRIBUTES = {
    "function": ("visibility", "signature", "docstring", "parameters", "return_type", "decorators", "is_async", "receiver"), "struct": ("visibility", "type_kind"), "class": ("bases", "decorators", "docstring"),
    "import": ("module", "name", "alias", "level", "is_system", "is_cuda", "import_type"), "header": ("level",), "code_block": ("language",), "list": ("ordered",), "list_item": ("task", "checked"), "variable": ("value", "type"), "kernel": ("is_global", "is_device", "is_host"),
}
COMMON = ("type", "name", "content", "line_start", "line_end", "attributes", "children")
TASKS = {
    "find functions": ".functions[].name", "count elements": "[.functions[]?, .classes[]?, .structs[]?] | length", "list imports": ".imports[].name", "find public items": '[.. | objects | select(.attributes?.visibility? == "pub") | .name]',
    "find long elements": ".functions[] | select(.line_end - .line_start > 50) | .name", "extract documentation": ".functions[] | select(.attributes.docstring) | {name, doc: .attributes.docstring}",
}


def missing(value: dict, file_type: str) -> list[str]:
    """Required fields that a unified JSON lacks."""
    return [k for k in ("metadata", *REQUIRED.get(file_type, [])) if value.get(k) is None]


def missing_fields(json: Column, file_type: Column) -> Column:
    """`missing` of JSON text in a column; null for text that isn't JSON."""
    keys = F.json_object_keys(json)
    out = F.array().cast("array<string>")
    for kind, fields in REQUIRED.items():
        wanted = F.array(*[F.lit(x) for x in ("metadata", *fields)])
        out = F.when(file_type == kind, F.array_except(wanted, keys)).otherwise(out)
    return F.when(keys.isNotNull(), out)


def field_table(spark: SparkSession) -> DataFrame:
    """file_type, field, element_type, required of all schemas."""
    rows = [(kind, field, element, field in REQUIRED[kind]) for kind, fields in FIELDS.items() for element, field in fields.items()]
    return spark.createDataFrame(rows, "file_type string, field string, element_type string, required boolean")


def fields_of(file_type: str, field: str | None = None) -> list[str]:
    """Fields of a type, or what the elements of one field hold."""
    if file_type not in FIELDS:
        raise KeyError(f"{file_type}; near it: {difflib.get_close_matches(file_type, FIELDS) or sorted(FIELDS)}")
    if field is None:
        return sorted({*FIELDS[file_type].values(), *REQUIRED[file_type]})
    element = next((e for e, f in FIELDS[file_type].items() if f == field), None)
    if element is None:
        raise KeyError(f"{field}; near it: {suggest(field, file_type)}")
    return [*COMMON, *(f"attributes.{a}" for a in ATTRIBUTES.get(element, ()))]


def suggest(field: str, file_type: str, most: int = 3) -> list[str]:
    """Fields whose names are near one that a type does not have."""
    return difflib.get_close_matches(field.lstrip("."), fields_of(file_type), most, 0.4)
