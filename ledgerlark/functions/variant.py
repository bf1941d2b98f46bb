"""JSON of unknown shape as VARIANT: model responses without what they repeat, and fields of a type that is not known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELDS = "map<string,variant>"


def without_parsed(response: Column) -> Column:
    """A completion's JSON less the ``parsed`` object of each choice's message, which repeats the message's content.

    Everything else stays whatever its shape: other keys come in the order of their names. Null where the text is no
    JSON object; a response without choices, or with messages that are no objects, is only written anew.
    """
    fields = F.try_variant_get(F.try_parse_json(response), "$", _FIELDS)
    choices = lambda v: F.to_variant_object(F.transform(F.try_variant_get(v, "$", "array<variant>"), _stripped_choice))
    return F.to_json(F.to_variant_object(_changed(fields, "choices", choices)))


def _stripped_choice(choice: Column) -> Column:
    less = lambda v: F.to_variant_object(F.map_filter(F.try_variant_get(v, "$", _FIELDS), lambda k, _: k != "parsed"))
    return F.coalesce(F.to_variant_object(_changed(F.try_variant_get(choice, "$", _FIELDS), "message", less)), choice)


def _changed(fields: Column, key: str, change) -> Column:
    """Fields with ``change`` made to the value of one key, where that gives a value. VARIANT puts keys in order itself."""
    return F.transform_values(fields, lambda k, v: F.when(k == key, F.coalesce(change(v), v)).otherwise(v))


def field(json: Column, path: str, kind: str) -> Column:
    """The value at ``path`` as ``kind``, null where the text is no JSON, the path is not there or the value doesn't fit."""
    return F.try_variant_get(F.try_parse_json(json), path, kind)
