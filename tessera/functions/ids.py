"""Derived identities: strings with the UTF-8 byte length of every part in front of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(label: str, value: Column | str) -> Column:
    """`label#bytes:value`"""
    value = _col(value)
    return F.concat(F.lit(f"{label}#"), F.octet_length(value).cast("string"), F.lit(":"), value)


def edge_id(source: Column | str = "source", target: Column | str = "target", kind: Column | str = "kind") -> Column:
    return F.concat(F.lit("edge:"), part("source", source), F.lit(";"), part("target", target), F.lit(";kind:"), _col(kind))


def access_right_id(resource: Column | str, right: Column | str, condition: Column | str | None = None) -> Column:
    base = F.concat(F.lit("access_right:"), part("resource", resource), F.lit(";"), part("right", right))
    if condition is None:
        return base
    return F.concat(base, F.coalesce(F.concat(F.lit(";"), part("row_restriction", condition)), F.lit("")))


def access_right_name(resource: Column | str, right: Column | str, condition: Column | str) -> Column:
    return F.concat(_col(right), F.lit(" on "), _col(resource), F.coalesce(F.concat(F.lit(" restricted by "), _col(condition)), F.lit("")))


def data_composition_id(kind: str, owner: Column | str, name: Column | str) -> Column:
    named = part("role", F.lit("query")) if kind == "query" else part("name", name)
    return F.concat(F.lit(f"data_composition:{kind};"), part("owner", owner), F.lit(";"), named)


def xdto_type_id(owner: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("xdto_type;"), part("owner", owner), F.lit(";"), part("name", name))


def member_id(parent: Column | str, role: str, name: Column | str) -> Column:
    """Standard attributes, measures, BSL symbols and queries: `parent:role:name`."""
    return F.concat(_col(parent), F.lit(f":{role}:"), _col(name))


def reference_request_id(source: Column | str, category: Column | str, reference: Column | str, expected_kinds: Column | str) -> Column:
    """Expected kinds are sorted and taken once."""
    kinds = F.transform(F.array_sort(F.array_distinct(_col(expected_kinds))), lambda k: F.concat(F.lit(";"), part("expected_kind", k)))
    return F.concat(F.lit("reference_request;"), part("source", source), F.lit(";"), part("category", category), F.lit(";"), part("reference", reference), F.array_join(kinds, ""))
