"""Statements that write registers or open forms, read from the lines of modules by expressions alone.

A statement is what stands between semicolons on one line; one that runs over several lines is malformed here.
`modules` has `module_id`, `text`, `role` (as in module ids) and `owner_kind`. Every occurrence is a row, with the
first reason in order why it is no candidate, or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import bsl, references

_NAME = r"[\p{L}_][\p{L}\p{N}_]*"
#: What stands before a comment, and a semicolon: neither within quotes, of which an even number follows or went before.
_COMMENT, _END = r'^((?:[^"/]|"[^"]*"|/(?!/))*+)//.*$', r';(?=(?:[^"]*"[^"]*")*[^"]*$)'
_CHAIN = rf"(?:{_NAME}\s*\.\s*)*{_NAME}"


def _statements(modules: DataFrame) -> DataFrame:
    """`module_id`, `line`, `statement`, the symbol around it (`symbol_id`, `symbol_kind`), `role`, `owner_kind`."""
    lines = bsl.scoped_lines(modules)
    each = lines.select("module_id", "line", "scope", F.explode(F.split(F.regexp_replace("code", _COMMENT, "$1"), _END)).alias("_s")).select("module_id", "line", "scope", F.trim("_s").alias("statement")).filter("statement != ''")
    symbols = bsl.declarations(modules).filter("error is null").select("module_id", F.lower("name").alias("_scope"), "symbol_id", F.col("kind").alias("symbol_kind"))
    return each.withColumn("_scope", F.lower("scope")).join(symbols, ["module_id", "_scope"], "left").join(modules.select("module_id", "role", "owner_kind"), "module_id").drop("_scope", "scope")


def _symbol_reason() -> Column:
    return F.when(F.col("symbol_id").isNull(), "missing_containing_symbol").when(F.col("symbol_kind") != "procedure", "unsupported_containing_symbol")


def register_writes(modules: DataFrame) -> DataFrame:
    """`RegisterRecords.<Name>.Write()`: `module_id`, `line`, `symbol_id`, `register` and `reason`."""
    found = _statements(modules).filter(F.col("statement").rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_])Write\s*\("))
    s = F.col("statement")
    chain = F.regexp_extract(s, rf"(?i)({_CHAIN})\s*\.\s*Write\s*\(", 1)
    parts = F.split(F.regexp_replace(chain, r"\s+", ""), r"\.")
    whole = s.rlike(rf"(?i)^{_CHAIN}\s*\.\s*Write\s*\([^()]*\)$")
    own = F.lower(parts[0]) == "registerrecords"
    reason = (
        F.when(~s.rlike(r"(?i)Write\s*\([^()]*\)"), "malformed_or_incomplete_statement").when((chain == "") & s.rlike(r"(?i)\.\s*Write\s*\("), "computed_receiver").when(chain == "", "unsupported_receiver")
        .when(~whole, "expression_remainder").when(F.size(parts) > 2, "extra_receiver_components").when((F.size(parts) == 1) & own, "collection_level_write")
        .when(F.size(parts) == 1, "requires_value_flow").when(~own, "unsupported_receiver").when(~s.rlike(r"\(\s*\)$"), "non_empty_arguments")
    )
    after = F.coalesce(_symbol_reason(), F.when(F.col("role") != "object_module", "unsupported_module_kind").when(F.col("owner_kind") != "document", "unsupported_owner_kind"))
    reason = F.coalesce(reason, after)
    return found.select("module_id", "line", "symbol_id", F.when(reason.isNull(), parts[1]).alias("register"), reason.alias("reason"))


def form_openings(modules: DataFrame) -> DataFrame:
    """`OpenForm("literal"[, ...])`: `module_id`, `line`, `symbol_id`, `target` (see `references.form_target`) and `reason`."""
    found = _statements(modules).filter(F.col("statement").rlike(r"(?<![\p{L}\p{N}_])OpenForm(?![\p{L}\p{N}_])"))
    s = F.col("statement")
    literal = F.regexp_replace(F.regexp_extract(s, r'^OpenForm\s*\(\s*"((?:[^"]|"")*)"\s*[,)]', 1), '""', '"')
    target = references.form_target(literal)
    reason = (
        F.when(~s.rlike(r"(?<![\p{L}\p{N}_])OpenForm\s*\("), "malformed_statement").when(~s.rlike(r"\)$"), "incomplete_statement").when(~s.rlike(r"^OpenForm\s*\(.*\S.*\)$"), "malformed_statement")
        .when(~s.rlike(r'^OpenForm\s*\(\s*"(?:[^"]|"")*"\s*[,)]'), "dynamic_first_argument").when(F.col("role") != "command_module", "unsupported_module_kind")
    )
    reason = F.coalesce(reason, _symbol_reason(), target["reason"])
    return found.select("module_id", "line", "symbol_id", F.when(reason.isNull(), target).alias("target"), reason.alias("reason"))
