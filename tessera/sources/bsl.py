"""Declarations, scopes, calls and static queries of module sources.

Modules are rows (`module_id`, `module_name`, `text`). Lines, declarations and calls are built-in expressions: a
line's scope is the last declaration or end of scope above it, carried by a window over the module's lines. Only
static queries, whose strings run over several lines, are read by Python, module by module.

A declaration without a parenthesis or a name is an error row, not an exception.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shipping import ship

# Keywords, in both languages of the source.
PROCEDURE, FUNCTION = ("procedure", "процедура"), ("function", "функция")
ENDS = ("endprocedure", "конецпроцедуры", "endfunction", "конецфункции")
NOT_CALLED = ("if", "если", "elsif", "иначеесли", "while", "пока", "for", "для", "foreach", "длякаждого", "return", "возврат", *PROCEDURE, *FUNCTION)
EXPORT = ("export", "экспорт")
NEW_QUERY = ("new query", "новый запрос")
TEXT_PROPERTY = ("text", "текст")

_KEYWORD = "^(" + "|".join((*PROCEDURE, *FUNCTION)) + ")"
#: An identifier, dots included, up to a parenthesis; the identifier begins where the character before can't be part of one.
_CALL = r"(?<![\p{L}\p{N}_.])[\p{L}_][\p{L}\p{N}_.]*(?=\s*\()"


def lines(modules: DataFrame) -> DataFrame:
    """The lines that count: `module_id`, `line` (from 1) and `code`, without leading blanks, comments and directives."""
    each = modules.select("module_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("_at", "_line"))
    code = F.regexp_replace("_line", r"^\s+", "")
    return each.select("module_id", (F.col("_at") + 1).alias("line"), code.alias("code")).filter((F.col("code") != "") & ~F.col("code").startswith("//") & ~F.col("code").startswith("#"))


def _rest() -> Column:
    keyword = F.regexp_extract(F.lower("code"), _KEYWORD, 1)
    return F.regexp_replace(F.substring(F.col("code"), F.length(keyword) + 1, F.length("code")), r"^\s+", "")


def _declared() -> dict[str, Column]:
    rest = _rest()
    name = F.trim(F.substring_index(rest, "(", 1))
    ok = F.contains(rest, F.lit("(")) & (name != "")
    exported = F.lit(False)
    for word in EXPORT:
        exported = exported | F.contains(F.lower(rest), F.lit(word))
    kind = F.when(F.lower("code").rlike("^(" + "|".join(PROCEDURE) + ")"), "procedure").otherwise("function")
    return {"kind": kind, "name": F.when(ok, name), "exported": exported, "error": F.when(~ok, "malformed_declaration")}


def declarations(modules: DataFrame) -> DataFrame:
    """`module_id`, `line`, `kind`, `name`, `exported`, `symbol_id` and `error`."""
    found = lines(modules).filter(F.lower("code").rlike(_KEYWORD)).select("module_id", "line", *(v.alias(k) for k, v in _declared().items()))
    return found.withColumn("symbol_id", F.concat_ws(":", "module_id", "kind", F.col("name"))).withColumn("symbol_id", F.when(F.col("name").isNotNull(), F.col("symbol_id")))


def scoped_lines(modules: DataFrame) -> DataFrame:
    """The lines between declarations and ends, with the `scope` (a declared name) that they stand in, or null."""
    found = lines(modules)
    starts = F.lower("code").rlike(_KEYWORD)
    ends = F.lower(F.trim("code")).isin(*ENDS)
    mark = F.when(starts, F.struct(_declared()["name"].alias("name"))).when(ends, F.struct(F.lit(None).cast("string").alias("name")))
    so_far = Window.partitionBy("module_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("_mark", F.last(mark, ignorenulls=True).over(so_far)).filter(~starts & ~ends).select("module_id", "line", "code", F.col("_mark.name").alias("scope"))


def calls(modules: DataFrame) -> DataFrame:
    """`module_id`, `line`, `ordinal` (through the module), `scope`, `callee` and `call_id`."""
    names = F.regexp_extract_all(F.col("code"), F.lit(_CALL), F.lit(0))
    each = scoped_lines(modules).select("module_id", "line", "scope", F.posexplode(names).alias("_at", "callee"))
    each = each.filter(~F.lower("callee").isin(*NOT_CALLED))
    in_order = Window.partitionBy("module_id").orderBy("line", "_at")
    each = each.withColumn("ordinal", F.row_number().over(in_order))
    return each.select("module_id", "line", "ordinal", "scope", "callee", F.concat_ws(":", "module_id", F.lit("call"), F.col("line").cast("string"), F.col("ordinal").cast("string")).alias("call_id"))


def _symbols(found: DataFrame) -> DataFrame:
    """One symbol per module and lower-cased name: the last declared."""
    return found.filter("name is not null").groupBy("module_id", F.lower("name").alias("_name")).agg(F.max_by(F.struct("symbol_id", "exported"), "line").alias("s")).select("module_id", "_name", "s.*")


def resolve_local_calls(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with `source_id`, `target_id` and, where there is no target, `reason`; the first reason that holds."""
    s = _symbols(symbols)
    source = s.select("module_id", F.col("_name").alias("_scope"), F.col("symbol_id").alias("source_id"))
    target = s.select("module_id", F.col("_name").alias("_callee"), F.col("symbol_id").alias("_target"))
    out = found.withColumns({"_scope": F.lower("scope"), "_callee": F.lower("callee")}).join(source, ["module_id", "_scope"], "left").join(target, ["module_id", "_callee"], "left")
    reason = F.when(F.col("scope").isNull(), "missing_source_scope").when(F.col("source_id").isNull(), "source_symbol_not_found").when(F.contains("callee", F.lit(".")), "qualified_target").when(F.col("_target").isNull(), "target_symbol_not_found")
    return out.select("module_id", "line", "ordinal", "callee", "source_id", F.when(reason.isNull(), F.col("_target")).alias("target_id"), reason.alias("reason"))


def resolve_qualified_calls(found: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Calls of `Module.Symbol`: the module by its lower-cased name (the last wins), then its exported symbol."""
    s = _symbols(symbols)
    named = modules.groupBy(F.lower("module_name").alias("_module")).agg(F.max("module_id").alias("_target_module"))
    source = s.select("module_id", F.col("_name").alias("_scope"), F.col("symbol_id").alias("source_id"))
    target = s.select(F.col("module_id").alias("_target_module"), F.col("_name").alias("_symbol"), F.col("symbol_id").alias("_target"), "exported")
    parts = F.split(F.lower("callee"), r"\.")
    valid = (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")
    out = found.filter(F.contains("callee", F.lit("."))).withColumns({"_scope": F.lower("scope"), "_valid": valid, "_module": F.when(valid, parts[0]), "_symbol": F.when(valid, parts[1])})
    out = out.join(source, ["module_id", "_scope"], "left").join(named, "_module", "left").join(target, ["_target_module", "_symbol"], "left")
    reason = (
        F.when(F.col("scope").isNull(), "missing_source_scope").when(F.col("source_id").isNull(), "source_symbol_not_found").when(~F.col("_valid"), "invalid_qualified_target")
        .when(F.col("_target_module").isNull(), "target_module_not_found").when(F.col("_target").isNull(), "target_symbol_not_found").when(~F.col("exported"), "target_symbol_not_exported")
    )
    return out.select("module_id", "line", "ordinal", "callee", "source_id", F.when(reason.isNull(), F.col("_target")).alias("target_id"), reason.alias("reason"))


# --- static queries -----------------------------------------------------------------------------------------------

_DECLARATION = re.compile(r"(?i)(procedure|процедура|function|функция)")
_LITERAL = re.compile(r'"((?:[^"\r\n]|""|\r?\n[ \t]*\|)*)"')
_CONSTRUCTOR = re.compile(r"(?is)([^=\r\n.]+)=[^\S\r\n]*(?:new query|новый запрос)[^\S\r\n]*(.*)")
_ASSIGNMENT = re.compile(r"(?is)([^=\r\n.]+)\.[^\S\r\n]*(?:text|текст)[^\S\r\n]*=[^\S\r\n]*(\S.*)")


def literal_text(body: str) -> str:
    """The text of a string literal: doubled quotes are quotes, and a bar goes on from the line before."""
    return re.sub(r"\r?\n[ \t]*\|", "\n", body).replace('""', '"')


def _literal_statement(rest: str, before: str, after: str) -> tuple[str, int] | None:
    """Text of the literal that follows `before`, and how many line breaks it has, if only `after` ends the statement."""
    if not rest.startswith(before):
        return None
    rest = rest[len(before) :].lstrip(" \t")
    m = _LITERAL.match(rest)
    if not m:
        return None
    tail = rest[m.end() :].split("\n", 1)[0].strip()
    if tail.removesuffix(";").strip() != after:
        return None
    return literal_text(m[1]), m[0].count("\n")


def static_queries(module_id: str, source: str) -> list[tuple[str, str, str, int]]:
    """Owner symbol id, binding, text and line of the queries of a module whose text is a constant.

    A binding counts within its scope; set up twice, or given a second or no constant text, it is dropped.
    """
    out: list[tuple[str, str, str, int]] = []
    held: dict[str, dict] = {}
    owner = None
    rows = source.split("\n")

    def flush() -> None:
        out.extend((h["owner"], h["binding"], h["text"], h["line"]) for _, h in sorted(held.items()) if not h["bad"] and h["text"] is not None)
        held.clear()

    i = 0
    while i < len(rows):
        row = rows[i].removesuffix("\r").lstrip()
        at, i = i, i + 1
        if not row or row.startswith(("//", "#")):
            continue
        m = _DECLARATION.match(row)
        if m:
            rest = row[m.end() :].lstrip()
            name = rest.partition("(")[0].strip()
            if "(" not in rest or not name:
                raise ValueError(f"malformed declaration at line {at + 1}")
            owner = f"{module_id}:{'procedure' if m[1].lower() in PROCEDURE else 'function'}:{name}"
            held.clear()
            continue
        if row.strip().lower() in ENDS:
            flush()
            owner = None
            continue
        if owner is None or "=" not in row:
            continue
        onward = "\n".join([row, *rows[i:]]) if '"' in row else row
        m = _CONSTRUCTOR.match(onward)
        if m:
            rest = m[2].split("\n", 1)[0].strip().removesuffix(";").strip()
            literal = _literal_statement(m[2], "(", ")") if rest else None
            if not rest or literal:
                binding = m[1].strip()
                key = binding.lower()
                if key in held:
                    held[key]["bad"] = True
                else:
                    held[key] = {"owner": owner, "binding": binding, "text": literal and literal[0], "line": at + 1, "bad": False}
                i += literal[1] if literal else 0
                continue
        m = _ASSIGNMENT.match(onward)
        if m:
            literal = _literal_statement(m[2], "", "")
            h = held.get(m[1].strip().lower())
            if h:
                if literal and h["text"] is None and not h["bad"]:
                    h["text"] = literal[0]
                else:
                    h["bad"] = True
            i += literal[1] if literal else 0
    flush()
    return out


def queries(modules: DataFrame) -> DataFrame:
    """`query_id`, `owner_id`, `binding`, `text`, `line` and `error` (of a module that can't be read)."""
    ship(modules.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for module_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(f"{owner}:query:{binding}", owner, binding, body, line, None) for owner, binding, body, line in static_queries(module_id, text or "")]
                except ValueError as e:
                    rows.append((None, module_id, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query_id", "owner_id", "binding", "text", "line", "error"])

    return modules.select("module_id", "text").mapInArrow(run, "query_id string, owner_id string, binding string, text string, line int, error string")
