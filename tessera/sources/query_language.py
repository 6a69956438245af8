"""The query language: one statement that selects from one table.

A text gives either its source (category, namespace, name, alias, byte range) or a diagnostic (code, byte range).
Shapes that are known but not supported are looked for first, in a fixed order; only a text without any is parsed.
Byte ranges count UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.shipping import ship

# What selects, what names a source, and the categories of sources.
LANGUAGES = {"SELECT": "FROM", "ВЫБРАТЬ": "ИЗ"}
CATEGORIES = {"Catalog": "catalog", "Справочник": "catalog", "InformationRegister": "information_register", "AccumulationRegister": "accumulation_register", "AccountingRegister": "accounting_register"}
REGISTERS = ("InformationRegister", "AccumulationRegister", "AccountingRegister")
STRUCTURE, TEMPORARY, VIRTUAL = "query_language.unsupported_structure", "query_language.temporary_table_source", "query_language.virtual_table_source"
PARAMETER, NAMESPACE, MALFORMED = "query_language.external_or_parameter_data_source", "query_language.unsupported_persistent_namespace", "query_language.malformed_syntax"

_TOKEN = re.compile(r"(?P<word>[^\W\d]\w*)|(?P<number>[0-9]+)|(?P<sign>[.&(;])|(?P<other>\S)")


class Token(NamedTuple):
    kind: str
    text: str
    begin: int
    end: int


class Outcome(NamedTuple):
    code: str | None
    begin: int | None
    end: int | None
    category: str | None = None
    namespace: str | None = None
    name: str | None = None
    alias: str | None = None


class _Rejected(Exception):
    pass


def tokens(text: str) -> list[Token]:
    """Words, numbers, the signs that matter and everything else character by character, then the end."""
    out, at, size = [], 0, 0
    for m in _TOKEN.finditer(text):
        size += len(text[at : m.start()].encode())
        length = len(m[0].encode())
        out.append(Token(m.lastgroup, m[0], size, size + length))
        at, size = m.end(), size + length
    end = size + len(text[at:].encode())
    return [*out, Token("end", "", end, end)]


def _shape(ts: list[Token]) -> str:
    """One letter per token, so that unsupported shapes are patterns: keywords by their own letter, other words w."""
    letters = {"JOIN": "J", "UNION": "U", "ALL": "A", "INTO": "I", "SELECT": "S", "ВЫБРАТЬ": "S", "FROM": "F", "ИЗ": "F"}
    return "".join("R" if t.kind == "word" and t.text in REGISTERS else letters.get(t.text, "w") if t.kind == "word" else "9" if t.kind == "number" else t.text if t.kind == "sign" else "$" if t.kind == "end" else "?" for t in ts)


_ANY_WORD = "[RJUAISFw]"
#: In this order: pattern, code, first and last token of the range (from the match's begin).
_UNSUPPORTED = [
    (re.compile(rf"R\.{_ANY_WORD}\.{_ANY_WORD}\("), VIRTUAL, 0, 4),
    (re.compile(r";(?=[^$])"), STRUCTURE, 0, 0),
    (re.compile(r"J"), STRUCTURE, 0, 0),
    (re.compile(r"UA?"), STRUCTURE, 0, -1),
    (re.compile(r"\(S"), STRUCTURE, 0, 1),
    (re.compile(rf"I{_ANY_WORD}"), TEMPORARY, 0, 1),
    (re.compile(rf"F{_ANY_WORD}[^.]"), TEMPORARY, 1, 1),
]


def _parsed(ts: list[Token]) -> Outcome:
    at = 0

    def fail(code: str = MALFORMED, begin: int | None = None, end: int | None = None) -> None:
        raise _Rejected(code, ts[at].begin if begin is None else begin, ts[at].end if end is None else end)

    def take(kind: str, text: str | None = None) -> Token:
        nonlocal at
        t = ts[at]
        if t.kind != kind or (text is not None and t.text != text):
            fail()
        at += t.kind != "end"
        return t

    def maybe(text: str) -> bool:
        nonlocal at
        found = ts[at].kind in ("word", "sign") and ts[at].text == text
        at += found
        return found

    try:
        if ts[0].kind != "word" or ts[0].text not in LANGUAGES:
            fail()
        english = take("word").text == "SELECT"
        if english and maybe("TOP"):
            take("number")
        take("word")
        while maybe("."):
            take("word")
        take("word", LANGUAGES["SELECT" if english else "ВЫБРАТЬ"])
        if ts[at].text == "&" and ts[at].kind == "sign":
            begin = take("sign").begin
            fail(PARAMETER, begin, take("word").end)
        namespace = take("word")
        take("sign", ".")
        name = take("word")
        if namespace.text not in CATEGORIES:
            fail(NAMESPACE, namespace.begin, namespace.end)
        alias = take("word").text if english and maybe("AS") else None
        take("end")
        return Outcome(None, namespace.begin, name.end, CATEGORIES[namespace.text], namespace.text, name.text, alias)
    except _Rejected as e:
        return Outcome(*e.args)


def read(text: str) -> Outcome:
    ts = tokens(text)
    shape = _shape(ts)
    for pattern, code, first, last in _UNSUPPORTED:
        m = pattern.search(shape)
        if m:
            return Outcome(code, ts[m.start() + first].begin, ts[m.end() - 1 if last < 0 else m.start() + last].end)
    return _parsed(ts)


def read_queries(queries: DataFrame) -> DataFrame:
    """`query_id` and the outcome of its `text`: `code`, `begin_byte`, `end_byte`, `category`, `namespace`, `name`, `alias`."""
    ship(queries.sparkSession)
    names = ["query_id", "code", "begin_byte", "end_byte", "category", "namespace", "name", "alias"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(t or "") for t in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return queries.select("query_id", "text").mapInArrow(run, "query_id string, code string, begin_byte int, end_byte int, category string, namespace string, name string, alias string")
