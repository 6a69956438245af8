"""Modules, query texts and references: small inputs with their exact readings."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import bsl, query_language, references

MODULES = [
    ("m1", "First", "// Comment()\n#Region()\nProcedure Run(A) Export\n  Helper (1); Second.Work();\r\n  If (Helper(2)) Then\nEndProcedure\nФункция Helper(Б)\n  Возврат (Run());\nКонецФункции\nHelper();"),
    ("m2", "Second", "function Work() экспорт\n  Hidden(); First.Gone(); Nowhere.X(); First.Helper(); a.b.c();\nendfunction\nProcedure Hidden()\nEndProcedure\nProcedure Bad"),
    ("m3", "Empty", None),
]


@pytest.fixture(scope="module")
def modules(spark):
    return spark.createDataFrame(MODULES, "module_id string, module_name string, text string")


def test_declarations(modules):
    rows = {(r.module_id, r.line, r.kind, r.name, r.exported, r.symbol_id, r.error) for r in bsl.declarations(modules).collect()}
    assert rows == {
        ("m1", 3, "procedure", "Run", True, "m1:procedure:Run", None), ("m1", 7, "function", "Helper", False, "m1:function:Helper", None),
        ("m2", 1, "function", "Work", True, "m2:function:Work", None), ("m2", 4, "procedure", "Hidden", False, "m2:procedure:Hidden", None), ("m2", 6, "procedure", None, False, None, "malformed_declaration"),
    }


def test_calls(modules):
    rows = [(r.module_id, r.line, r.ordinal, r.scope, r.callee, r.call_id) for r in bsl.calls(modules).orderBy("module_id", "ordinal").collect()]
    assert rows == [
        ("m1", 4, 1, "Run", "Helper", "m1:call:4:1"), ("m1", 4, 2, "Run", "Second.Work", "m1:call:4:2"), ("m1", 5, 3, "Run", "Helper", "m1:call:5:3"), ("m1", 8, 4, "Helper", "Run", "m1:call:8:4"), ("m1", 10, 5, None, "Helper", "m1:call:10:5"),
        ("m2", 2, 1, "Work", "Hidden", "m2:call:2:1"), ("m2", 2, 2, "Work", "First.Gone", "m2:call:2:2"), ("m2", 2, 3, "Work", "Nowhere.X", "m2:call:2:3"), ("m2", 2, 4, "Work", "First.Helper", "m2:call:2:4"), ("m2", 2, 5, "Work", "a.b.c", "m2:call:2:5"),
    ]
    symbols, calls = bsl.declarations(modules), bsl.calls(modules)
    local = {(r.module_id, r.ordinal): (r.target_id, r.reason) for r in bsl.resolve_local_calls(calls, symbols).collect()}
    assert local["m1", 1] == ("m1:function:Helper", None) and local["m1", 2] == (None, "qualified_target") and local["m1", 5] == (None, "missing_source_scope") and local["m2", 1] == ("m2:procedure:Hidden", None)
    cross = {(r.module_id, r.ordinal): (r.target_id, r.reason) for r in bsl.resolve_qualified_calls(calls, symbols, modules).collect()}
    assert cross == {("m1", 2): ("m2:function:Work", None), ("m2", 2): (None, "target_symbol_not_found"), ("m2", 3): (None, "target_module_not_found"), ("m2", 4): (None, "target_symbol_not_exported"), ("m2", 5): (None, "invalid_qualified_target")}


def test_static_queries(spark):
    text = 'Procedure P()\n Q = New Query("SELECT ""a""\n  |FROM b");\n R = New Query;\n r.Text = "one";\n S = New Query;\n S.Text = "x"; // no\n T = New Query("1"); \n T = New Query("2");\n U = New Query;\n U.Text = "a";\n U.Text = "b";\n V = New Query("open\n W = New Query(name);\nEndProcedure\n X = New Query("out");'
    assert bsl.static_queries("m", text) == [("m:procedure:P", "Q", 'SELECT "a"\nFROM b', 2), ("m:procedure:P", "R", "one", 4)]
    rows = bsl.queries(spark.createDataFrame([("m", text), ("n", "Procedure"), ("o", None)], "module_id string, text string")).collect()
    assert [(r.query_id, r.error is None) for r in rows] == [("m:procedure:P:query:Q", True), ("m:procedure:P:query:R", True), (None, False)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT Ref FROM Catalog.Products", (None, 16, 32, "catalog", "Catalog", "Products", None)),
        ("ВЫБРАТЬ Ссылка ИЗ Справочник.Номенклатура", (None, 33, 78, "catalog", "Справочник", "Номенклатура", None)),
        ("SELECT TOP 1 Tab.SessionID FROM InformationRegister.ObjectsToDelete AS Tab", (None, 32, 67, "information_register", "InformationRegister", "ObjectsToDelete", "Tab")),
        ("SELECT a FROM AccumulationRegister.N.Balance(", (query_language.VIRTUAL, 14, 44)),
        ("SELECT a FROM Catalog.N; SELECT b", (query_language.STRUCTURE, 23, 24)),
        ("SELECT a FROM Catalog.N JOIN Catalog.M", (query_language.STRUCTURE, 24, 28)),
        ("SELECT a FROM Catalog.N UNION ALL SELECT b", (query_language.STRUCTURE, 24, 33)),
        ("SELECT a FROM Catalog.N UNION SELECT b", (query_language.STRUCTURE, 24, 29)),
        ("SELECT a FROM (SELECT b", (query_language.STRUCTURE, 14, 21)),
        ("SELECT a INTO tt FROM Catalog.N", (query_language.TEMPORARY, 9, 16)),
        ("SELECT a FROM tt AS b", (query_language.TEMPORARY, 14, 16)),
        ("SELECT a FROM &P AS a", (query_language.PARAMETER, 14, 16)),
        ("SELECT a FROM Document.N", (query_language.NAMESPACE, 14, 22)),
        ("select a", (query_language.MALFORMED, 0, 6)),
        ("SELECT a, b FROM Catalog.N", (query_language.MALFORMED, 8, 9)),
        ("SELECT a FROM Catalog.N WHERE", (query_language.MALFORMED, 24, 29)),
        ("", (query_language.MALFORMED, 0, 0)),
        ("SELECT a FROM Catalog.N;", (query_language.MALFORMED, 23, 24)),
    ],
)
def test_query_language(text, expected):
    assert tuple(query_language.read(text))[: len(expected)] == expected


def test_query_language_rows(spark):
    rows = query_language.read_queries(spark.createDataFrame([("q", "SELECT Ref FROM Catalog.P"), ("r", None)], "query_id string, text string")).collect()
    assert [(r.query_id, r.code, r.name) for r in rows] == [("q", None, "P"), ("r", query_language.MALFORMED, None)]


@pytest.mark.parametrize(
    ("read", "cases"),
    [
        (references.subsystem_token, {"Catalog.Goods": ("supported", None, "catalog", "Goods"), "Subsystem.A.Subsystem.B": ("deferred", "unsupported_prefix", None, None), "Bad": ("malformed", "malformed_format", None, None), "Catalog.": ("malformed", "malformed_format", None, None), "Style.X": ("unsupported", "unsupported_prefix", None, None), "Catalog.A.B": ("malformed", "malformed_format", None, None), "Enum.E": ("supported", None, "enumeration", "E")}),
        (references.protected_resource, {"Configuration.Shop": ("supported", None, "configuration", "Shop"), "Report.R": ("unsupported", "ignored", None, None), "Catalog": ("unsupported", "ignored", None, None)}),
        (references.type_reference, {"cfg:CatalogRef.Goods": ("supported", None, "catalog", "Goods"), "InformationRegisterRecordKey.I": ("supported", None, "information_register", "I"), "String": ("unsupported", "no_reference", None, None)}),
        (references.event_handler, {"CommonModule.M.P": ("supported", None, "M", "P"), "": ("malformed", "empty_value", None, None), "A.B": ("malformed", "missing_components", None, None), "A.B.C.D": ("malformed", "additional_components", None, None), "CommonModule..P": ("malformed", "empty_component", None, None), "Other.M.P": ("malformed", "unsupported_namespace", None, None)}),
        (references.event_source, {"DocumentObject": ("supported", None, "document", None), "CatalogObject.Goods": ("supported", None, "catalog", "Goods"), " ": ("malformed", "empty_value", None, None), "A.B.C": ("malformed", "additional_components", None, None), "ReportObject": ("unsupported", "unsupported_prefix", None, None)}),
        (references.form_target, {"CommonForm.F": ("supported", None, "common_form", "F"), "Catalog.G.Form.F": ("supported", None, "catalog", "G.F"), "Catalog.G.Form": ("unsupported", "default_form_alias", None, None), "Catalog.G.ListForm": ("unsupported", "shorthand_form", None, None), "Role.G.Form.F": ("unsupported", "unsupported_prefix", None, None), "X": ("unsupported", "invalid_target_shape", None, None)}),
        (references.register_record, {"AccumulationRegister.S": ("supported", None, "accumulation_register", "S"), "InformationRegister.S": ("unsupported", "unsupported_kind", None, None), "X": ("malformed", "malformed_format", None, None), "Catalog.S": ("unsupported", "unsupported_prefix", None, None)}),
    ],
)
def test_references(spark, read, cases):
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", read(F.col("v")).alias("r"))
    assert {r.v: tuple(r.r) for r in df.collect()} == cases
