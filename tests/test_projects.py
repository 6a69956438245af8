"""A small project on disk: every reader has something to read, and the graph it makes is stated in full."""

import pytest

from pyspark.sql import functions as F

from tessera.graph import Graph
from tessera.operators import diff, lookup, report, validate
from tessera.schema import code, payload_fits
from tessera.sources import projects, xml
from tessera.sources import statements
from tessera.streaming import watch


def mdo(kind: str, uuid: str, body: str) -> str:
    return f'<?xml version="1.0"?><mdclass:{kind} xmlns:mdclass="urn:m" xmlns:xsi="urn:i" uuid="{uuid}">{body}</mdclass:{kind}>'


FILES = {
    ".project": "<projectDescription/>",
    "src/Configuration/Configuration.mdo": mdo("Configuration", "cfg", "<name>Shop</name>"),
    "src/Catalogs/Goods/Goods.mdo": mdo("Catalog", "goods", '<name>Goods</name><attributes uuid="price"><name>Price</name><type><types>DocumentRef.Sale</types><types>String</types></type></attributes><forms uuid="form1"><name>List</name></forms><tabularSections uuid="ts"><name>Parts</name><attributes uuid="part"><name>Part</name><type><types>CatalogRef.Nothing</types></type></attributes></tabularSections>'),
    "src/Catalogs/Goods/ObjectModule.bsl": 'Procedure Fill() Export\n\tCommon.Log();\n\tHelper();\n\t// Ghost();\n\tq = New Query("SELECT Ref FROM Catalog.goods");\nEndProcedure\n\nПроцедура Helper()\n\tIf (x) Then\n\tMissing();\nКонецПроцедуры\n',
    "src/Catalogs/Goods/Forms/List/Module.bsl": "// nothing yet\n",
    "src/Documents/Sale/Sale.mdo": mdo("Document", "sale", "<name>Sale</name><registerRecords>AccumulationRegister.Stock</registerRecords>"),
    "src/Documents/Sale/ObjectModule.bsl": "Procedure Posting()\n RegisterRecords.stock.Write(); RegisterRecords.Other.Write();\n RegisterRecords.Write(); x = RegisterRecords.Stock.Write(1);\nEndProcedure\n",
    "src/AccumulationRegisters/Stock/Stock.mdo": mdo("AccumulationRegister", "stock", "<name>Stock</name>"),
    "src/CommonCommands/Open/Open.mdo": mdo("CommonCommand", "open", "<name>Open</name>"),
    "src/CommonCommands/Open/CommandModule.bsl": 'Procedure CommandProcessing(A)\n OpenForm("Catalog.Goods.Form.List", A);\n OpenForm("Catalog.Goods.Form.None");\n OpenForm(Name);\nEndProcedure\n',
    "src/CommonModules/Common/Common.mdo": mdo("CommonModule", "common", "<name>Common</name>"),
    "src/CommonModules/Common/Module.bsl": "Procedure Log() Export\nEndProcedure\nProcedure OnWrite() Export\nEndProcedure\nProcedure Broken\n",
    "src/Roles/Seller/Seller.mdo": mdo("Role", "seller", "<name>Seller</name>"),
    "src/Roles/Seller/Rights.rights": '<Rights xmlns="urn:r"><object><name>Catalog.Goods</name><right><name>Read</name><value>true</value><restrictionByCondition><condition>WHERE Mine</condition></restrictionByCondition></right><right><name>Delete</name><value>false</value></right></object></Rights>',
    "src/Subsystems/Trade/Trade.mdo": mdo("Subsystem", "trade", "<name>Trade</name><content>Catalog.Goods</content><content>Catalog.Gone</content><content>Bad</content>"),
    "src/Subsystems/Trade/Subsystems/Retail/Retail.mdo": mdo("Subsystem", "retail", "<name>Retail</name><content>Document.Sale</content>"),
    "src/EventSubscriptions/Write/Write.mdo": mdo("EventSubscription", "sub", "<name>Write</name><source><types>DocumentObject</types></source><event>OnWrite</event><handler>CommonModule.Common.OnWrite</handler>"),
    "src/Reports/Sales/Sales.mdo": mdo("Report", "report", "<name>Sales</name>"),
    "src/Reports/Sales/Templates/Main/Template.dcs": '<DataCompositionSchema xmlns="urn:d" xmlns:xsi="urn:i"><dataSet xsi:type="DataSetQuery"><name>Set</name><field xsi:type="DataSetFieldField"><dataPath>Sum</dataPath></field><query>SELECT 1</query></dataSet></DataCompositionSchema>',
    "src/XDTOPackages/Pack/Pack.mdo": mdo("XDTOPackage", "pack", "<name>Pack</name>"),
    "src/XDTOPackages/Pack/Package.xdto": '<package xmlns="urn:x" targetNamespace="urn:p"><valueType name="Code"/><objectType name="Item"><property name="Id"/></objectType></package>',
    "src/WebServices/Api/Api.mdo": mdo("WebService", "api", '<name>Api</name><xdtoPackages xsi:type="core:ReferenceValue"><value>XDTOPackage.Pack</value></xdtoPackages><operations uuid="op"><name>Get</name><xdtoReturningValueType><name>Item</name><nsUri>urn:p</nsUri></xdtoReturningValueType><procedureName>DoGet</procedureName><parameters uuid="par"><name>Id</name><xdtoValueType><name>Code</name><nsUri>urn:p</nsUri></xdtoValueType></parameters></operations>'),
    "src/WebServices/Api/Module.bsl": "Function DoGet(Id)\nEndFunction\n",
    "src/HTTPServices/Site/Site.mdo": mdo("HTTPService", "site", '<name>Site</name><urlTemplates uuid="tpl"><name>Orders</name><template>/o</template><methods uuid="met"><name>GET</name><handler>Gone</handler></methods></urlTemplates>'),
    "src/HTTPServices/Site/Bad.mdo": "<a><b></a>",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("work") / "shop"
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return root, projects.read_project(spark, str(root))


def test_nodes(project):
    nodes = {r.id: (r.name, r.code) for r in project[1].graph.nodes.select("id", "name", code().alias("code")).collect()}
    right = "access_right:resource#5:goods;right#4:Read;row_restriction#10:WHERE Mine"
    expected = {
        "cfg": ("Shop", "metadata.configuration"), "goods": ("Goods", "metadata.catalog"), "price": ("Price", "attribute"), "ts": ("Parts", "tabular_section"), "part": ("Part", "attribute"), "form1": ("List", "form"),
        "goods:object_module": ("ObjectModule", "module"), "form1:form_module": ("FormModule", "module"), "goods:object_module:procedure:Fill": ("Fill", "procedure"), "goods:object_module:procedure:Helper": ("Helper", "procedure"),
        "goods:object_module:procedure:Fill:query:q": ("q", "query"), "sale": ("Sale", "metadata.document"), "common": ("Common", "metadata.common_module"), "common:common_module": ("Common", "module"),
        "common:common_module:procedure:Log": ("Log", "procedure"), "common:common_module:procedure:OnWrite": ("OnWrite", "procedure"), "seller": ("Seller", "metadata.role"), "seller:role": ("Seller", "role"), right: ("Read on Catalog.Goods restricted by WHERE Mine", "access_right"),
        "trade": ("Trade", "metadata.subsystem"), "trade:subsystem": ("Trade", "subsystem"), "retail": ("Retail", "metadata.subsystem"), "retail:subsystem": ("Retail", "subsystem"), "sub": ("Write", "metadata.event_subscription"), "report": ("Sales", "metadata.report"),
        "pack": ("Pack", "metadata.xdto_package"), "xdto_type;owner#4:pack;name#4:Code": ("Code", "xdto_type"), "xdto_type;owner#4:pack;name#4:Item": ("Item", "xdto_type"), "api": ("Api", "metadata.web_service"), "op": ("Get", "web_service_operation"), "par": ("Id", "web_service_parameter"),
        "api:common_module": ("Api", "module"), "api:common_module:function:DoGet": ("DoGet", "function"), "site": ("Site", "metadata.http_service"), "tpl": ("Orders", "http_service_url_template"), "met": ("GET", "http_service_method"),
    }
    expected |= {"sale:object_module": ("ObjectModule", "module"), "sale:object_module:procedure:Posting": ("Posting", "procedure"), "stock": ("Stock", "metadata.accumulation_register"), "open": ("Open", "metadata.command"), "open:command_module": ("CommandModule", "module"), "open:command_module:procedure:CommandProcessing": ("CommandProcessing", "procedure")}
    schema = "data_composition:schema;owner#6:report;name#4:Main"
    data_set = f"data_composition:data_set;owner#{len(schema)}:{schema};name#3:Set"
    expected |= {schema: ("Main", "data_composition_schema"), data_set: ("Set", "data_set"), f"data_composition:field;owner#{len(data_set)}:{data_set};name#3:Sum": ("Sum", "data_composition_field"), f"data_composition:query;owner#{len(data_set)}:{data_set};role#5:query": ("Query", "query")}
    expected |= {f"sale:standard_attribute:{a}": (a, "standard_attribute") for a in projects.STANDARD_ATTRIBUTES}
    assert nodes == expected


def test_edges(project):
    found = {(r.source, r.kind, r.target) for r in project[1].graph.edges.filter("kind != 'contains'").collect()}
    right = "access_right:resource#5:goods;right#4:Read;row_restriction#10:WHERE Mine"
    fill = "goods:object_module:procedure:Fill"
    assert found == {
        ("price", "references", "sale"), ("price", "depends_on", "sale"), (fill, "calls", "common:common_module:procedure:Log"), (fill, "calls", "goods:object_module:procedure:Helper"),
        (f"{fill}:query:q", "reads", "goods"), (f"{fill}:query:q", "depends_on", "goods"), (right, "references", "goods"), ("seller:role", "grants", right),
        ("trade:subsystem", "includes", "goods"), ("retail:subsystem", "includes", "sale"), ("trade:subsystem", "includes", "retail:subsystem"),
        ("sub", "references", "sale"), ("sub", "references", "common:common_module:procedure:OnWrite"), ("sub", "triggers", "common:common_module:procedure:OnWrite"),
        ("op", "references", "xdto_type;owner#4:pack;name#4:Item"), ("par", "references", "xdto_type;owner#4:pack;name#4:Code"), ("api", "references", "pack"),
        ("sale:object_module:procedure:Posting", "writes", "stock"), ("open:command_module:procedure:CommandProcessing", "opens", "form1"),
        ("op", "references", "api:common_module:function:DoGet"), ("op", "triggers", "api:common_module:function:DoGet"),
    }
    owners = {r.child_id: r.owner_id for r in lookup.owner(project[1].graph).collect()}
    assert owners["part"] == "ts" and owners["met"] == "tpl" and owners["sale"] == "cfg" and "cfg" not in owners


def test_diagnostics_and_validity(project):
    problems = {(r.source_node, r.kind, r.code) for r in project[1].diagnostics.collect()}
    assert {("part", "metadata_reference", "missing_target"), ("trade:subsystem", "subsystem_content", "missing_target"), ("trade:subsystem", "subsystem_content", "malformed_format"), ("common:common_module", "bsl", "malformed_declaration"), ("met", "service_callable", "missing_target")} <= problems
    assert {("sale:object_module:procedure:Posting", "register_write", "undeclared_register"), ("sale:object_module", "register_write", "collection_level_write"), ("sale:object_module", "register_write", "expression_remainder"), ("open:command_module:procedure:CommandProcessing", "form_navigation", "missing_target"), ("open:command_module", "form_navigation", "dynamic_first_argument")} <= problems
    assert any(kind == "xml" for _, kind, _ in problems)
    issues = validate.validate(project[1].graph)
    assert validate.is_valid(issues), issues.collect()
    totals = {(r.section, r.metric): r.value for r in report.graph_report(project[1].graph).filter("key = ''").collect()}
    assert totals["nodes", "total"] == 51 and totals["edges", "missing_targets"] == 0


def test_discovery(spark):
    paths = ["a/.project", "a/src/Configuration/Configuration.mdo", "a/sub/.project", "a/sub/src/Configuration/Configuration.mdo", "b/ConfigDumpInfo.xml", "b/Configuration.xml", "c/.project", "node_modules/d/.project", "node_modules/d/src/Configuration/Configuration.mdo", "e/.project", "e/src/Configuration/Configuration.mdo", "e/ConfigDumpInfo.xml", "e/Configuration.xml"]
    rows = {(r.root, r.format, r.error) for r in projects.discover(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert rows == {("a", "edt", None), ("b", "designer", None), ("e", None, "conflicting_markers")}


def test_elements_of_bad_and_empty_files(spark):
    rows = xml.elements(spark.createDataFrame([("a", bytearray(b"<x/>")), ("b", bytearray(b"")), ("c", bytearray(b"<x>"))], "path string, content binary")).collect()
    assert {r.path: r.error is None for r in rows} == {"a": True, "b": False, "c": False}


def test_export(spark, tmp_path):
    root = tmp_path / "dump"
    head = '<MetaDataObject xmlns="urn:m" version="2.20"><{0} uuid="{1}"><Properties><Name>{2}</Name></Properties></{0}></MetaDataObject>'
    for name, text in {"Configuration.xml": head.format("Configuration", "cfg", "Shop"), "ConfigDumpInfo.xml": "<i/>", "Catalogs/Goods.xml": "\ufeff" + head.format("Catalog", "goods", "Goods"), "Catalogs/Goods/Ext/ObjectModule.bsl": "\ufeffProcedure A()\r\nEndProcedure\r\n", "CommonModules/Lib.xml": head.format("CommonModule", "lib", "Lib"), "CommonModules/Lib/Ext/Module.bsl": "Function B() Export\rEndFunction\rProcedure"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    project = projects.read_export(spark, str(root))
    assert {(r.source, r.target) for r in project.graph.edges.collect()} == {("cfg", "goods"), ("cfg", "lib"), ("goods", "goods:object_module"), ("lib", "lib:common_module"), ("goods:object_module", "goods:object_module:procedure:A"), ("lib:common_module", "lib:common_module:function:B")}
    assert [r.code for r in project.diagnostics.collect()] == ["malformed_declaration"]


def test_watching_publishes_whole_snapshots(spark, tmp_path):
    root, store, events = tmp_path / "p" / "shop", str(tmp_path / "store"), []
    for name in (".project", "src/Configuration/Configuration.mdo", "src/Catalogs/Goods/Goods.mdo"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(FILES[name], encoding="utf-8")

    def run():
        watch.watch(spark, str(root), store, str(tmp_path / "checkpoint"), lambda n, outcome: events.append(outcome), once=True).awaitTermination(120)

    run()
    assert len(events) == 1 and watch.published(spark, store).nodes.filter("id = 'goods'").count() == 1
    run()
    assert len(events) == 1 and watch.rebuild(spark, str(root), store) is None
    new = root / "src/CommonModules/Common/Common.mdo"
    new.parent.mkdir(parents=True)
    new.write_text(FILES["src/CommonModules/Common/Common.mdo"], encoding="utf-8")
    run()
    assert len(events) == 2 and watch.published(spark, store).nodes.filter("id = 'common'").count() == 1


def test_watching_hears_of_edits_and_deletions(spark, tmp_path):
    root, store, events = tmp_path / "p" / "shop", str(tmp_path / "store"), []
    for name in (".project", "src/Configuration/Configuration.mdo", "src/Catalogs/Goods/Goods.mdo", "src/CommonModules/Common/Common.mdo"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(FILES[name], encoding="utf-8")

    def run():
        watch.watch(spark, str(root), store, str(tmp_path / "checkpoint"), lambda n, outcome: events.append(outcome), once=True).awaitTermination(120)
        return {r.id: r.name for r in watch.published(spark, store).nodes.collect()}

    assert {"goods", "common"} <= run().keys() and len(events) == 1
    goods = root / "src/Catalogs/Goods/Goods.mdo"
    goods.write_text(goods.read_text(encoding="utf-8").replace("<name>Goods</name>", "<name>Wares</name>"), encoding="utf-8")
    assert run()["goods"] == "Wares" and len(events) == 2
    (root / "src/CommonModules/Common/Common.mdo").unlink()
    assert "common" not in run() and len(events) == 3
    assert "common" not in run() and len(events) == 3


def test_semicolons_and_slashes_within_strings(spark):
    text = 'Procedure Open()\n  OpenForm("a;b//c"); OpenForm("e1cib/list/Catalog.Goods"); // OpenForm("x")\n  Message("http://a;b"); OpenForm("d")\nEndProcedure'
    modules = spark.createDataFrame([("m", "M", text, "command_module", "command")], "module_id string, module_name string, text string, role string, owner_kind string")
    found = [r.statement for r in statements._statements(modules).orderBy("line", "statement").collect()]
    assert found == ['OpenForm("a;b//c")', 'OpenForm("e1cib/list/Catalog.Goods")', 'Message("http://a;b")', 'OpenForm("d")']


def test_rights_types_and_packages_that_lead_nowhere(spark, tmp_path):
    root = tmp_path / "p" / "shop"
    names = (".project", "src/Configuration/Configuration.mdo", "src/Catalogs/Goods/Goods.mdo", "src/Roles/Seller/Seller.mdo", "src/Roles/Seller/Rights.rights", "src/WebServices/Api/Api.mdo")
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(FILES[name], encoding="utf-8")
    right = "<object><name>{}</name><right><name>Read</name><value>true</value></right></object>"
    rights = root / "src/Roles/Seller/Rights.rights"
    rights.write_text(rights.read_text().replace("</Rights>", right.format("Catalog.Gone") + right.format("Subsystem.Trade") + right.format("Catalog.Goods") * 2 + "</Rights>"))
    project = projects.read_project(spark, str(root))
    problems = {(r.source_node, r.kind, r.reference, r.code) for r in project.diagnostics.collect()}
    assert {("seller:role", "role_right", "Catalog.Gone", "missing_target"), ("seller:role", "role_right", "Subsystem.Trade", "unsupported_resource"), ("api", "service_package", "Pack", "missing_target"), ("op", "service_type", "{urn:p}Item", "missing_target"), ("par", "service_type", "{urn:p}Code", "missing_target")} <= problems
    assert project.graph.edges.filter("kind = 'grants'").count() == 2


def test_payloads_and_extensions(spark, tmp_path):
    root = tmp_path / "p" / "shop"
    files = {
        ".project": "<projectDescription/>",
        "src/Configuration/Configuration.mdo": mdo("Configuration", "cfg", "<name>Shop</name>"),
        "src/Catalogs/Base/Base.mdo": mdo("Catalog", "base", "<name>Base</name><synonym><key>en</key><content>The base</content></synonym><synonym><key>de</key><content>Basis</content></synonym><attributes uuid='at'><name>A</name><synonym><content>An attribute</content></synonym></attributes>"),
        "src/Catalogs/Own/Own.mdo": mdo("Catalog", "own", "<name>Own</name><objectBelonging>Adopted</objectBelonging><extendedConfigurationObject>base</extendedConfigurationObject>"),
        "src/Catalogs/Other/Other.mdo": mdo("Catalog", "other", "<name>Other</name><extendedConfigurationObject>base</extendedConfigurationObject>"),
        "src/Documents/Sale/Sale.mdo": mdo("Document", "sale", "<name>Sale</name><objectBelonging>Adopted</objectBelonging><extendedConfigurationObject>base</extendedConfigurationObject><registerRecords>AccumulationRegister.B</registerRecords><registerRecords>AccumulationRegister.A</registerRecords>"),
        "src/EventSubscriptions/Sub/Sub.mdo": mdo("EventSubscription", "sub", "<name>Sub</name><event>OnWrite</event>"),
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    g = projects.read_project(spark, str(root)).graph
    payloads = {r.id: r.payload for r in g.nodes.collect()}
    assert payloads["base"].metadata.synonym == "The base" and payloads["at"].member.synonym == "An attribute" and payloads["own"] is None
    assert [(r.target_kind, r.target_name) for r in payloads["sale"].metadata.register_records] == [("AccumulationRegister", "B"), ("AccumulationRegister", "A")] and payloads["sub"].metadata.event == "OnWrite"
    assert g.nodes.filter(~payload_fits()).count() == 0
    assert {(r.source, r.target) for r in g.edges.filter("kind = 'extends'").collect()} == {("own", "base")}
    renamed = g.nodes.withColumn("payload", F.when(F.col("id") == "base", F.lit(None)).otherwise(F.col("payload")))
    assert [(r.id, r.aspects) for r in diff.diff_nodes(g, Graph(renamed, g.edges)).collect()] == [("base", "semantic_content")]
