"""Project folders as a graph: descriptors, modules, rights, subsystems, subscriptions, reports and services.

A project is read as three tables: the elements of its XML files, the texts of its modules, and the paths of all
files. Every reader is a query over them, and resolution is a join once all declarations are there. What can't be
read or resolved becomes a row of `diagnostics`, never an exception.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import access_right_id, access_right_name, data_composition_id, xdto_type_id
from tessera.graph import Graph
from tessera.schema import PAYLOAD, PROVENANCE
from tessera.sources import bsl, query_language, references, statements, xml
from tessera.storage import settled

# Folders of object families, children that descriptors list, and module files.
FAMILIES = {
    "Catalogs": "catalog", "Documents": "document", "Enums": "enumeration", "CommonModules": "common_module", "Reports": "report", "DataProcessors": "data_processor",
    "InformationRegisters": "information_register", "AccumulationRegisters": "accumulation_register", "AccountingRegisters": "accounting_register", "CalculationRegisters": "calculation_register",
    "BusinessProcesses": "business_process", "Tasks": "task", "Roles": "role", "CommonCommands": "command", "CommonForms": "common_form", "CommonTemplates": "template",
    "HTTPServices": "http_service", "WebServices": "web_service", "XDTOPackages": "xdto_package", "Subsystems": "subsystem", "EventSubscriptions": "event_subscription",
    "Configuration": "configuration",
}
CHILDREN = {"attributes": "attribute", "attribute": "attribute", "tabularSections": "tabular_section", "tabularSection": "tabular_section", "dimensions": "dimension", "dimension": "dimension", "resources": "resource", "resource": "resource", "forms": "form", "form": "form", "commands": "command", "command": "command"}
MODULES = {"ObjectModule.bsl": ("object_module", "ObjectModule"), "ManagerModule.bsl": ("manager_module", "ManagerModule"), "Module.bsl": ("common_module", None), "CommandModule.bsl": ("command_module", "CommandModule"), "RecordSetModule.bsl": ("record_set_module", "RecordSetModule")}
STANDARD_ATTRIBUTES = ("Ref", "DeletionMark", "Date", "Number", "Posted")
MARKERS = (".project", "src/Configuration/Configuration.mdo")
SKIPPED = (".git", ".idea", ".vscode", "target", "node_modules")


@dataclass(frozen=True)
class Project:
    graph: Graph
    diagnostics: DataFrame
    modules: DataFrame


def discover(paths: DataFrame, max_depth: int = 6) -> DataFrame:
    """Project roots among file `path`s: `root`, `format` (edt, designer) and `error` where both markers are there.

    A folder below a root is no root, and skipped folders hold none.
    """
    skip = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    p = F.col("path")
    marks = paths.filter(~p.rlike(skip)).select(
        F.when(p.endswith("/" + MARKERS[1]) | (p == MARKERS[1]), F.regexp_replace(p, f"/?{MARKERS[1]}$", "")).when(p.rlike("(^|/)(\\.project|ConfigDumpInfo\\.xml|Configuration\\.xml)$"), F.regexp_replace(p, "/?[^/]+$", "")).alias("root"),
        F.element_at(F.split(p, "/"), -1).alias("file"),
    )
    by_root = marks.filter("root is not null").groupBy("root").agg(F.collect_set("file").alias("files"))
    edt = F.array_contains("files", ".project") & F.array_contains("files", "Configuration.mdo")
    designer = F.array_contains("files", "ConfigDumpInfo.xml") & F.array_contains("files", "Configuration.xml")
    depth = F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/")))
    found = by_root.select("root", F.when(edt & designer, F.lit(None)).when(edt, "edt").when(designer, "designer").alias("format"), F.when(edt & designer, "conflicting_markers").alias("error"), (edt | designer).alias("_is")).filter(F.col("_is") & (depth <= max_depth)).drop("_is")
    above = found.select(F.col("root").alias("_above"))
    folders = found.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("root", "/")) - 1), lambda i: F.array_join(F.slice(F.split("root", "/"), F.lit(1), i), "/"))).alias("_above"))
    nested = folders.filter("_above != root").join(above, "_above", "left_semi").select("root").distinct()
    return found.join(nested, "root", "left_anti")


def _provenance(path: Column, origin: str, confidence: str = "exact", resolution: str = "not_applicable") -> Column:
    none = F.lit(None).cast("int")
    record = F.struct(
        path.alias("source"), path.alias("path"), none.alias("start_line"), none.alias("start_col"), none.alias("end_line"), none.alias("end_col"),
        F.lit("projects").alias("producer"), F.lit(origin).alias("origin"), F.lit(confidence).alias("confidence"), F.lit(resolution).alias("resolution"),
    )
    return F.array(record).cast(PROVENANCE)


# Fixed value: the namespace of built-in types.
PLATFORM_TYPES = "http://www.w3.org/2001/XMLSchema"


def _payload(tag: str | Column, variant: str, **values: Column) -> Column:
    """A payload of one variant; null where all its values are."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    whole = F.to_json(F.struct(tag.alias("tag"), F.struct(*(v.alias(k) for k, v in values.items())).alias(variant)))
    some = None
    for v in values.values():
        some = v.isNotNull() if some is None else some | v.isNotNull()
    return F.when(some, F.from_json(whole, PAYLOAD))


def _node(df: DataFrame, id_: Column, name: Column, kind: str | Column, metadata_kind: Column | None = None, origin: str = "declared", payload: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    payload = F.lit(None).cast(PAYLOAD) if payload is None else payload
    return df.select(payload.alias("payload"), id_.alias("id"), name.alias("name"), kind.alias("kind"), (F.lit(None).cast("string") if metadata_kind is None else metadata_kind).alias("metadata_kind"), _provenance(F.col("path"), origin).alias("provenance"))


def _edge(df: DataFrame, source: Column, target: Column, kinds: list[str], resolved: bool = False) -> DataFrame:
    provenance = _provenance(F.col("path"), "resolved", "high", "resolved") if resolved else _provenance(F.col("path"), "declared")
    return df.select(source.alias("source"), target.alias("target"), F.explode(F.array(*map(F.lit, kinds))).alias("kind"), provenance.alias("provenance"))


def _child_text(elements: DataFrame, tag: str, name: str) -> DataFrame:
    """`path`, `node` of the parent and the text of its (first) child called `tag`."""
    return elements.filter(F.col("tag") == tag).groupBy("path", F.col("parent").alias("node")).agg(F.min_by("text", "node").alias(name))


def _synonyms(elements: DataFrame) -> DataFrame:
    """`path`, `node` and the first `synonym` that an element states."""
    held = elements.filter("tag = 'synonym'").select("path", F.col("node").alias("_synonym"), F.col("parent").alias("node"))
    stated = elements.filter("tag = 'content'").select("path", F.col("node").alias("_at"), F.col("parent").alias("_synonym"), "text")
    return held.join(stated, ["path", "_synonym"]).groupBy("path", "node").agg(F.min_by("text", "_at").alias("synonym"))


def _facts(elements: DataFrame) -> DataFrame:
    """By `path` of a descriptor: what it states of its object besides the name, and the object that it extends."""
    first = lambda tag: F.min_by(F.when(F.col("tag") == tag, F.col("text")), F.when(F.col("tag") == tag, F.col("node")))
    record = F.when(F.col("tag") == "registerRecords", F.struct("node", F.substring_index("text", ".", 1).alias("target_kind"), F.regexp_extract("text", r"^[^.]*\.(.+)$", 1).alias("target_name")))
    top = elements.filter("depth = 1 and path like '%.mdo'").groupBy("path").agg(
        first("event").alias("event"), first("rootURL").alias("root_url"), first("namespace").alias("namespace"), F.array_sort(F.collect_list(record)).alias("records"),
        first("objectBelonging").alias("belonging"), F.trim(first("extendedConfigurationObject")).alias("extended_id"),
    )
    records = F.transform("records", lambda r: F.struct(r["target_kind"].alias("target_kind"), r["target_name"].alias("target_name")))
    top = top.withColumn("register_records", F.when(F.size("records") > 0, records)).withColumn("extended_id", F.when(F.lower("belonging") == "adopted", F.col("extended_id")))
    return top.drop("records", "belonging").join(_synonyms(elements).filter("node = 0").drop("node"), "path", "full_outer")


def _objects(elements: DataFrame) -> DataFrame:
    """Top descriptors: `path`, `folder`, `id`, `name`, `metadata_kind`."""
    p = F.split("path", "/")
    family = F.element_at(F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair]), F.when(F.element_at(p, -2) == "Configuration", F.lit("Configuration")).otherwise(F.get(p, F.size(p) - 3)))
    roots = elements.filter("depth = 0 and path like '%.mdo' and uuid is not null").select("path", "node", F.col("uuid").alias("id"), family.alias("metadata_kind"))
    return roots.join(_child_text(elements, "name", "name"), ["path", "node"]).filter("metadata_kind is not null").withColumn("folder", F.regexp_replace("path", "/[^/]+$", "")).drop("node")


def read_project(spark: SparkSession, root: str) -> Project:
    """The graph of the project in a folder, in the layout with one `.mdo` descriptor for each object."""
    found = xml.files(spark, root)
    is_xml = F.col("path").rlike(r"\.(mdo|rights|dcs|xdto)$")
    elements = settled(xml.elements(found.filter(is_xml)))
    texts = found.filter(F.col("path").endswith(".bsl")).select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"))
    return build(elements, texts)


def build(elements: DataFrame, texts: DataFrame) -> Project:
    """The graph of `elements` (see `xml.elements`) and module `texts` (`path`, `text`)."""
    col, lit = F.col, F.lit
    objects = _objects(elements)
    nodes, edges, problems = [], [], []
    configuration = objects.filter("metadata_kind = 'configuration'").agg(F.min("id").alias("configuration_id"))
    known = objects.join(_facts(elements), "path", "left")
    records = F.when(col("metadata_kind") == "document", col("register_records"))
    event, root_url = F.when(col("metadata_kind") == "event_subscription", col("event")), F.when(col("metadata_kind") == "http_service", col("root_url"))
    stated = _payload("metadata", "metadata", synonym=col("synonym"), register_records=records, event=event, root_url=root_url, namespace=F.when(col("metadata_kind").isin("web_service", "xdto_package"), col("namespace")))
    nodes.append(_node(known, col("id"), col("name"), "metadata", col("metadata_kind"), payload=stated))
    adopted = known.filter("extended_id is not null and extended_id != id").join(objects.select(col("id").alias("extended_id"), col("metadata_kind").alias("_kind")), "extended_id").filter("_kind = metadata_kind")
    edges.append(_edge(adopted, col("id"), col("extended_id"), ["extends"], resolved=True))
    others = objects.filter("metadata_kind != 'configuration'").join(F.broadcast(configuration))  # one row
    edges.append(_edge(others.filter("configuration_id is not null"), col("configuration_id"), col("id"), ["contains"]))
    for kind in ("role", "subsystem"):
        own = objects.filter(col("metadata_kind") == kind)
        nodes.append(_node(own, F.concat("id", lit(f":{kind}")), col("name"), kind))
    targets = objects.select(col("metadata_kind").alias("target_kind"), col("name").alias("target_name"), col("id").alias("target_id"))

    # Children of objects and of tabular sections, their types and the standard attributes of documents.
    child_kind = F.element_at(F.create_map(*[lit(x) for pair in CHILDREN.items() for x in pair]), col("tag"))
    listed = elements.filter(col("tag").isin(*CHILDREN) & (col("depth") <= 2) & col("path").endswith(".mdo")).select("path", "node", "parent", "depth", "uuid", child_kind.alias("child_kind"))
    children = listed.join(_child_text(elements, "name", "name"), ["path", "node"]).join(objects.select("path", col("id").alias("owner_id"), col("metadata_kind").alias("owner_kind")), "path")
    children = children.withColumn("child_kind", F.when((col("owner_kind") == "accounting_register") & (col("child_kind") == "resource"), "measure").otherwise(col("child_kind")))
    above = children.filter("depth = 1").select("path", col("node").alias("parent"), F.coalesce("uuid", F.concat_ws(":", "owner_id", "child_kind", "name")).alias("section_id"))
    children = children.join(above, ["path", "parent"], "left").filter("depth = 1 or section_id is not null").withColumn("direct_owner", F.coalesce("section_id", "owner_id"))
    children = children.withColumn("id", F.when(col("child_kind") == "measure", F.concat_ws(":", "direct_owner", "child_kind", "name")).otherwise(F.coalesce("uuid", F.concat_ws(":", "direct_owner", "child_kind", "name"))))
    named = children.join(_synonyms(elements), ["path", "node"], "left")
    nodes.append(_node(named, col("id"), col("name"), col("child_kind"), payload=F.when(col("child_kind").isin("attribute", "tabular_section"), _payload("member", "member", synonym=col("synonym")))))
    edges.append(_edge(children, col("direct_owner"), col("id"), ["contains"]))
    documents = objects.filter("metadata_kind = 'document'").select("path", col("id").alias("owner_id"), F.explode(F.array(*map(lit, STANDARD_ATTRIBUTES))).alias("name"))
    nodes.append(_node(documents, F.concat_ws(":", "owner_id", lit("standard_attribute"), "name"), col("name"), "standard_attribute"))
    edges.append(_edge(documents, col("owner_id"), F.concat_ws(":", "owner_id", lit("standard_attribute"), "name"), ["contains"]))
    typed = elements.filter("tag = 'types'").join(elements.select("path", col("node").alias("parent"), col("parent").alias("child_node"), col("tag").alias("holder")), ["path", "parent"])
    typed = typed.filter(col("holder").isin("type", "commandParameterType")).select("path", col("child_node").alias("node"), references.type_reference(col("text")).alias("r"))
    typed = typed.join(children.select("path", "node", "id", "child_kind"), ["path", "node"]).filter("r.outcome = 'supported' and child_kind in ('attribute', 'dimension', 'resource', 'command')")
    _resolved(typed.select("path", col("id").alias("source_id"), "r.kind", "r.name"), targets, ["references", "depends_on"], "metadata_reference", edges, problems)

    # Modules and their symbols, calls and queries.
    module_rows = _modules(texts, objects, children)
    nodes.append(_node(module_rows, col("module_id"), col("module_name"), "module"))
    edges.append(_edge(module_rows, col("owner_id"), col("module_id"), ["contains"]))
    module_rows = settled(module_rows)
    modules = module_rows.select("module_id", "module_name", "text", "path")
    module_path = modules.select("module_id", "path")
    symbols = bsl.declarations(modules).join(module_path, "module_id")
    nodes.append(_node(symbols.filter("error is null"), col("symbol_id"), col("name"), col("kind"), origin="parsed"))
    edges.append(_edge(symbols.filter("error is null"), col("module_id"), col("symbol_id"), ["contains"]))
    problems.append(symbols.filter("error is not null").select(col("module_id").alias("source_node"), lit("bsl").alias("kind"), F.concat(lit("line "), col("line").cast("string")).alias("reference"), col("error").alias("code")))
    calls = bsl.calls(modules)
    for resolved in (bsl.resolve_local_calls(calls, symbols), bsl.resolve_qualified_calls(calls, symbols, modules)):
        made = resolved.filter("target_id is not null and source_id != target_id").join(module_path, "module_id")
        edges.append(_edge(made.select("path", "source_id", "target_id").distinct(), col("source_id"), col("target_id"), ["calls"], resolved=True))
    queries = bsl.queries(modules).filter("error is null").withColumn("path", F.substring_index("owner_id", ":", 1))
    nodes.append(_node(queries, col("query_id"), col("binding"), "query", origin="parsed"))
    edges.append(_edge(queries, col("owner_id"), col("query_id"), ["contains"]))
    read = query_language.read_queries(queries)
    sources = read.filter("code is null").select(col("query_id").alias("path"), col("query_id").alias("source_id"), col("category").alias("kind"), "name")
    _resolved(sources, targets, ["reads", "depends_on"], "query_source", edges, problems, folded=True)
    problems.append(read.filter("code is not null").select(col("query_id").alias("source_node"), lit("query_language").alias("kind"), lit("").alias("reference"), "code"))

    _effects(module_rows, objects, children, elements, targets, edges, problems)

    # Rights of roles, contents of subsystems, subscriptions.
    _rights(elements, objects, targets, nodes, edges, problems)
    contents = elements.filter("tag = 'content' and depth = 1 and path like '%.mdo'").select("path", references.subsystem_token(col("text")).alias("r")).distinct().join(objects.filter("metadata_kind = 'subsystem'").select("path", F.concat("id", lit(":subsystem")).alias("source_id")), "path")
    _resolved(contents.filter("r.outcome = 'supported'").select("path", "source_id", "r.kind", "r.name"), targets, ["includes"], "subsystem_content", edges, problems)
    problems.append(contents.filter("r.outcome != 'supported'").select(col("source_id").alias("source_node"), lit("subsystem_content").alias("kind"), lit("").alias("reference"), col("r.reason").alias("code")))
    nested = objects.filter("metadata_kind = 'subsystem'").select("path", F.concat("id", lit(":subsystem")).alias("target_id"), F.regexp_replace("folder", "/Subsystems/[^/]+$", "").alias("above"))
    parents = objects.filter("metadata_kind = 'subsystem'").select(col("folder").alias("above"), F.concat("id", lit(":subsystem")).alias("source_id"))
    edges.append(_edge(nested.join(parents, "above"), col("source_id"), col("target_id"), ["includes"], resolved=True))
    _subscriptions(elements, objects, targets, modules, symbols, edges, problems)
    _reports(elements, objects, nodes, edges)
    _services(elements, objects, symbols, nodes, edges, problems)

    # Every operator reads the graph many times: the readers run once, and what they found is kept.
    found_nodes, found_edges = settled(_in_order(nodes)), settled(_evidence(_in_order(edges)))
    graph, refused = Graph.inserted(found_nodes, found_edges)
    graph = Graph(settled(graph.nodes), settled(graph.edges))
    problems.append(refused.select(col("source").alias("source_node"), lit("edge").alias("kind"), col("target").alias("reference"), lit("missing_node").alias("code")))
    broken = elements.filter("error is not null").select(col("path").alias("source_node"), lit("xml").alias("kind"), col("error").alias("reference"), lit("malformed_xml").alias("code"))
    return Project(graph, settled(_stacked([*problems, broken])), modules)


def _stacked(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _in_order(frames: list[DataFrame]) -> DataFrame:
    """All rows with `ingest_seq`, the place of their frame; within a frame the order is that of files and lines."""
    return _stacked([f.withColumn("ingest_seq", F.lit(i).cast("bigint")) for i, f in enumerate(frames)])


def _evidence(edges: DataFrame) -> DataFrame:
    """Each edge once, with the provenance of all its copies in order."""
    copies = edges.groupBy("source", "target", "kind").agg(F.array_sort(F.collect_list(F.struct("ingest_seq", "provenance"))).alias("_c"))
    return copies.select("source", "target", "kind", F.array_distinct(F.flatten(F.transform("_c", lambda c: c["provenance"]))).alias("provenance"), F.col("_c")[0]["ingest_seq"].alias("ingest_seq"))


def _resolved(refs: DataFrame, targets: DataFrame, kinds: list[str], what: str, edges: list, problems: list, folded: bool = False) -> None:
    """Edges of `refs` (`path`, `source_id`, `kind`, `name`) with one target, and problems of the others."""
    fold = F.lower if folded else (lambda c: F.col(c))
    t = targets.select(F.col("target_kind").alias("kind"), fold("target_name").alias("_name"), "target_id").groupBy("kind", "_name").agg(F.count("*").alias("n"), F.min("target_id").alias("target_id"))
    found = refs.withColumn("_name", fold("name")).join(t, ["kind", "_name"], "left")
    edges.append(_edge(found.filter("n = 1"), F.col("source_id"), F.col("target_id"), kinds, resolved=True))
    code = F.when(F.col("n").isNull(), "missing_target").otherwise("ambiguous_target")
    problems.append(found.filter("n is null or n > 1").select(F.col("source_id").alias("source_node"), F.lit(what).alias("kind"), F.concat_ws(".", "kind", "name").alias("reference"), code.alias("code")))


def _modules(texts: DataFrame, objects: DataFrame, children: DataFrame) -> DataFrame:
    """`path`, `text`, `owner_id`, `module_id`, `module_name` of module files: beside a descriptor, or in the folder of a form or command."""
    file = F.element_at(F.split("path", "/"), -1)
    role = F.element_at(F.create_map(*[x for k, (r, _) in MODULES.items() for x in (F.lit(k), F.lit(r))]), file)
    fixed = F.element_at(F.create_map(*[x for k, (_, n) in MODULES.items() if n for x in (F.lit(k), F.lit(n))]), file)
    folder = F.regexp_replace("path", "/[^/]+$", "")
    parts = F.split(folder, "/")
    below = F.element_at(parts, -2).isin("Forms", "Commands")
    rows = texts.select("path", "text", role.alias("role"), fixed.alias("fixed"), folder.alias("folder"), below.alias("below"), F.element_at(parts, -2).alias("group"), F.element_at(parts, -1).alias("child_name"), F.regexp_replace(folder, "/[^/]+/[^/]+$", "").alias("above")).filter("role is not null")
    own = rows.filter("not below").join(objects.select("folder", F.col("id").alias("owner_id"), F.col("name").alias("owner_name"), F.col("metadata_kind").alias("owner_kind")), "folder")
    own = own.select("path", "text", "owner_id", F.concat_ws(":", "owner_id", "role").alias("module_id"), F.coalesce("fixed", "owner_name").alias("module_name"), "role", "owner_kind")
    held = children.filter("child_kind in ('form', 'command')").join(objects.select("path", "folder"), "path").select(F.col("folder").alias("above"), F.col("name").alias("child_name"), "child_kind", F.col("id").alias("owner_id"))
    group = F.when(F.col("child_kind") == "form", "Forms").otherwise("Commands")
    nested = rows.filter("below").join(held.withColumn("group", group), ["above", "child_name", "group"])
    nested = nested.select("path", "text", "owner_id", F.concat("owner_id", F.lit(":"), F.col("child_kind"), F.lit("_module")).alias("module_id"), F.when(F.col("child_kind") == "form", "FormModule").otherwise("CommandModule").alias("module_name"), F.concat("child_kind", F.lit("_module")).alias("role"), F.col("child_kind").alias("owner_kind"))
    return own.unionByName(nested)


def _effects(module_rows: DataFrame, objects: DataFrame, children: DataFrame, elements: DataFrame, targets: DataFrame, edges: list, problems: list) -> None:
    """Registers that procedures write, as their document declares them, and forms that commands open."""
    col = F.col
    written = statements.register_writes(module_rows).join(module_rows.select("module_id", "owner_id", "path"), "module_id")
    declared = elements.filter("tag = 'registerRecords' and depth = 1").select("path", references.register_record(col("text")).alias("r")).filter("r.outcome = 'supported'")
    declared = declared.join(objects.select("path", col("id").alias("owner_id")), "path").select("owner_id", F.lower("r.name").alias("_name")).distinct()
    registers = targets.filter("target_kind = 'accumulation_register'").groupBy(F.lower("target_name").alias("_name")).agg(F.count("*").alias("n"), F.min("target_id").alias("target_id"))
    found = written.filter("reason is null").withColumn("_name", F.lower("register")).join(declared.withColumn("_declared", F.lit(True)), ["owner_id", "_name"], "left").join(registers, "_name", "left")
    edges.append(_edge(found.filter("_declared and n = 1").select("path", "symbol_id", "target_id").distinct(), col("symbol_id"), col("target_id"), ["writes"], resolved=True))
    code = F.when(col("_declared").isNull(), "undeclared_register").when(col("n").isNull(), "missing_target").otherwise("ambiguous_target")
    problems.append(found.filter("_declared is null or n is null or n > 1").select(col("symbol_id").alias("source_node"), F.lit("register_write").alias("kind"), col("register").alias("reference"), code.alias("code")))
    opened = statements.form_openings(module_rows).join(module_rows.select("module_id", "path"), "module_id")
    common = objects.filter("metadata_kind = 'common_form'").select(col("metadata_kind").alias("_kind"), col("name").alias("_name"), col("id").alias("form_id"))
    owners = objects.select("path", col("metadata_kind").alias("_kind"), col("name").alias("_owner"))
    own = children.filter("child_kind = 'form'").select("path", col("name").alias("_form"), col("id").alias("form_id")).join(owners, "path").select("_kind", F.concat_ws(".", "_owner", "_form").alias("_name"), "form_id")
    forms = common.unionByName(own)
    found = opened.filter("reason is null").join(forms, (col("target.kind") == col("_kind")) & (col("target.name") == col("_name")), "left")
    edges.append(_edge(found.filter("form_id is not null").select("path", "symbol_id", "form_id").distinct(), col("symbol_id"), col("form_id"), ["opens"], resolved=True))
    problems.append(found.filter("form_id is null").select(col("symbol_id").alias("source_node"), F.lit("form_navigation").alias("kind"), F.concat_ws(".", "target.kind", "target.name").alias("reference"), F.lit("missing_target").alias("code")))
    for what, rows in (("register_write", written), ("form_navigation", opened)):
        problems.append(rows.filter("reason is not null").select(col("module_id").alias("source_node"), F.lit(what).alias("kind"), F.concat(F.lit("line "), col("line").cast("string")).alias("reference"), col("reason").alias("code")))


def read_export(spark: SparkSession, root: str) -> Project:
    """The graph of a hierarchical export: one XML file for each object and modules in its `Ext` folder.

    Objects, modules and their declarations, each contained by its owner; nothing is resolved.
    """
    col = F.col
    found = xml.files(spark, root)
    elements = settled(xml.elements(found.filter(col("path").endswith(".xml") & ~col("path").contains("/Ext/"))))
    family = F.element_at(F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair]), F.when(col("path").rlike("(^|/)Configuration\\.xml$"), "Configuration").otherwise(F.element_at(F.split("path", "/"), -2)))
    heads = elements.filter("depth = 1 and uuid is not null").select("path", "node", col("uuid").alias("id"), family.alias("metadata_kind"))
    properties = elements.filter("tag = 'Properties' and depth = 2").select("path", col("node").alias("_properties"), col("parent").alias("node"))
    names = _child_text(elements, "Name", "name").withColumnRenamed("node", "_properties")
    objects = heads.join(properties, ["path", "node"]).join(names, ["path", "_properties"]).filter("metadata_kind is not null").withColumn("folder", F.regexp_replace("path", r"\.xml$", ""))
    role = F.when(col("path").endswith("/Ext/ObjectModule.bsl"), "object_module").when(col("path").endswith("/Ext/ManagerModule.bsl"), "manager_module").when(col("path").endswith("/Ext/Module.bsl"), "common_module")
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", ""), "\r\n?", "\n")
    texts = found.filter(col("path").endswith(".bsl")).select("path", role.alias("role"), F.regexp_replace("path", "/Ext/[^/]+$", "").alias("folder"), text.alias("text")).filter("role is not null")
    fixed = F.when(col("role") == "object_module", "ObjectModule").when(col("role") == "manager_module", "ManagerModule").otherwise(col("name"))
    modules = settled(texts.join(objects.select("folder", col("id").alias("owner_id"), "name"), "folder").select("path", "owner_id", F.concat_ws(":", "owner_id", "role").alias("module_id"), fixed.alias("module_name"), "text"))
    symbols = bsl.declarations(modules).join(modules.select("module_id", "path"), "module_id")
    declared = symbols.filter("error is null")
    configuration = objects.filter("metadata_kind = 'configuration'").agg(F.min("id").alias("configuration_id"))
    others = objects.filter("metadata_kind != 'configuration'").join(F.broadcast(configuration)).filter("configuration_id is not null")  # one row
    nodes = _stacked([_node(objects, col("id"), col("name"), "metadata", col("metadata_kind")), _node(modules, col("module_id"), col("module_name"), "module"), _node(declared, col("symbol_id"), col("name"), col("kind"), origin="parsed")])
    edges = _stacked([_edge(others, col("configuration_id"), col("id"), ["contains"]), _edge(modules, col("owner_id"), col("module_id"), ["contains"]), _edge(declared, col("module_id"), col("symbol_id"), ["contains"])])
    problems = symbols.filter("error is not null").select(col("module_id").alias("source_node"), F.lit("bsl").alias("kind"), F.concat(F.lit("line "), col("line").cast("string")).alias("reference"), col("error").alias("code"))
    broken = elements.filter("error is not null").select(col("path").alias("source_node"), F.lit("xml").alias("kind"), col("error").alias("reference"), F.lit("malformed_xml").alias("code"))
    return Project(Graph.of(settled(nodes), settled(edges)), settled(problems.unionByName(broken)), modules)


def _rights(elements: DataFrame, objects: DataFrame, targets: DataFrame, nodes: list, edges: list, problems: list) -> None:
    """Rights with value true: a right node for each resource, right and restriction, granted by the roles that have it.

    Rights to what can't be protected, or isn't there, are problems of the role.
    """
    at = elements.filter("path like '%.rights'")
    right = at.filter("tag = 'right'").select("path", "node", F.col("parent").alias("object"))
    names, values = _child_text(at, "name", "right"), _child_text(at, "value", "value")
    condition = at.filter("tag = 'condition'").join(at.select("path", F.col("node").alias("parent"), F.col("parent").alias("_right"), F.col("tag").alias("_above")), ["path", "parent"]).filter("_above = 'restrictionByCondition' and text != ''").groupBy("path", F.col("_right").alias("node")).agg(F.min_by("text", "node").alias("condition"))
    resource = _child_text(at, "name", "resource").withColumnRenamed("node", "object")
    found = right.join(names, ["path", "node"]).join(values, ["path", "node"]).filter("value = 'true'").join(condition, ["path", "node"], "left").join(resource, ["path", "object"])
    roles = objects.filter("metadata_kind = 'role'").select("folder", F.concat("id", F.lit(":role")).alias("role_id"))
    found = found.withColumn("folder", F.regexp_replace("path", "/[^/]+$", "")).join(roles, "folder")
    found = found.withColumn("r", references.protected_resource(F.col("resource")))
    found = found.join(targets.select(F.col("target_kind").alias("_kind"), F.col("target_name").alias("_name"), "target_id"), (F.col("r.kind") == F.col("_kind")) & (F.col("r.name") == F.col("_name")), "left")
    code = F.when(F.col("r.outcome") != "supported", "unsupported_resource").when(F.col("target_id").isNull(), "missing_target")
    problems.append(found.filter(code.isNotNull()).select(F.col("role_id").alias("source_node"), F.lit("role_right").alias("kind"), F.col("resource").alias("reference"), code.alias("code")))
    found = found.filter(code.isNull())
    found = found.withColumn("right_id", access_right_id("target_id", "right", "condition"))
    one = found.groupBy("right_id", "target_id", "right", "condition", "resource").agg(F.min("path").alias("path"))
    nodes.append(_node(one, F.col("right_id"), access_right_name("resource", "right", "condition"), "access_right", payload=_payload("access_right", "access_right", condition=F.col("condition"))))
    edges.append(_edge(one, F.col("right_id"), F.col("target_id"), ["references"], resolved=True))
    edges.append(_edge(found, F.col("role_id"), F.col("right_id"), ["grants"], resolved=True))


def _subscriptions(elements: DataFrame, objects: DataFrame, targets: DataFrame, modules: DataFrame, symbols: DataFrame, edges: list, problems: list) -> None:
    own = objects.filter("metadata_kind = 'event_subscription'").select("path", F.col("id").alias("source_id"))
    typed = elements.filter("tag = 'types' and depth = 2").join(own, "path").select("path", "source_id", references.event_source(F.col("text")).alias("r"))
    fits = (F.col("r.kind") == F.col("target_kind")) & (F.col("r.name").isNull() | (F.col("r.name") == F.col("target_name")))
    found = typed.filter("r.outcome = 'supported'").join(targets, fits, "left")
    edges.append(_edge(found.filter("target_id is not null"), F.col("source_id"), F.col("target_id"), ["references"], resolved=True))
    problems.append(found.filter("target_id is null").select(F.col("source_id").alias("source_node"), F.lit("event_source").alias("kind"), F.concat_ws(".", "r.kind", "r.name").alias("reference"), F.lit("missing_target").alias("code")))
    problems.append(typed.filter("r.outcome != 'supported'").select(F.col("source_id").alias("source_node"), F.lit("event_source").alias("kind"), F.lit("").alias("reference"), F.col("r.reason").alias("code")))
    handlers = elements.filter("tag = 'handler' and depth = 1").join(own, "path").select("path", "source_id", references.event_handler(F.col("text")).alias("r"))
    named = modules.select("module_id", F.col("module_name").alias("_module")).join(symbols.filter("kind = 'procedure' and error is null").select("module_id", F.col("name").alias("_procedure"), "symbol_id"), "module_id")
    found = handlers.filter("r.outcome = 'supported'").join(named, (F.col("r.kind") == F.col("_module")) & (F.col("r.name") == F.col("_procedure")), "left")
    edges.append(_edge(found.filter("symbol_id is not null"), F.col("source_id"), F.col("symbol_id"), ["references", "triggers"], resolved=True))
    problems.append(found.filter("symbol_id is null").select(F.col("source_id").alias("source_node"), F.lit("event_handler").alias("kind"), F.concat_ws(".", "r.kind", "r.name").alias("reference"), F.lit("missing_target").alias("code")))


def _reports(elements: DataFrame, objects: DataFrame, nodes: list, edges: list) -> None:
    """Data composition schemas of reports, their data sets, fields and (never parsed) query texts."""
    at = elements.filter("path like '%.dcs'")
    reports = objects.filter("metadata_kind = 'report'").select(F.col("folder").alias("_folder"), F.col("id").alias("owner_id"))
    schema = at.filter("depth = 0").select("path", F.regexp_replace("path", "/Templates/[^/]+/[^/]+$", "").alias("_folder"), F.element_at(F.split("path", "/"), -2).alias("name")).join(reports, "_folder")
    schema = schema.withColumn("schema_id", data_composition_id("schema", "owner_id", "name"))
    nodes.append(_node(schema, F.col("schema_id"), F.col("name"), "data_composition_schema"))
    edges.append(_edge(schema, F.col("owner_id"), F.col("schema_id"), ["contains"]))
    sets = at.filter("tag = 'dataSet' and depth = 1").select("path", "node", F.col("attributes")["type"].alias("type")).join(_child_text(at, "name", "set_name"), ["path", "node"]).join(schema.select("path", "schema_id"), "path")
    sets = sets.withColumn("set_id", data_composition_id("data_set", "schema_id", "set_name"))
    sets = sets.join(_child_text(at, "dataSource", "data_source"), ["path", "node"], "left")
    nodes.append(_node(sets, F.col("set_id"), F.col("set_name"), "data_set", payload=_payload("data_set", "data_set", kind=F.regexp_extract("type", r"([^:]*)$", 1), data_source=F.col("data_source"))))
    edges.append(_edge(sets, F.col("schema_id"), F.col("set_id"), ["contains"]))
    fields = at.filter("tag = 'field' and depth = 2").select("path", "node", F.col("parent").alias("_set"), F.col("attributes")["type"].alias("type")).filter(F.coalesce("type", F.lit("")).endswith("DataSetFieldField"))
    fields = fields.join(_child_text(at, "dataPath", "field_name"), ["path", "node"]).join(sets.select("path", F.col("node").alias("_set"), "set_id"), ["path", "_set"])
    fields = fields.withColumn("field_id", data_composition_id("field", "set_id", "field_name"))
    nodes.append(_node(fields, F.col("field_id"), F.col("field_name"), "data_composition_field", payload=_payload("field", "field", data_path=F.col("field_name"))))
    edges.append(_edge(fields, F.col("set_id"), F.col("field_id"), ["contains"]))
    queries = sets.filter("type like '%DataSetQuery'").join(_child_text(at, "query", "query"), ["path", "node"]).filter("trim(query) != ''").withColumn("query_id", data_composition_id("query", "set_id", F.lit("Query")))
    nodes.append(_node(queries, F.col("query_id"), F.lit("Query"), "query"))
    edges.append(_edge(queries, F.col("set_id"), F.col("query_id"), ["contains"]))


def _services(elements: DataFrame, objects: DataFrame, symbols: DataFrame, nodes: list, edges: list, problems: list) -> None:
    """Types of packages, templates and methods of HTTP services, operations and parameters of web services."""
    col = F.col
    packages = objects.filter("metadata_kind = 'xdto_package'").select("folder", col("id").alias("owner_id"))
    package = elements.filter("path like '%.xdto' and depth = 0").select("path", col("attributes")["targetNamespace"].alias("ns"), F.regexp_replace("path", "/[^/]+$", "").alias("folder")).join(packages, "folder")
    types = elements.filter("path like '%.xdto' and depth = 1 and tag in ('valueType', 'objectType')").select("path", col("tag").alias("type_kind"), col("attributes")["name"].alias("name")).join(package, "path").withColumn("id", xdto_type_id("owner_id", "name"))
    nodes.append(_node(types, col("id"), col("name"), "xdto_type", payload=_payload("xdto_type", "xdto_type", kind=F.when(col("type_kind") == "valueType", "value").otherwise("object"))))
    edges.append(_edge(types, col("owner_id"), col("id"), ["contains"]))

    def level(tag: str, kind: str, parents: DataFrame) -> DataFrame:
        found = elements.filter(col("tag") == tag).select("path", "node", "parent", "uuid").join(_child_text(elements, "name", "name"), ["path", "node"])
        found = found.join(parents.select("path", col("node").alias("parent"), "owner_id", "service_id"), ["path", "parent"]).withColumn("id", F.coalesce("uuid", F.concat_ws(":", "owner_id", F.lit(kind), "name")))
        variant, held = {"http_service_method": ("http_method", "httpMethod"), "http_service_url_template": ("url_template", "template")}.get(kind, (None, None))
        stated = found.join(_child_text(elements, held, "_stated"), ["path", "node"], "left") if variant else found
        nodes.append(_node(stated, col("id"), col("name"), kind, payload=_payload(variant, variant, **{"http_method" if variant == "http_method" else "template": col("_stated")}) if variant else None))
        edges.append(_edge(found, col("owner_id"), col("id"), ["contains"]))
        return found

    def tops(kind: str) -> DataFrame:
        return objects.filter(col("metadata_kind") == kind).select("path", F.lit(0).alias("node"), col("id").alias("owner_id"), col("id").alias("service_id"))

    as_parent = lambda df: df.select("path", "node", col("id").alias("owner_id"), "service_id")
    methods = level("methods", "http_service_method", as_parent(level("urlTemplates", "http_service_url_template", tops("http_service"))))
    operations = level("operations", "web_service_operation", tops("web_service"))
    parameters = level("parameters", "web_service_parameter", as_parent(operations))
    functions = symbols.filter("kind = 'function' and error is null").select(col("name").alias("_function"), F.regexp_replace("module_id", ":common_module$", "").alias("service_id"), "symbol_id")
    for found, tag in ((methods, "handler"), (operations, "procedureName")):
        named = found.join(_child_text(elements, tag, "_function"), ["path", "node"]).join(functions, ["service_id", "_function"], "left")
        edges.append(_edge(named.filter("symbol_id is not null"), col("id"), col("symbol_id"), ["references", "triggers"], resolved=True))
        problems.append(named.filter("symbol_id is null").select(col("id").alias("source_node"), F.lit("service_callable").alias("kind"), col("_function").alias("reference"), F.lit("missing_target").alias("code")))
    for found, tag in ((operations, "xdtoReturningValueType"), (parameters, "xdtoValueType")):
        holder = elements.filter(col("tag") == tag).select("path", col("node").alias("_holder"), col("parent").alias("node"))
        used = found.join(holder, ["path", "node"]).drop("name").join(_child_text(elements, "name", "_type").withColumnRenamed("node", "_holder"), ["path", "_holder"]).join(_child_text(elements, "nsUri", "ns").withColumnRenamed("node", "_holder"), ["path", "_holder"])
        known = types.groupBy("ns", col("name").alias("_type")).agg(F.min("id").alias("type_id"), F.countDistinct("id").alias("n"))
        used = used.join(known, ["ns", "_type"], "left")
        edges.append(_edge(used.filter("n = 1"), col("id"), col("type_id"), ["references"], resolved=True))
        code = F.when(col("n").isNull(), "missing_target").otherwise("ambiguous_target")
        # Types of the platform's own namespace are no types of the project.
        problems.append(used.filter(f"(n is null and ns != '{PLATFORM_TYPES}') or n > 1").select(col("id").alias("source_node"), F.lit("service_type").alias("kind"), F.concat(F.lit("{"), "ns", F.lit("}"), "_type").alias("reference"), code.alias("code")))
    used = elements.filter("tag = 'xdtoPackages' and depth = 1").select("path", "node", col("attributes")["type"].alias("type")).join(_child_text(elements, "value", "value"), ["path", "node"])
    used = used.filter("type like '%ReferenceValue'").select("path", F.regexp_extract("value", r"^XDTOPackage\.(.+)$", 1).alias("name")).join(tops("web_service").select("path", "service_id"), "path")
    by_name = objects.filter("metadata_kind = 'xdto_package'").select("name", col("id").alias("package_id"))
    used = used.join(by_name, "name", "left")
    edges.append(_edge(used.filter("package_id is not null"), col("service_id"), col("package_id"), ["references"], resolved=True))
    problems.append(used.filter("package_id is null").select(col("service_id").alias("source_node"), F.lit("service_package").alias("kind"), col("name").alias("reference"), F.lit("missing_target").alias("code")))
