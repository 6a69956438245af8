"""The closed vocabulary of the graph: kinds, their order, the endpoint schema, and the table schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in declaration order, which is their sort order.
NODE_KINDS = "metadata module procedure function query data_composition_schema data_set data_composition_field xdto_type http_service_url_template http_service_method web_service_operation web_service_parameter form command attribute standard_attribute tabular_section dimension resource measure role access_right subsystem unknown".split()
METADATA_KINDS = "configuration subsystem catalog document enumeration common_module report data_processor information_register accumulation_register accounting_register calculation_register business_process task role common_form form command template http_service web_service xdto_package event_subscription unknown".split()
EDGE_KINDS = "contains calls references reads writes grants includes extends depends_on opens triggers".split()
DEPENDENCY_KINDS = ("calls", "references", "reads", "writes", "depends_on", "opens")
#: Which edges a context prefers; not the declaration order.
CONTEXT_PRIORITY = {k: i for i, k in enumerate("contains calls references reads writes depends_on opens triggers includes extends grants".split())}
NO_SELF_LOOP = ("contains", "calls", "includes", "extends")
ORIGINS = "declared parsed resolved derived external".split()
CONFIDENCES = "exact high medium low unknown".split()
RESOLUTIONS = "not_applicable unresolved partial ambiguous resolved".split()

# Groups of kinds that the endpoint schema names ("m." stands for metadata).
_REFERENCE_TARGETS = "m.catalog m.document m.enumeration m.information_register m.accumulation_register m.accounting_register m.calculation_register m.business_process m.task".split()
_PROTECTED = "m.configuration m.catalog m.document m.information_register m.accumulation_register".split()
_EVENT_SOURCES = "m.catalog m.document m.information_register m.accumulation_register m.accounting_register m.calculation_register m.business_process m.task".split()
_QUERY_SOURCES = "m.catalog m.information_register m.accumulation_register m.accounting_register".split()
_INCLUDED = [f"m.{k}" for k in METADATA_KINDS if k not in ("configuration", "subsystem", "form", "event_subscription", "unknown")]
_ANY_METADATA = [f"m.{k}" for k in METADATA_KINDS]
_FIELDS = ["attribute", "dimension", "resource"]
_COMMANDS = ["command", "m.command"]

#: (sources, edge kind, targets)
_ALLOWED = [
    (_ANY_METADATA, "contains", [*[k for k in _ANY_METADATA if k != "m.configuration"], "standard_attribute", "tabular_section", "dimension", "resource", "measure", "form", "command"]),
    ([*_ANY_METADATA, "form", "command"], "contains", ["module"]),
    ([*_ANY_METADATA, "tabular_section"], "contains", ["attribute"]),
    (["module"], "contains", ["procedure", "function"]),
    (["procedure", "function", "data_set"], "contains", ["query"]),
    (["m.report"], "contains", ["data_composition_schema"]),
    (["data_composition_schema"], "contains", ["data_set"]),
    (["data_set"], "contains", ["data_composition_field"]),
    (["m.xdto_package"], "contains", ["xdto_type"]),
    (["m.http_service"], "contains", ["http_service_url_template"]),
    (["http_service_url_template"], "contains", ["http_service_method"]),
    (["m.web_service"], "contains", ["web_service_operation"]),
    (["web_service_operation"], "contains", ["web_service_parameter"]),
    (["procedure", "function"], "calls", ["procedure", "function"]),
    ([*_FIELDS, *_COMMANDS], "references", _REFERENCE_TARGETS),
    (["access_right"], "references", _PROTECTED),
    (["m.event_subscription"], "references", [*_EVENT_SOURCES, "procedure"]),
    (["m.web_service"], "references", ["m.xdto_package"]),
    (["web_service_operation", "web_service_parameter"], "references", ["xdto_type"]),
    (["http_service_method", "web_service_operation"], "references", ["function"]),
    (_FIELDS, "depends_on", _ANY_METADATA),
    (_COMMANDS, "depends_on", _REFERENCE_TARGETS),
    (["query"], "depends_on", _QUERY_SOURCES),
    (["query"], "reads", _QUERY_SOURCES),
    (["procedure"], "writes", ["m.accumulation_register"]),
    (["procedure"], "opens", ["form", "m.common_form"]),
    (["m.event_subscription"], "triggers", ["procedure"]),
    (["http_service_method", "web_service_operation"], "triggers", ["function"]),
    (["role"], "grants", ["access_right"]),
    (["subsystem"], "includes", ["subsystem", *_INCLUDED]),
]
#: Kinds that must have exactly one owner.
OWNED = "module procedure function query data_composition_schema data_set data_composition_field xdto_type http_service_url_template http_service_method web_service_operation web_service_parameter form command attribute standard_attribute tabular_section dimension resource measure".split()


def _full(code: str) -> str:
    return f"metadata.{code[2:]}" if code.startswith("m.") else code


def allowed_endpoints() -> list[tuple[str, str, str]]:
    """Every (source code, edge kind, target code) that the schema allows, extension between like kinds included."""
    out = {(_full(s), e, _full(t)) for sources, e, targets in _ALLOWED for s in sources for t in targets}
    return sorted(out | {(_full(k), "extends", _full(k)) for k in _ANY_METADATA})


def code(kind: Column | str = "kind", metadata_kind: Column | str = "metadata_kind") -> Column:
    """`metadata.<kind>` or the kind itself."""
    kind, metadata_kind = (F.col(x) if isinstance(x, str) else x for x in (kind, metadata_kind))
    return F.when(kind == "metadata", F.concat(F.lit("metadata."), metadata_kind)).otherwise(kind)


def ordinal(column: Column | str, order: list[str]) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    place = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(place > 0, (place - 1).cast("int"))


#: Column types, as DDL.
PROVENANCE = "array<struct<source:string,path:string,start_line:int,start_col:int,end_line:int,end_col:int,producer:string,origin:string,confidence:string,resolution:string>>"
PAYLOAD = (
    "struct<tag:string,metadata:struct<synonym:string,register_records:array<struct<target_kind:string,target_name:string>>,event:string,root_url:string,namespace:string,"
    "xdto_packages:array<struct<kind:string,value:string>>>,member:struct<synonym:string>,access_right:struct<condition:string>,schema:struct<main:boolean>,"
    "data_set:struct<kind:string,data_source:string>,field:struct<data_path:string>,xdto_type:struct<kind:string>,url_template:struct<template:string>,"
    "http_method:struct<http_method:string>,operation:struct<ns:string,name:string,nillable:boolean>,parameter:struct<ns:string,name:string,nillable:boolean,direction:string>>"
)
#: Payload tags by the node kind they belong to; every kind may also have none.
PAYLOAD_KINDS = {
    "metadata": ("metadata",), "member": ("attribute", "tabular_section"), "access_right": ("access_right",), "schema": ("data_composition_schema",),
    "data_set": ("data_set",), "field": ("data_composition_field",), "xdto_type": ("xdto_type",), "url_template": ("http_service_url_template",),
    "http_method": ("http_service_method",), "operation": ("web_service_operation",), "parameter": ("web_service_parameter",),
}
NODES = f"id string, name string, kind string, metadata_kind string, payload {PAYLOAD}, provenance {PROVENANCE}, ingest_seq bigint"
EDGES = f"source string, target string, kind string, provenance {PROVENANCE}, ingest_seq bigint"


def payload_fits() -> Column:
    """Whether a node's payload is of a variant that its kind can have."""
    out = F.col("payload").isNull() | F.col("payload.tag").isNull() | (F.col("payload.tag") == "none")
    for tag, kinds in PAYLOAD_KINDS.items():
        out = out | ((F.col("payload.tag") == tag) & F.col("kind").isin(*kinds))
    return out


def endpoint_table(spark: SparkSession) -> DataFrame:
    """The endpoint schema as a table; its size is that of the fixed vocabulary."""
    return spark.createDataFrame(allowed_endpoints(), "source_code string, kind string, target_code string")
