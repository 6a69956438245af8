"""What the strings of descriptors name: a kind and a name, or a reason why they name nothing.

Each function takes a string column and gives a struct with `outcome` (`supported`, `unsupported`, `deferred`,
`malformed`), `reason`, `kind` and `name`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and the metadata kinds they stand for.
OBJECTS = {
    "Catalog": "catalog", "Document": "document", "Enum": "enumeration", "CommonModule": "common_module", "Report": "report", "DataProcessor": "data_processor",
    "InformationRegister": "information_register", "AccumulationRegister": "accumulation_register", "AccountingRegister": "accounting_register", "CalculationRegister": "calculation_register",
    "BusinessProcess": "business_process", "Task": "task", "Role": "role", "CommonCommand": "command", "CommonForm": "common_form", "CommonTemplate": "template",
    "HTTPService": "http_service", "WebService": "web_service", "XDTOPackage": "xdto_package",
}
PROTECTED = {"Configuration": "configuration", **{k: OBJECTS[k] for k in ("Catalog", "Document", "InformationRegister", "AccumulationRegister")}}
FORM_OWNERS = {k: OBJECTS[k] for k in ("Catalog", "Document", "Report", "DataProcessor", "InformationRegister", "AccumulationRegister", "AccountingRegister", "CalculationRegister", "BusinessProcess", "Task")}
REGISTER_RECORDS = {k: OBJECTS[k] for k in ("InformationRegister", "AccumulationRegister", "AccountingRegister", "CalculationRegister")}
EVENT_FAMILIES = {
    "CatalogObject": "catalog", "CatalogManager": "catalog", "DocumentObject": "document", "DocumentManager": "document", "InformationRegisterRecordSet": "information_register",
    "AccumulationRegisterRecordSet": "accumulation_register", "AccountingRegisterRecordSet": "accounting_register", "CalculationRegisterRecordSet": "calculation_register",
    "BusinessProcessObject": "business_process", "BusinessProcessManager": "business_process", "TaskObject": "task",
}
_REFERABLE = ("Catalog", "Document", "Enum", "BusinessProcess", "Task")
_KEYED = ("InformationRegister", "AccumulationRegister", "AccountingRegister", "CalculationRegister")
TYPE_PREFIXES = {**{f"{k}Ref": OBJECTS[k] for k in _REFERABLE}, **{f"{k}RecordKey": OBJECTS[k] for k in _KEYED}, **{f"{k}RecordSet": OBJECTS[k] for k in _KEYED}}


def _kind(prefix: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), prefix)


def _result(outcome: Column, reason: Column, kind: Column, name: Column) -> Column:
    ok = outcome == "supported"
    return F.struct(outcome.alias("outcome"), F.when(~ok, reason).alias("reason"), F.when(ok, kind).alias("kind"), F.when(ok, name).alias("name"))


def subsystem_token(value: Column) -> Column:
    """`Prefix.Name`; subsystems themselves are deferred to the hierarchy."""
    p = F.split(value, r"\.")
    prefix, name = p[0], F.get(p, 1)
    empty = (prefix == "") | name.isNull() | (name == "")
    subsystem = prefix == "Subsystem"
    broken = empty | (subsystem & F.exists(F.slice(p, 3, 100_000), lambda x: x == "")) | (~subsystem & (F.size(p) > 2))
    kind = _kind(prefix, OBJECTS)
    outcome = F.when(broken, "malformed").when(subsystem, "deferred").when(kind.isNull(), "unsupported").otherwise("supported")
    return _result(outcome, F.when(broken, "malformed_format").otherwise("unsupported_prefix"), kind, name)


def protected_resource(value: Column) -> Column:
    """`Prefix.Name` of what rights protect; everything else is passed over."""
    prefix, name = F.substring_index(value, ".", 1), F.regexp_extract(value, r"^[^.]*\.(.+)$", 1)
    kind = _kind(prefix, PROTECTED)
    return _result(F.when((name != "") & kind.isNotNull(), "supported").otherwise("unsupported"), F.lit("ignored"), kind, name)


def type_reference(value: Column) -> Column:
    """A type's name after its last colon: `CatalogRef.Products`."""
    last = F.substring_index(F.trim(value), ":", -1)
    prefix, name = F.substring_index(last, ".", 1), F.regexp_extract(last, r"^[^.]*\.(.+)$", 1)
    kind = _kind(prefix, TYPE_PREFIXES)
    return _result(F.when((name != "") & kind.isNotNull(), "supported").otherwise("unsupported"), F.lit("no_reference"), kind, name)


def event_handler(value: Column) -> Column:
    """`CommonModule.<module>.<procedure>`; the reasons in order. `kind` is the module, `name` the procedure."""
    p = F.split(value, r"\.")
    reason = (
        F.when(value == "", "empty_value").when(F.size(p) < 3, "missing_components").when(F.size(p) > 3, "additional_components")
        .when(F.exists(p, lambda x: x == ""), "empty_component").when(p[0] != "CommonModule", "unsupported_namespace")
    )
    return _result(F.when(reason.isNull(), "supported").otherwise("malformed"), reason, F.get(p, 1), F.get(p, 2))


def event_source(value: Column) -> Column:
    """`Family` or `Family.Name`; without a name, all objects of the family are meant."""
    p = F.split(value, r"\.")
    kind = _kind(p[0], EVENT_FAMILIES)
    reason = F.when(F.trim(value) == "", "empty_value").when(F.size(p) > 2, "additional_components").when(F.exists(p, lambda x: F.trim(x) == ""), "empty_component")
    outcome = F.when(reason.isNotNull(), "malformed").when(kind.isNull(), "unsupported").otherwise("supported")
    return _result(outcome, F.coalesce(reason, F.lit("unsupported_prefix")), kind, F.get(p, 1))


def form_target(value: Column) -> Column:
    """`CommonForm.X` or `<Owner>.<name>.Form.<form>`. `kind` is the owner's kind (common_form for the former), `name` the rest joined by a dot."""
    p = F.split(value, r"\.")
    owner = _kind(p[0], FORM_OWNERS)
    n = F.size(p)
    common, subordinate = (n == 2) & (p[0] == "CommonForm"), (n == 4) & (F.get(p, 2) == "Form")
    reason = (
        F.when(common, F.when(F.get(p, 1) == "", "invalid_name"))
        .when(subordinate, F.when(owner.isNull(), "unsupported_prefix").when((F.get(p, 1) == "") | (F.get(p, 3) == ""), "invalid_name"))
        .when((n == 3) & (F.get(p, 2) == "Form") & owner.isNotNull(), "default_form_alias")
        .when((n == 3) & F.get(p, 2).isin("ListForm", "ObjectForm") & owner.isNotNull(), "shorthand_form")
        .otherwise("invalid_target_shape")
    )
    name = F.when(common, F.get(p, 1)).otherwise(F.concat_ws(".", F.get(p, 1), F.get(p, 3)))
    return _result(F.when(reason.isNull(), "supported").otherwise("unsupported"), reason, F.when(common, "common_form").otherwise(owner), name)


def register_record(value: Column) -> Column:
    """`Namespace.Name` of a document's register records; only accumulation registers are supported."""
    p = F.split(value, r"\.")
    kind = _kind(p[0], REGISTER_RECORDS)
    broken = (F.size(p) != 2) | F.exists(p, lambda x: x == "")
    outcome = F.when(broken, "malformed").when(kind == "accumulation_register", "supported").otherwise("unsupported")
    return _result(outcome, F.when(broken, "malformed_format").when(kind.isNull(), "unsupported_prefix").otherwise("unsupported_kind"), kind, F.get(p, 1))
