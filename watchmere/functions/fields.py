"""The canonical event schema and access to its fields by dotted path.

An event DataFrame has ``@timestamp``, ``message`` and a struct column for each
other first segment, so ``source.ip`` is a field of the struct ``source``; field
``_seq`` orders events of equal time and may be of any orderable type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: path -> Spark type of every leaf of the canonical event.
LEAVES: dict[str, str] = {
    "@timestamp": "timestamp",
    "event.kind": "string", "event.category": "string", "event.action": "string", "event.outcome": "string", "event.provider": "string", "event.dataset": "string",
    "event.code": "int", "event.severity": "int", "event.business_hours": "boolean",
    "host.name": "string", "host.criticality": "string", "host.role": "string", "host.environment": "string", "host.owner": "string",
    "source.ip": "string", "source.port": "int", "source.internal": "boolean", "source.first_seen": "boolean",
    "source.geo.country_name": "string", "source.geo.country_iso_code": "string", "source.as.organization.name": "string",
    "destination.ip": "string", "destination.port": "int",
    "user.name": "string", "user.target": "string", "user.domain": "string", "user.invalid": "boolean", "user.password_attempted": "string",
    "user.privileged": "boolean", "user.type": "string", "user.department": "string", "user.enabled": "boolean", "user.new_source_ip": "boolean", "user.new_host": "boolean",
    "process.pid": "int", "process.name": "string", "process.command_line": "string", "process.parent.name": "string",
    "auth.method": "string",
    "http.request.method": "string", "http.request.referrer": "string", "http.response.status_code": "int", "http.response.body.bytes": "long",
    "url.original": "string", "url.path": "string", "user_agent.original": "string",
    "winlog.logon_type": "string", "winlog.status": "string", "service.name": "string", "group.name": "string",
    "network.protocol": "string", "rule.name": "string", "rule.category": "string", "rule.signature_id": "long",
    "file.hash.sha256": "string", "honeypot": "boolean",
    "threat.indicator.matched": "boolean", "threat.indicator.source": "string", "threat.indicator.category": "string", "threat.indicator.confidence": "int",
    "log.file.path": "string", "message": "string",
}

#: Fields that an alert keeps of its event, for triage and risk.
CONTEXT = ("source.geo.country_name", "source.as.organization.name", "source.internal", "threat.indicator.source", "threat.indicator.category", "host.criticality", "host.role", "user.privileged", "user.type")


def nested(values: dict[str, Column], leaves: dict[str, str] | None = None) -> list[Column]:
    """Top-level columns of an event from its leaves; leaves without a value are null."""
    leaves = LEAVES if leaves is None else leaves
    tree: dict = {}
    for path, kind in leaves.items():
        node = tree
        *inner, last = path.split(".")
        for part in inner:
            node = node.setdefault(part, {})
        value = values.get(path)
        node[last] = F.lit(None).cast(kind) if value is None else value.cast(kind)

    def build(node, name: str) -> Column:
        return node.alias(name) if isinstance(node, Column) else F.struct(*[build(v, k) for k, v in node.items()]).alias(name)

    return [build(v, k) for k, v in tree.items()]


def find(schema: T.StructType, path: str) -> tuple[list[str], T.DataType] | None:
    """Segments and type of a path: a column of that very name first, then struct fields; None if there is none."""
    names = {f.name: f.dataType for f in schema.fields}
    if path in names:
        return [path], names[path]
    parts = path.split(".")
    for i in range(len(parts) - 1, 0, -1):
        head = ".".join(parts[:i])
        if isinstance(names.get(head), T.StructType):
            rest = find(names[head], ".".join(parts[i:]))
            if rest:
                return [head, *rest[0]], rest[1]
    return None


def resolve(df: DataFrame, path: str) -> Column:
    """Column of a path; an unknown field is a null, never an error."""
    found = find(df.schema, path)
    if found is None:
        return F.lit(None).cast("string")
    return F.col(".".join(f"`{p}`" for p in found[0]))


def kind(df: DataFrame, path: str) -> T.DataType:
    found = find(df.schema, path)
    return T.StringType() if found is None else found[1]


def shown(df: DataFrame, path: str) -> Column:
    """A field as text: booleans as True and False, whole seconds and microseconds of times, None for null."""
    column, type_ = resolve(df, path), kind(df, path)
    if isinstance(type_, T.BooleanType):
        text = F.when(column, "True").when(~column, "False")
    elif isinstance(type_, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), F.when(F.date_format(column, "SSSSSS") != "000000", F.date_format(column, ".SSSSSS")).otherwise(""))
    elif isinstance(type_, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("None"))


def with_fields(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """df with leaves added or replaced; structs that are missing are made, and a null struct becomes one of nulls.

    A struct is put together once from its fields: one withField after another would
    double the expression with every nested leaf.
    """
    by_top: dict[str, dict[str, Column]] = {}
    for path, value in values.items():
        top, _, rest = path.partition(".")
        by_top.setdefault(top, {})[rest] = value
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({top: leaves[""] if "" in leaves else _rebuilt(F.col(f"`{top}`"), types.get(top), leaves) for top, leaves in by_top.items()})


def _rebuilt(column: Column, type_: T.DataType | None, leaves: dict[str, Column]) -> Column:
    if not isinstance(type_, T.StructType):
        return _struct(leaves)
    groups: dict[str, dict[str, Column]] = {}
    for path, value in leaves.items():
        head, _, tail = path.partition(".")
        groups.setdefault(head, {})[tail] = value
    old = {f.name: f.dataType for f in type_.fields}
    parts = []
    for name in [*old, *[g for g in groups if g not in old]]:
        sub = groups.get(name)
        part = column.getField(name) if sub is None else sub[""] if "" in sub else _rebuilt(column.getField(name), old.get(name), sub)
        parts.append(part.alias(name))
    return F.struct(*parts)


def _struct(leaves: dict[str, Column]) -> Column:
    groups: dict[str, dict[str, Column]] = {}
    for path, value in leaves.items():
        head, _, tail = path.partition(".")
        groups.setdefault(head, {})[tail] = value
    return F.struct(*[(sub[""] if "" in sub else _struct(sub)).alias(head) for head, sub in groups.items()])


def context(df: DataFrame) -> Column:
    """The context struct of an event; its fields are the paths of CONTEXT with underscores for dots."""
    return F.struct(*[resolve(df, p).cast(LEAVES[p]).alias(p.replace(".", "_")) for p in CONTEXT])
