"""Contract, constraint and reference reports: findings are counted, rows are never dropped."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tidewater import contracts as C
from tidewater.session import by_shuffle


def contract_report(bronze: DataFrame, event_type: str, version: str = C.V1) -> DataFrame:
    """Per field of the payload: how often it is absent, and how often it is present but of the wrong type.

    The payload is read twice from the same text: as JSON text per field and as the declared type.
    """
    payload = C.payload_type(event_type, version)
    as_text = ", ".join(f"{name} string" for name in payload.names)
    seen = bronze.where(F.col("schema_version") == version).select(
        F.from_json("data_json", payload).alias("typed"), F.from_json("data_json", as_text).alias("text")
    )
    measures = [F.count(F.lit(1)).alias("rows")]
    for name in payload.names:
        absent = F.col(f"text.{name}").isNull()
        unreadable = ~absent & F.col(f"typed.{name}").isNull()
        measures += [F.count_if(absent).alias(f"absent_{name}"), F.count_if(unreadable).alias(f"wrong_{name}")]
    fields = F.array(*[
        F.struct(
            F.lit(name).alias("field"),
            F.col(f"absent_{name}").alias("absent"),
            F.col(f"wrong_{name}").alias("wrong_type"),
        )
        for name in payload.names
    ])
    return seen.agg(*measures).select(
        F.lit(event_type).alias("event_type"), F.lit(version).alias("schema_version"), "rows", F.inline(fields)
    )


# Values whose inner form the contract leaves open: the failed event of a dead letter.
_OPEN = {(C.DEAD_LETTER, "original_event")}
_LISTS = "[]"


def declared_fields() -> dict[tuple[str, str], dict[str, dict[str, str]]]:
    """Per contract and scope (the payload, or the elements of a list of objects) its fields and their kinds."""
    def kind(data_type) -> str:
        name = data_type.simpleString()
        return "object" if name.startswith("struct") else name

    out: dict[tuple[str, str], dict[str, dict[str, str]]] = {}
    for (event_type, version), ddl in C.PAYLOADS.items():
        scopes: dict[str, dict[str, str]] = {}

        def walk(struct: StructType, scope: str, prefix: str) -> None:
            fields = scopes.setdefault(scope, {})
            for field in struct.fields:
                path = f"{prefix}{field.name}"
                if (event_type, path) in _OPEN:
                    fields[path] = "any"
                elif isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StructType):
                    fields[path] = "array"
                    walk(field.dataType.elementType, path + _LISTS, path + _LISTS + ".")
                else:
                    fields[path] = kind(field.dataType)
                    if isinstance(field.dataType, StructType):
                        walk(field.dataType, scope, path + ".")

        walk(StructType.fromDDL(ddl), "", "")
        out[(event_type, version)] = scopes
    return out


# What a JSON text without backslash and control character consists of: names with their colon, strings, and numbers of
# at most 18 digits, or 15 before and 15 after the point. Anything else, malformed numbers included, stays as it is.
_TOKENS = r'("[^"]*+"\s*+:)|(")[^"]*+(")|(?<![\w.+-])-?+(?:(?:0|[1-9][0-9]{0,17}+)(?![\w.+-])|(?:0|[1-9][0-9]{0,14}+)(\.)[0-9]{1,15}+(?![\w.+-]))'
_NOT_BLANKED = r"[\x00-\x1f\\]"
_MARK = "\x01"
LONGEST_BLANKED = 1 << 20


def blanked(df: DataFrame, column: str) -> DataFrame:
    """Strings and numbers of the JSON text blanked and marked, `is_blanked` true; `readable` makes JSON of the same
    names and types of it. Texts with a backslash or control character, very long and null ones are left as they are."""
    able = F.coalesce(~F.col(column).rlike(_NOT_BLANKED) & (F.octet_length(column) <= LONGEST_BLANKED), F.lit(False))
    return df.withColumn("is_blanked", able).withColumn(column, F.when(
        F.col("is_blanked"), F.regexp_replace(column, _TOKENS, f"$1$2$3$4{_MARK}")).otherwise(F.col(column)))


def readable(column: str, flag: str) -> Column:
    """JSON text of what `blanked` made: strings are empty, whole numbers 0 and others 0.5."""
    numbers = F.regexp_replace(column, f'("[^"]*+"(?:\\s*+:)?+){_MARK}', "$1")
    numbers = F.replace(F.replace(numbers, F.lit(f".{_MARK}"), F.lit("0.5")), F.lit(_MARK), F.lit("0"))
    return F.when(F.col(flag), numbers).otherwise(F.col(column))


def contract_findings(bronze: DataFrame) -> DataFrame:
    """Missing, drifted and extra fields of all contracts at any depth, from one pass over the payloads:
    (event_type, schema_version, field, status, containers, missing, drifted, extra).

    Payloads that differ in no name and no type are counted as one first: strings, and numbers of the same kind, are
    blanked in the text, so that the few distinct texts left are read instead of every payload. Such a text is read as
    a variant, and only its shape (the names and types it holds) is kept, as is that of every element of a list of
    objects. The few distinct shapes are then held against the contract. `containers` counts the objects that should
    hold the field; an absent or null field is missing, one of another type is drifted, and a field that no contract
    declares is extra, counted where it occurs. A pair of type and version that nobody registered has one row with
    status `unknown_contract`. A payload that is no JSON object lacks all fields.
    """
    contracts = declared_fields()
    lists = sorted({scope.removesuffix(_LISTS) for scopes in contracts.values() for scope in scopes if scope})
    elements = [
        f"coalesce(transform(try_variant_get(v, '$.{name}', 'array<variant>'),"
        f" x -> struct('{name}{_LISTS}' as scope, schema_of_variant(x) as shape)), array())" for name in lists
    ]
    texts = blanked(bronze.select("event_type", "schema_version", "data_json"), "data_json") \
        .groupBy("event_type", "schema_version", "data_json", "is_blanked").agg(F.count(F.lit(1)).alias("n"))
    shapes = texts.select("event_type", "schema_version", "n", F.try_parse_json(readable("data_json", "is_blanked")).alias("v")).selectExpr(
        "event_type", "schema_version", "n",
        f"inline(concat(array(struct('' as scope, schema_of_variant(v) as shape)), {', '.join(elements)}))",
    ).groupBy("event_type", "schema_version", "scope", "shape").agg(F.sum("n").alias("n"))
    names = ["event_type", "schema_version", "field", "status", "containers", "missing", "drifted", "extra"]
    numbers = {"bigint": {"BIGINT"}, "double": {"BIGINT", "DOUBLE", "FLOAT", "DECIMAL"}, "string": {"STRING"},
               "boolean": {"BOOLEAN"}}

    def parsed(text: str) -> dict[str, str]:
        """Paths of a shape with their types; a nested object's fields follow it, a list's elements do not."""
        out: dict[str, str] = {}

        def value(at: int, path: str, keep: bool) -> int:
            head = re.compile(r"[A-Z_]+").match(text, at)
            kind, at = head[0], head.end()
            if kind == "ARRAY" and text.startswith("<", at):
                start = at + 1
                at = value(start, path, False)
                kind = f"ARRAY<{text[start:at]}>"
                at += 1
            elif kind == "OBJECT" and text.startswith("<", at):
                at += 1
                while text[at] != ">":
                    if text.startswith(", ", at):
                        at += 2
                    name = re.compile(r"`((?:[^`]|``)*)`: |([^:`]+): ").match(text, at)
                    field = (name[1].replace("``", "`") if name[1] is not None else name[2])
                    at = value(name.end(), f"{path}.{field}" if path else field, keep)
                at += 1
            elif kind == "DECIMAL":
                at = text.index(")", at) + 1
            if keep and path:
                out[path] = kind
            return at

        value(0, "", True)
        return out

    def fits(kind: str, seen: str) -> bool:
        if kind in ("any", seen.lower()):
            return True
        if kind.startswith("array"):
            inner = kind[6:-1]
            return seen.startswith("ARRAY") and (not inner or seen == "ARRAY<VOID>" or fits(inner, seen[6:-1].split("(")[0]))
        return seen in numbers.get(kind, ())

    def held_against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for event_type, version, scope, shape, n in batch.itertuples(index=False):
                declared = contracts.get((event_type, version))
                if declared is None:
                    if not scope:
                        out.append((event_type, version, "*", "unknown_contract", n, 0, 0, 0))
                    continue
                if scope not in declared:
                    continue
                seen = parsed(shape) if isinstance(shape, str) and shape.startswith("OBJECT") else {}
                prefix = f"{scope}." if scope else ""
                seen = {prefix + path: kind for path, kind in seen.items() if kind != "VOID"}
                for path, kind in declared[scope].items():
                    parent = path.removeprefix(prefix).rpartition(".")[0]
                    if parent and seen.get(prefix + parent) != "OBJECT":
                        continue
                    found = seen.get(path)
                    out.append((event_type, version, path, "declared", n, n * (found is None),
                                n * (found is not None and not fits(kind, found)), 0))
                opened = tuple(p + "." for p, k in declared[scope].items() if k != "object")
                out += [(event_type, version, path, "extra", n, 0, 0, n) for path in seen
                        if path not in declared[scope] and not path.startswith(opened)]
            yield pd.DataFrame(out, columns=names)

    rows = shapes.mapInPandas(held_against, "event_type string, schema_version string, field string, status string, "
                                            "containers bigint, missing bigint, drifted bigint, extra bigint")
    return rows.groupBy(*names[:4]).agg(*(F.sum(c).alias(c) for c in names[4:]))


def unknown_contracts(bronze: DataFrame) -> DataFrame:
    """Pairs of type and version nobody registered, with their counts."""
    known = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(v).alias("v")) for t, v in C.PAYLOADS])
    pair = F.struct(F.col("event_type").alias("t"), F.col("schema_version").alias("v"))
    return (
        bronze.where(~F.coalesce(F.array_contains(known, pair), F.lit(False)))
        .groupBy("event_type", "schema_version")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


# Predicates a row must satisfy, as SQL over the row's columns.
LINE_RULES = {
    "sku_length": "length(sku) between 1 and 64",
    "qty_positive": "qty > 0",
    "unit_price_not_negative": "unit_price >= 0",
}
ORDER_RULES = {"has_items": "line_count >= 1", "currency_length": "length(currency) = 3"}
TRANSITION_RULES = {"expected_version_positive": "expected_version > 0"}
STOCK_RULES = {
    "available_not_negative": "available_qty >= 0",
    "reserved_not_negative": "reserved_qty >= 0",
    "committed_not_negative": "committed_qty >= 0",
}
RESERVATION_RULES = {"qty_positive": "qty > 0"}
ORDER_TABLE_RULES = {"total_not_negative": "order_total >= 0"}


def violations(df: DataFrame, source: str, rules: dict[str, str]) -> DataFrame:
    """Rows breaking each rule, in one pass; a rule that cannot be decided counts as broken."""
    broken = {name: ~F.coalesce(F.expr(rule), F.lit(False)) for name, rule in rules.items()}
    counted = df.agg(
        F.count(F.lit(1)).alias("checked"), *[F.count_if(test).alias(name) for name, test in broken.items()]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counted.select(F.lit(source).alias("source"), "checked", F.inline(rows))


def missing_references(df: DataFrame, reference: str, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Count of rows whose non-null `key` does not exist in `target`.

    The rows are counted per key first: a reference shared by many rows crosses the join once.
    """
    used = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    known = target.select(F.col(target_key).alias("_key"))
    return used.join(known, "_key", "left_anti").agg(
        F.lit(reference).alias("reference"),
        F.count(F.lit(1)).alias("missing_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
    )


def causation_classes(events: DataFrame, root_types: tuple[str, ...] = (C.ORDER_CREATED,)) -> DataFrame:
    """Each event as root, ok, orphan (cause unknown in its correlation) or non_root_without_parent.

    Events without a cause never enter the join, where their nulls would share one partition.
    """
    columns = ["event_id", "event_type", "correlation_id", "causation_id"]
    is_root = F.col("event_type").isin(*root_types)
    parentless = events.where(F.col("causation_id").isNull()).select(
        *columns, F.when(is_root, "root").otherwise("non_root_without_parent").alias("causation")
    )
    parents = (
        events.select(F.col("event_id").alias("causation_id"), "correlation_id")
        .distinct()
        .withColumn("found", F.lit(True))
    )
    caused = (
        events.where(F.col("causation_id").isNotNull())
        .select(*columns)
        .join(by_shuffle(parents), ["causation_id", "correlation_id"], "left")
        .select(*columns, F.when(F.col("found"), "ok").otherwise("orphan").alias("causation"))
    )
    return parentless.unionByName(caused)


def not_yet_processed(events: DataFrame, ledger: DataFrame, consumer: str) -> DataFrame:
    """Events the consumer has not recorded as finished."""
    done = ledger.where(F.col("consumer_name") == consumer).select("event_id")
    return events.join(done, "event_id", "left_anti")


def guard_stale(events: DataFrame, orders: DataFrame, expected: str = "CREATED") -> DataFrame:
    """Adds `effect`: apply, unknown_order or stale (order no longer in the expected state)."""
    states = orders.select("order_id", F.col("status").alias("_status"))
    effect: Column = (
        F.when(F.col("_status").isNull(), "unknown_order")
        .when(F.col("_status") != expected, "stale")
        .otherwise("apply")
    )
    return events.join(states, "order_id", "left").withColumn("effect", effect).drop("_status")
