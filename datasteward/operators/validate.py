"""Row validation against a declared schema, rules and custom validators.

Issues are rows (row id, layer, severity, field_name, issue_type, original_value,
suggested_value). A layer only looks at rows that have no error from the layers before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasteward.functions import text as tx
from datasteward.sources.shared import materialize

# Words accepted as true and false.
TRUE_WORDS = ["true", "1", "yes", "si", "s", "y"]
FALSE_WORDS = ["false", "0", "no", "n"]

ISSUE = "struct<layer:string,severity:string,field_name:string,issue_type:string,original_value:string,suggested_value:string>"


@dataclass
class FieldSchema:
    name: str
    type: str = "string"
    required: bool = False
    min: float | None = None
    max: float | None = None
    pattern: str | None = None
    enum: list[str] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)


@dataclass
class Rule:
    """A predicate that every row must satisfy; rows where it is null pass."""
    name: str
    predicate: str
    severity: str = "warning"
    field_name: str = ""


@dataclass
class DomainPack:
    name: str
    fields: list[FieldSchema] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    validators: dict[str, Callable[[DataFrame, "DomainPack"], DataFrame]] = field(default_factory=dict)
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)


def resolve(columns: list[str], fs: FieldSchema) -> str | None:
    """Column that holds a field: exact name, then aliases, then names in any case."""
    if fs.name in columns:
        return fs.name
    low = {c.lower(): c for c in reversed(columns)}
    for alias in fs.aliases:
        if alias in columns:
            return alias
        if alias.lower() in low:
            return low[alias.lower()]
    return low.get(fs.name.lower())


def coerce(value: Column, actual: T.DataType, wanted: str) -> Column:
    """The value in its declared type; null where it cannot be read as that type."""
    text = isinstance(actual, T.StringType)
    if wanted == "string":
        return value if text else F.lit(None).cast("string")
    if wanted == "integer":
        if text:
            s = tx.strip(value)
            return F.when(s.rlike(tx.INTEGER), s.try_cast("bigint"))
        if isinstance(actual, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.when(value == F.floor(value), value.try_cast("bigint"))
        return value.cast("bigint") if isinstance(actual, T.IntegralType) else F.lit(None).cast("bigint")
    if wanted == "float":
        if text:
            return tx.parse_number(value)
        return value.cast("double") if isinstance(actual, T.NumericType) else F.lit(None).cast("double")
    if wanted == "boolean":
        if text:
            low = F.lower(value)
            return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False)
        if isinstance(actual, T.BooleanType):
            return value
        return (value != 0) if isinstance(actual, T.IntegralType) else F.lit(None).cast("boolean")
    if wanted == "array":
        return value if isinstance(actual, T.ArrayType) else F.lit(None).cast("string")
    if wanted == "object":
        return value if isinstance(actual, (T.StructType, T.MapType)) else F.lit(None).cast("string")
    return value


def _issue(cond: Column, layer: str, severity: str, name: str, kind: str, original=None, suggested=None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(cond, F.struct(
        F.lit(layer).alias("layer"), F.lit(severity).alias("severity"), F.lit(name).alias("field_name"),
        F.lit(kind).alias("issue_type"), (none if original is None else original.cast("string")).alias("original_value"),
        (none if suggested is None else F.lit(str(suggested))).alias("suggested_value")))


def _as_string(v: Column, dt: T.DataType) -> Column:
    return F.to_json(v) if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)) else v.cast("string")


def _nested_required(schema: T.StructType, fs: FieldSchema) -> list[Column]:
    """Whether a required field with a dotted name is missing: a null or an absent field anywhere on its path, for an array
    in any of its elements. An empty array misses nothing. Names are found like those of columns."""
    if not fs.required:
        return []

    def missing(value: Column, dt: T.DataType, names: list[str]) -> Column:
        if isinstance(dt, T.ArrayType):
            return value.isNull() | F.exists(value, lambda x: missing(x, dt.elementType, names))
        if not names:
            return value.isNull()
        found = resolve(dt.names, FieldSchema(names[0])) if isinstance(dt, T.StructType) else None
        if found is None:
            return F.lit(True)
        return value.isNull() | F.coalesce(missing(value[found], dt[found].dataType, names[1:]), F.lit(True))

    head, *rest = fs.name.split(".")
    column = resolve(schema.names, FieldSchema(head))
    cond = F.lit(True) if column is None else missing(F.col(f"`{column}`"), schema[column].dataType, rest)
    return [_issue(cond, "structural", "error", fs.name, "missing_field")]


def field_checks(schema: T.StructType, fs: FieldSchema) -> list[Column]:
    """Checks of one field: missing, type, range, list, pattern."""
    column = resolve(schema.names, fs)
    if column is None and "." in fs.name:
        return _nested_required(schema, fs)
    if column is None:
        return [_issue(F.lit(True), "structural", "error", fs.name, "missing_field")] if fs.required else []
    dt = schema[column].dataType
    v, c = F.col(f"`{column}`"), coerce(F.col(f"`{column}`"), dt, fs.type)
    shown = _as_string(v, dt)
    out = []
    if fs.required:
        out.append(_issue(v.isNull(), "structural", "error", fs.name, "missing_field"))
    out.append(_issue(v.isNotNull() & c.isNull(), "structural", "error", fs.name, "type_mismatch", shown))
    usable = v.isNotNull() & c.isNotNull()
    if fs.min is not None or fs.max is not None:
        n = tx.parse_number(c) if fs.type == "string" else c.cast("double")
        if fs.min is not None:
            out.append(_issue(usable & (n < fs.min), "structural", "warning", fs.name, "out_of_range", shown, fs.min))
        if fs.max is not None:
            out.append(_issue(usable & (n > fs.max), "structural", "warning", fs.name, "out_of_range", shown, fs.max))
    if fs.enum:
        out.append(_issue(usable & ~c.cast("string").isin(fs.enum), "structural", "error", fs.name, "enum_invalid", shown))
    if fs.pattern:
        out.append(_issue(usable & ~c.cast("string").rlike(f"^(?:{fs.pattern})"), "structural", "warning", fs.name,
                          "pattern_mismatch", shown))
    return out


def rule_checks(rules: list[Rule]) -> list[Column]:
    return [_issue(F.coalesce(~F.expr(r.predicate), F.lit(False)), "semantic", r.severity, r.field_name, r.name) for r in rules]


def _array(checks: list[Column]) -> Column:
    if not checks:
        return F.array().cast(f"array<{ISSUE}>")
    return F.array_compact(F.array(*checks))


def _has_error(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"] == "error")


def _rows(df: DataFrame, ids: list[str], col: str) -> DataFrame:
    return df.select(*ids, F.explode(col).alias("_i")).select(*ids, "_i.*")


def validate_structural(df: DataFrame, fields: list[FieldSchema], ids: list[str]) -> DataFrame:
    checks = [c for fs in fields for c in field_checks(df.schema, fs)]
    return _rows(df.select(*ids, _array(checks).alias("_issues")), ids, "_issues")


def coerce_columns(df: DataFrame, fields: list[FieldSchema]) -> DataFrame:
    """Columns in their declared types; values that cannot be read stay null."""
    out = df
    for fs in fields:
        column = resolve(df.columns, fs)
        if column:
            out = out.withColumn(fs.name, coerce(F.col(f"`{column}`"), df.schema[column].dataType, fs.type))
    return out


def coercion_actions(df: DataFrame, fields: list[FieldSchema], ids: list[str]) -> DataFrame:
    """One row per text value that was read as another type."""
    parts = []
    for fs in fields:
        column = resolve(df.columns, fs)
        if column and fs.type != "string" and isinstance(df.schema[column].dataType, T.StringType):
            c = coerce(F.col(f"`{column}`"), T.StringType(), fs.type)
            parts.append(F.when(c.isNotNull(), F.struct(F.lit(fs.name).alias("field"), F.col(f"`{column}`").alias("original"),
                                                        c.cast("string").alias("fixed"), F.lit("type_coercion").alias("method"))))
    if not parts:
        raise ValueError("no text column has a declared type other than string")
    return df.select(*ids, F.explode(F.array_compact(F.array(*parts))).alias("a")).select(*ids, "a.*")


def run_validators(df: DataFrame, pack: DomainPack, ids: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Issues of the custom validators and the error text of those that failed.

    Each validator's result is written before the next one starts, so one that raises while
    it runs neither stops nor empties the others.
    """
    found, failed = None, {}
    for name, fn in pack.validators.items():
        try:
            part = materialize(fn(df, pack).select(*ids, "layer", "severity", "field_name", "issue_type",
                                                   F.col("original_value").cast("string").alias("original_value"),
                                                   F.col("suggested_value").cast("string").alias("suggested_value")))
        except Exception as e:  # any user error is reported, the rest goes on
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            continue
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _rows(df.select(*ids, _array([]).alias("_i")).limit(0), ids, "_i")
    return found, failed


def validate(df: DataFrame, pack: DomainPack, ids: list[str]) -> DataFrame:
    """All issues of all layers.

    Without custom validators everything is one projection over one scan. With them, the
    rows in error are taken out by an anti join before each later layer.
    """
    structural = _array([c for fs in pack.fields for c in field_checks(df.schema, fs)])
    typed = [(fs, resolve(df.columns, fs)) for fs in pack.fields]
    clean = df.withColumn("_s", structural)
    # rules see the declared types
    casted = {fs.name: coerce(F.col(f"`{c}`"), df.schema[c].dataType, fs.type) for fs, c in typed if c and fs.type in ("integer", "float", "boolean")}
    if not pack.validators:
        sem = clean.withColumns(casted).withColumn("_r", F.when(_has_error(F.col("_s")), _array([])).otherwise(_array(rule_checks(pack.rules))))
        return _rows(sem.withColumn("_a", F.concat("_s", "_r")), ids, "_a")
    first = _rows(clean, ids, "_s")
    ok = clean.filter(~_has_error(F.col("_s"))).drop("_s").withColumns(casted)
    custom, failed = run_validators(ok, pack, ids)
    bad = custom.filter("severity = 'error'").select(*ids).distinct()
    rest = ok.join(bad, ids, "left_anti")
    rules = _rows(rest.withColumn("_r", _array(rule_checks(pack.rules))), ids, "_r")
    return reduce(DataFrame.unionByName, [first, custom, rules, *_failures(custom, failed)])


def _failures(issues: DataFrame, failed: dict[str, str]) -> list[DataFrame]:
    """A row per validator that raised, without a row id: its name as the field, the error as the value."""
    if not failed:
        return []
    given = {"layer": "custom", "severity": "warning", "issue_type": "validator_failed"}
    rows = [tuple(given.get(c, {"field_name": name, "original_value": text}.get(c)) for c in issues.columns)
            for name, text in sorted(failed.items())]
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in issues.schema.fields])
    return [issues.sparkSession.createDataFrame(rows, nullable)]


def row_status(df: DataFrame, issues: DataFrame, ids: list[str]) -> DataFrame:
    """is_valid per row, with the number of errors and warnings."""
    n = issues.groupBy(*ids).agg(F.sum((F.col("severity") == "error").cast("long")).alias("errors"),
                                 F.sum((F.col("severity") == "warning").cast("long")).alias("warnings"))
    out = df.select(*ids).join(n, ids, "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("is_valid", F.col("errors") == 0)


def group_rule(df: DataFrame, keys: list[str], having: str, name: str, severity: str = "warning") -> DataFrame:
    """Rows of the groups that break a rule on an aggregate; ``having`` may use n (rows of the group)."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(having)
    return df.join(bad, keys).withColumns({"rule": F.lit(name), "severity": F.lit(severity)})


def duplicate_entities(df: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Rows whose key occurs more than once, with the number of copies.

    Long keys are compared by a 256-bit digest; a third of all rows in one group is one
    row of the joined counts.
    """
    k = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in keys]), 256)
    d = df.select(*ids, k.alias("_k"))
    dup = d.groupBy("_k").agg(F.count(F.lit(1)).alias("copies"), F.min(ids[0]).alias(f"first_{ids[0]}")).filter("copies > 1")
    return d.join(dup, "_k").drop("_k")


def scorecard(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Score per group of issues: 100 - 15 per error - 5 per warning, never below 0."""
    s = issues.groupBy(*keys).agg(F.sum((F.col("severity") == "error").cast("long")).alias("errors"),
                                  F.sum((F.col("severity") == "warning").cast("long")).alias("warnings"))
    score = F.greatest(F.lit(0), 100 - 15 * F.col("errors") - 5 * F.col("warnings"))
    return s.withColumn("score", score).withColumn(
        "status", F.when(F.col("score") >= 80, "pass").when(F.col("score") >= 50, "review").otherwise("fail"))


# --- checks of nested routing records -----------------------------------------------------

def _nested(df: DataFrame, ids: list[str], checks: Column) -> DataFrame:
    return df.select(*ids, F.explode(F.array_compact(checks)).alias("_i")).select(*ids, "_i.*")


def check_bounds(df: DataFrame, ids: list[str], box: dict[str, float], locations: str = "locations") -> DataFrame:
    """Locations whose coords, [lat, lng], lie outside the box."""
    t = df.select(*ids, F.explode(locations).alias("l")).filter(F.size("l.coords") >= 2)
    lat, lng = F.col("l.coords")[0], F.col("l.coords")[1]

    def bad(c: Column, lo: float, hi: float, axis: str) -> Column:
        return F.when((c < lo) | (c > hi), F.struct(
            F.lit("custom").alias("layer"), F.lit("warning").alias("severity"),
            F.concat(F.lit("locations."), "l.id", F.lit(".coords")).alias("field_name"), F.lit("out_of_bounds").alias("issue_type"),
            F.lit(axis).alias("original_value"), F.lit(None).cast("string").alias("suggested_value")))

    return _nested(t, ids, F.array(bad(lat, box["lat_min"], box["lat_max"], "lat"), bad(lng, box["lng_min"], box["lng_max"], "lng")))


def check_time_windows(df: DataFrame, ids: list[str], typical: tuple[int, int], locations: str = "locations",
                       vehicles: str | None = "vehicles") -> DataFrame:
    """Windows that end before they start (error) or leave the usual hours (warning)."""
    def row(cond: Column, severity: str, name: Column, kind: str) -> Column:
        return F.when(cond, F.struct(F.lit("custom").alias("layer"), F.lit(severity).alias("severity"), name.alias("field_name"),
                                     F.lit(kind).alias("issue_type"), F.lit(None).cast("string").alias("original_value"),
                                     F.lit(None).cast("string").alias("suggested_value")))

    t = df.select(*ids, F.explode(locations).alias("l"))
    s, e = F.col("l.time_window_start"), F.col("l.time_window_end")
    name = F.concat(F.lit("locations."), "l.id", F.lit(".time_window"))
    out = _nested(t, ids, F.array(row(e < s, "error", name, "time_window_invalid"),
                                  row(s.isNotNull() & e.isNotNull() & ((s < typical[0]) | (e > typical[1])), "warning", name, "atypical_hours")))
    if "time_windows" in df.schema[locations].dataType.elementType.names:
        w = t.select(*ids, F.col("l.id").alias("lid"), F.posexplode("l.time_windows").alias("i", "w"))
        label = F.concat(F.lit("locations."), "lid", F.lit(".time_windows["), F.col("i").cast("string"), F.lit("]"))
        out = out.unionByName(_nested(w, ids, F.array(row(F.col("w.end") < F.col("w.start"), "error", label, "time_window_invalid"))))
    if vehicles and vehicles in df.columns:
        v = df.select(*ids, F.explode(vehicles).alias("v"))
        label = F.concat(F.lit("vehicles."), "v.id", F.lit(".schedule"))
        out = out.unionByName(_nested(v, ids, F.array(row(F.col("v.end_time") <= F.col("v.start_time"), "error", label, "vehicle_schedule_invalid"))))
    return out


def check_balance(df: DataFrame, ids: list[str], pairs: str = "pickups_deliveries", locations: str = "locations") -> DataFrame:
    """Pairs whose weight or volume demands do not sum to zero."""
    loc = df.select(*ids, F.explode(locations).alias("l")).select(*ids, F.col("l.id").alias("lid"), F.coalesce("l.weight_demand", F.lit(0.0)).alias("w"),
                                                                  F.coalesce("l.volume_demand", F.lit(0.0)).alias("u"))
    p = df.select(*ids, F.posexplode(pairs).alias("i", "p")).select(*ids, "i", "p.pickup", "p.delivery")
    a = loc.withColumnsRenamed({"lid": "pickup", "w": "wa", "u": "ua"})
    b = loc.withColumnsRenamed({"lid": "delivery", "w": "wb", "u": "ub"})
    t = p.join(a, [*ids, "pickup"]).join(b, [*ids, "delivery"])

    def row(x: str, y: str, kind: str) -> Column:
        return F.when(F.col(x) + F.col(y) != 0, F.struct(
            F.lit("custom").alias("layer"), F.lit("warning").alias("severity"),
            F.concat(F.lit("pickups_deliveries["), F.col("i").cast("string"), F.lit("]")).alias("field_name"),
            F.lit("demand_imbalance").alias("issue_type"), F.lit(kind).alias("original_value"), F.lit(None).cast("string").alias("suggested_value")))

    return _nested(t, ids, F.array(row("wa", "wb", "weight_demand"), row("ua", "ub", "volume_demand")))


def _part(df: DataFrame, column: str, name: str, kind: str):
    """The field of an element, null of the given type where records do not have it."""
    have = df.schema[column].dataType.elementType.names
    return (lambda x: x[name]) if name in have else (lambda x: F.lit(None).cast(kind))


def check_routing_rules(df: DataFrame, ids: list[str], locations: str = "locations", vehicles: str = "vehicles",
                        may_skip: str = "allow_skipping_nodes") -> DataFrame:
    """Rules between the locations and the vehicles of one record, worked out within the row.

    missing_skills: no vehicle has all skills a location requires. capacity_exceeded: unless locations may be skipped, what
    is picked up or what is delivered, whichever is more, exceeds the capacities together. starts_after_visits and
    ends_before_visits: a vehicle starts after the first window opens, or ends before the last one closes, of the locations
    whose skills it has. Null demands count as 0, a vehicle with a null capacity carries anything, null times and skills
    are not judged, and null lists are empty. Fields a record does not have are null.
    """
    need, skills = _part(df, locations, "required_skills", "array<string>"), _part(df, vehicles, "skills", "array<string>")
    none = F.array().cast("array<string>")

    def served(v: Column, x: Column) -> Column:
        return F.size(F.array_except(F.coalesce(need(x), none), F.coalesce(skills(v), none))) == 0

    def issue(severity: str, name: Column, kind: str, value: Column) -> Column:
        return F.struct(F.lit("custom").alias("layer"), F.lit(severity).alias("severity"), name.alias("field_name"), F.lit(kind).alias("issue_type"),
                        value.cast("string").alias("original_value"), F.lit(None).cast("string").alias("suggested_value"))

    def total(list_: Column, value) -> Column:
        return F.aggregate(list_, F.lit(0.0), lambda acc, x: acc + value(x))

    t = df.select(*ids, F.coalesce(F.col(locations), F.array()).alias("_l"), F.coalesce(F.col(vehicles), F.array()).alias("_v"),
                  (F.coalesce(F.col(may_skip), F.lit(False)) if may_skip in df.columns else F.lit(False)).alias("_skip"))
    l, v = F.col("_l"), F.col("_v")
    alone = F.filter(l, lambda x: (F.size(F.coalesce(need(x), none)) > 0) & ~F.exists(v, lambda y: served(y, x)))
    found = [F.transform(alone, lambda x: issue("error", F.concat(F.lit("locations."), x["id"], F.lit(".required_skills")), "missing_skills",
                                                F.array_join(F.array_sort(need(x)), ",")))]

    def over(what: str) -> Column:
        demand, room = _part(df, locations, f"{what}_demand", "double"), _part(df, vehicles, f"{what}_capacity", "double")
        picked = total(l, lambda x: F.greatest(F.coalesce(demand(x), F.lit(0.0)), F.lit(0.0)))
        brought = total(l, lambda x: F.greatest(-F.coalesce(demand(x), F.lit(0.0)), F.lit(0.0)))
        load = F.greatest(picked, brought)
        full = ~F.col("_skip") & ~F.exists(v, lambda y: room(y).isNull()) & (load > total(v, room))
        return F.array(F.when(full, issue("error", F.lit(f"{locations}.{what}_demand"), "capacity_exceeded", load)))

    found += [over("weight"), over("volume")]
    opens, closes = _part(df, locations, "time_window_start", "int"), _part(df, locations, "time_window_end", "int")
    starts, ends = _part(df, vehicles, "start_time", "int"), _part(df, vehicles, "end_time", "int")

    def label(y: Column, name: str) -> Column:
        return F.concat(F.lit("vehicles."), y["id"], F.lit(f".{name}"))

    def late(y: Column) -> Column:
        first = F.array_min(F.transform(F.filter(l, lambda x: served(y, x)), opens))
        return F.when(starts(y) > first, issue("warning", label(y, "start_time"), "starts_after_visits", starts(y)))

    def early(y: Column) -> Column:
        last = F.array_max(F.transform(F.filter(l, lambda x: served(y, x)), closes))
        return F.when(ends(y) < last, issue("warning", label(y, "end_time"), "ends_before_visits", ends(y)))

    found += [F.transform(v, late), F.transform(v, early)]
    return _nested(t, ids, F.concat(*found))
