"""Cleaning primitives, the gated cleaning pass with its action log, and the older methods."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain, count

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.chunks import POS, forward_fill, with_position
from ..functions.columns import (
    as_number, col, groupable, nan_to_null, numeric_columns, text_as_number, text_columns,
)
from ..functions.dates import looks_like_date, parse_date
from ..functions.joins import lookup
from ..functions.quantiles import exact_quantiles
from ..functions.stage import staged
from ..functions.values import modes
from . import quality

# Whitespace as Python's strip sees it.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
IMPUTE_METHODS = ("mean", "median", "mode", "forward_fill")


class CleaningError(RuntimeError):
    """A finding that must not be cleaned automatically reached the cleaner."""


# ---------------------------------------------------------------- primitives

def stripped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^" + _SPACE, ""), _SPACE + "$", "")


def strip_whitespace(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """CL-1: strip the text cells of the given (default: all text) columns."""
    names = set(text_columns(df) if columns is None else columns)
    return df.select([stripped(col(n)).alias(n) if n in names else col(n) for n in df.columns])


def changed(before: Column, after: Column) -> Column:
    """Aggregate: cells that differ, nulls equal to nulls."""
    return F.count_if(~before.eqNullSafe(after))


def strip_changes(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, values_changed) of `strip_whitespace`."""
    names = list(text_columns(df) if columns is None else columns)
    row = df.agg(*[changed(col(n), stripped(col(n))).alias(f"c{i}") for i, n in enumerate(names)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("values_changed")) for i, n in enumerate(names)])))


def coerce_column(df: DataFrame, name: str, lexical: bool = True) -> tuple[DataFrame, DataFrame]:
    """CL-3: bring a mixed column to its dominant cell type without ever making a null.

    A VARIANT column keeps its type; its cells are replaced. A text column (classes
    taken from the spelling, `lexical`) stays text, stripped, and gains
    `<name>_value` with the typed value, null where the text was preserved.
    Returns the table and a row (kind, dominant_type, values_changed, uncoerced).
    """
    dtype = df.schema[name].dataType
    raw = col(name)
    is_variant = isinstance(dtype, T.VariantType)
    if not is_variant and not isinstance(dtype, T.StringType):
        raise ValueError(f"column {name!r} has one type already")
    top = quality.type_facts(df.select(raw), lexical).filter(F.col("column") == name).first()
    dominant = top["dominant"] if top else None
    cls = quality.cell_class(raw, dtype)
    text = stripped(raw.cast("string"))
    kind = ("empty" if dominant is None else "numeric" if dominant in ("int", "float")
            else "datetime" if dominant == "datetime" else "whitespace_only")
    number = text_as_number(text)
    day = F.date_format(parse_date(text), "yyyy-MM-dd")
    typed = {"numeric": number, "datetime": day}.get(kind, text)
    if is_variant:
        is_text = cls == "str"
        kept = F.when(is_text, text.cast("variant")).otherwise(raw)
        if kind == "numeric":
            is_number = cls.isin("int", "float")
            after = F.when(is_text & number.isNotNull(), number.cast("variant")).otherwise(kept)
            lost = cls.isNotNull() & ~is_number & number.isNull()
            rewritten = is_text & (number.isNotNull() | (text != raw.cast("string")))
        elif kind == "datetime":
            after = F.when(day.isNotNull(), day.cast("variant")).otherwise(kept)
            lost = cls.isNotNull() & day.isNull()
            rewritten = cls.isNotNull() & (day.isNotNull() | (is_text & (text != raw.cast("string"))))
        else:
            after, lost = kept, F.lit(False)
            rewritten = is_text & (text != raw.cast("string"))
        out = df.withColumn(name, after)
    else:
        after = text
        lost = raw.isNotNull() & typed.isNull()
        rewritten = ~raw.eqNullSafe(text)
        out = df.withColumn(name, after)
        if kind in ("numeric", "datetime"):
            out = out.withColumn(f"{name}_value", typed if kind == "numeric" else F.to_date(typed))
    meta = df.agg(
        F.lit(name).alias("column"), F.lit(kind).alias("kind"),
        F.lit(dominant or "none").alias("dominant_type"),
        F.count_if(rewritten).alias("values_changed"), F.count_if(lost).alias("uncoerced"),
    )
    return out, meta


def case_mapping(df: DataFrame, name: str) -> DataFrame:
    """(variant, canonical, n) for every spelling that is not the most frequent of its case group."""
    counts = df.filter(col(name).isNotNull()).groupBy(col(name).alias("variant")).agg(F.count("*").alias("n"))
    group = Window.partitionBy(F.lower("variant"))  # the case variants of one word
    best = F.min_by("variant", F.struct(-F.col("n"), F.col("variant"))).over(group)
    return counts.withColumn("canonical", best).filter("variant <> canonical").select("variant", "canonical", "n")


def normalize_case(df: DataFrame, name: str, mapping: DataFrame | None = None) -> DataFrame:
    """CL-4."""
    mapping = staged(case_mapping(df, name)) if mapping is None else mapping
    out = lookup(df, mapping, col(name), "variant", "n", df.count())
    return out.select([F.coalesce("canonical", col(n)).alias(n) if n == name else col(n) for n in df.columns])


def drop_exact_duplicates(df: DataFrame, order: str | None = None, keep_position: bool = False) -> DataFrame:
    """CL-5: one row per distinct row, the first in order, as a combining group-by.

    A window over equal rows would put all copies of one row into one task. Without
    `keep_position` the kept copy cannot be told from the others, so order is not needed.
    """
    has_pos = POS in df.columns
    data = [c for c in df.columns if c != POS]
    plain = groupable(df.select(*map(col, data)))
    if not keep_position and plain.schema == df.select(*map(col, data)).schema:
        return df.select(*map(col, data)).distinct()
    d = df if has_pos else with_position(df, order)
    keys = {n: (col(n) if plain.schema[n] == df.schema[n] else
                (col(n).cast("string") if isinstance(df.schema[n].dataType, T.VariantType) else F.to_json(col(n))))
            for n in data}
    odd = [n for n in data if plain.schema[n] != df.schema[n]]
    g = d.groupBy(*[k.alias(f"_g{i}") for i, k in enumerate(keys.values())]).agg(
        F.min(POS).alias(POS), *[F.min_by(col(n), F.col(POS)).alias(f"_v_{n}") for n in odd])
    out = g.select(*[(F.col(f"`_v_{n}`") if n in odd else F.col(f"_g{i}")).alias(n) for i, n in enumerate(data)], POS)
    return out if keep_position else out.drop(POS)


def slug(name: str, position: int) -> str:
    """The words of a header, joined in snake case."""
    text = "_".join(re.findall(r"[A-Za-z0-9]+", name)).lower()
    return f"column_{position}" if not text or text.isdigit() else text


def header_mapping(columns: list[str], targets: set[str] | None = None) -> list[str]:
    """CL-6: new names in column order; names outside `targets` are kept and reserved first."""
    renamed = [targets is None or c in targets for c in columns]
    taken = {c for c, r in zip(columns, renamed) if not r}
    out = []
    for i, (c, r) in enumerate(zip(columns, renamed)):
        new = c
        if r:
            base = slug(c, i)
            new = next(x for x in chain([base], (f"{base}_{n}" for n in count(2))) if x not in taken)
            taken.add(new)
        out.append(new)
    return out


def normalize_headers(df: DataFrame, targets: set[str] | None = None) -> DataFrame:
    return df.toDF(*header_mapping(df.columns, targets))


def impute_nulls(df: DataFrame, name: str, method: str, order: str | None = None,
                 keys: tuple[str, ...] = ()) -> DataFrame:
    """CL-7 to CL-10. The method is the caller's choice; there is no default."""
    if method not in IMPUTE_METHODS:
        raise ValueError(f"unknown imputation method {method!r}; choose one of {IMPUTE_METHODS}")
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    field = df.schema[name]
    if method in ("mean", "median") and not isinstance(field.dataType, T.NumericType):
        raise ValueError(f"{method} needs a numeric column; {name!r} is {field.dataType.simpleString()}")
    df = nan_to_null(df)
    if method == "forward_fill":
        if order is None:
            filled = forward_fill(with_position(df), [name], POS, keys)
            return filled.drop(POS)
        return forward_fill(df, [name], order, keys)
    if method == "mean":
        fill = df.agg(F.avg(col(name)).alias("m")).first()["m"]
    elif method == "median":
        fill = exact_quantiles(df, {name: as_number(field)}, [0.5])[name][0]
    else:
        numeric = isinstance(field.dataType, T.NumericType)
        fill = modes(df, [name] if numeric else [], [] if numeric else [name]).get(name)
    if fill is None:
        return df
    value = F.lit(fill) if method != "mode" else F.lit(fill).cast(field.dataType)
    return df.select([F.coalesce(col(n), value).alias(n) if n == name else col(n) for n in df.columns])


# ---------------------------------------------------------------- gated pass

# The operation of each finding that may be cleaned, and the scope it reports.
OPERATIONS = {
    "mixed_types": "type_coercion",
    "case_inconsistency": "case_normalization",
    "duplicate_rows": "deduplication",
    "column_naming": "header_normalization",
}
SCOPES = {
    "type_coercion": "column",
    "case_normalization": "column",
    "deduplication": "row",
    "header_normalization": "table",
}
ORDER = list(SCOPES)
AUTONOMOUS = "agent_autonomous"

ACTIONS = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("operation", T.StringType()),
    T.StructField("defect_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("target_columns", T.ArrayType(T.StringType())),
    T.StructField("rows_affected", T.LongType()),
    T.StructField("values_changed", T.LongType()),
    T.StructField("before_state", T.StringType()),
    T.StructField("after_state", T.StringType()),
    T.StructField("value_mapping", T.MapType(T.StringType(), T.StringType())),
    T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("rule", T.StringType()),
    T.StructField("error", T.StringType()),
])
MAPPINGS = "column string, variant string, canonical string, n long"


def _action(operation: str, defect: str, columns: list[str], **more) -> dict:
    base = dict(operation=operation, defect_type=defect, status="applied", scope=SCOPES.get(operation, "column"),
                target_columns=columns, rows_affected=0, values_changed=0, before_state="", after_state="",
                value_mapping={}, parameters={}, rule="", error=None)
    return {**base, **more}


def apply_finding(df: DataFrame, finding, rows_before: int | None = None):
    """CL-12: run the one operation registered for an autonomous finding; refuse anything else.

    Returns the new table, the action record and the case mapping table (or None).
    """
    if finding["remediation_class"] != AUTONOMOUS:
        raise CleaningError(f"{finding['defect_type']!r} belongs to {finding['remediation_class']!r}")
    operation = OPERATIONS.get(finding["defect_type"])
    if operation is None:
        raise CleaningError(f"no operation is registered for {finding['defect_type']!r}")
    kind, columns = finding["defect_type"], list(finding["columns"])
    if operation == "deduplication":
        data = [c for c in df.columns if c != POS]
        sizes = quality.duplicate_facts(df.select(*map(col, data))).first()
        out = drop_exact_duplicates(df, keep_position=POS in df.columns)
        return out, _action(operation, kind, data, rows_affected=sizes["rows"] - sizes["distinct_rows"],
                            before_state=f"{sizes['rows']} rows", after_state=f"{sizes['distinct_rows']} rows",
                            rule="keep the first of equal rows"), None
    if operation == "case_normalization":
        name = columns[0]
        mapping = staged(case_mapping(df, name))
        size = mapping.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        out = normalize_case(df, name, mapping)
        return out, _action(operation, kind, [name], values_changed=size["n"],
                            before_state=f"{size['k']} spellings to replace", after_state="one spelling per value",
                            rule="most frequent spelling wins, ties go to the smallest"), \
            mapping.select(F.lit(name).alias("column"), "variant", "canonical", "n")
    if operation == "type_coercion":
        name = columns[0]
        out, meta = coerce_column(df, name)
        m = meta.first()
        return out, _action(operation, kind, [name], values_changed=m["values_changed"],
                            before_state=f"type {df.schema[name].dataType.simpleString()}",
                            after_state=f"type {out.schema[name].dataType.simpleString()}",
                            parameters={k: str(m[k]) for k in ("kind", "dominant_type", "uncoerced")},
                            rule="strip, then move cells to the dominant type; what cannot move is kept"), None
    raise CleaningError("headers are renamed for the whole table at once")


def rename_flagged(df: DataFrame, findings: list) -> tuple[DataFrame, dict]:
    if any(f["remediation_class"] != AUTONOMOUS for f in findings):
        raise CleaningError("a header finding is not autonomous")
    old = df.columns
    new = header_mapping(old, {f["columns"][0] for f in findings})
    mapping = {a: b for a, b in zip(old, new) if a != b}
    return df.toDF(*new), _action(
        "header_normalization", "column_naming", list(mapping), values_changed=len(mapping),
        before_state=f"{len(mapping)} headers to rename", after_state="snake_case headers", value_mapping=mapping,
        rule="lower-case slug, column_<position> when empty, _2, _3 on collision")


def clean(df: DataFrame, defects: DataFrame, order: str | None = None, error_chars: int = 200) -> dict[str, DataFrame]:
    """CL-11 to CL-13: act on the autonomous findings only, in a fixed order.

    Returns `table`, `actions` (one row per action), `mappings` (case variants, a
    table of its own since it may grow with the data) and `summary`. `error_chars` is the length of an error kept in the log.
    """
    spark = df.sparkSession
    findings = defects.collect()  # bounded by the schema
    mine = [f for f in findings if f["remediation_class"] == AUTONOMOUS]
    needs_pos = any(f["defect_type"] == "duplicate_rows" for f in mine) and order is not None
    work = with_position(df, order) if needs_pos else df
    actions, maps = [], []
    rows_before = df.count()
    for operation in ORDER:
        bucket = sorted((f for f in mine if OPERATIONS.get(f["defect_type"]) == operation),
                        key=lambda f: list(f["columns"])[:1])
        if operation == "header_normalization" and bucket:
            bucket = [bucket]
        for f in bucket:
            try:
                if isinstance(f, list):
                    work, action = rename_flagged(work, f)
                else:
                    work, action, mapping = apply_finding(work, f)
                    if mapping is not None:
                        maps.append(mapping)
            except CleaningError:
                raise
            except Exception as e:  # the table stays as it was before this action
                first = f[0] if isinstance(f, list) else f
                action = _action(operation, first["defect_type"], list(first["columns"]), status="failed",
                                 rule="the action raised; the table was left as it was",
                                 error=f"{type(e).__name__}: {str(e)[:error_chars]}")
            actions.append(action)
    for f in sorted((f for f in mine if f["defect_type"] not in OPERATIONS),
                    key=lambda f: (f["defect_type"], list(f["columns"])[:1])):
        actions.append(_action("no_op", f["defect_type"], list(f["columns"]), status="skipped",
                               rule="no operation is registered for this finding"))
    table = work.drop(POS) if needs_pos else work
    removed = sum(a["rows_affected"] for a in actions)
    mapping_table = spark.createDataFrame([], MAPPINGS)
    for m in maps:
        mapping_table = mapping_table.unionByName(m)
    records = [(i, *[a[f.name] for f in ACTIONS.fields[1:]]) for i, a in enumerate(actions)]
    summary = [(len(findings), len(mine), len(actions), rows_before, rows_before - removed,
                len(df.columns), len(table.columns))]
    return {
        "table": table,
        "actions": spark.createDataFrame(records, ACTIONS),
        "mappings": mapping_table,
        "summary": spark.createDataFrame(
            summary, "total_findings int, autonomous_findings int, actions int, rows_before long, "
                     "rows_after long, columns_before int, columns_after int"),
    }


# ---------------------------------------------------------------- older methods

def basic_clean(df: DataFrame) -> DataFrame:
    """CL-20: drop copies, numeric null to median, text null to the most frequent value."""
    d = staged(drop_exact_duplicates(nan_to_null(df)))
    fields = {f.name: f for f in d.schema}
    numeric, text = numeric_columns(d), text_columns(d)
    fill = {n: q[0] for n, q in exact_quantiles(d, {n: as_number(fields[n]) for n in numeric}, [0.5]).items()}
    fill.update(modes(d, [], text))
    return d.select([F.coalesce(col(n), F.lit(fill[n])).alias(n) if fill.get(n) is not None else col(n)
                     for n in d.columns])


def statistical_clean(df: DataFrame) -> DataFrame:
    """CL-21: drop copies, clip numbers to the 1.5 IQR fences, then null to median.

    The middle values lie between the quartiles, so clipping never moves the median
    and one quantile pass serves both steps.
    """
    d = staged(drop_exact_duplicates(nan_to_null(df)))
    fields = {f.name: f for f in d.schema}
    numeric = numeric_columns(d)
    quart = exact_quantiles(d, {n: as_number(fields[n]) for n in numeric}, [0.25, 0.5, 0.75])
    out = []
    for n in d.columns:
        if n not in quart or quart[n][0] is None:
            out.append(col(n))
            continue
        q1, mid, q3 = quart[n]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        x = as_number(fields[n])
        out.append(F.when(x.isNull(), F.lit(mid)).otherwise(F.greatest(F.least(x, F.lit(hi)), F.lit(lo))).alias(n))
    return d.select(out)


def domain_clean(df: DataFrame) -> DataFrame:
    """CL-24: drop copies, all-date text columns to timestamps, age and price must be present and not negative."""
    d = staged(drop_exact_duplicates(nan_to_null(df)))
    text = text_columns(d)
    dates = set()
    if text:
        row = d.agg(*[(F.count_if(col(t).isNotNull() & ~looks_like_date(col(t))) == 0).alias(f"c{i}")
                      for i, t in enumerate(text)],
                    *[F.count(col(t)).alias(f"n{i}") for i, t in enumerate(text)]).first()
        dates = {t for i, t in enumerate(text) if row[f"c{i}"] and row[f"n{i}"]}
    out = d.select([parse_date(col(n)).alias(n) if n in dates else col(n) for n in d.columns])
    for n in numeric_columns(d):
        if "age" in n.lower() or "price" in n.lower():
            out = out.filter(col(n) >= 0)
    return out


def ml_clean(df: DataFrame, neighbours: int = 5, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """CL-22 then CL-23: drop copies, nearest-neighbour imputation, isolation-forest filter."""
    from .forest import drop_isolated
    from .neighbours import impute_neighbours

    d = drop_exact_duplicates(nan_to_null(df))
    numeric = numeric_columns(d)
    if not numeric:
        return d
    return drop_isolated(impute_neighbours(staged(d), numeric, neighbours), numeric, contamination, seed)


METHODS = {"basic": basic_clean, "statistical": statistical_clean, "ml_based": ml_clean,
           "domain_specific": domain_clean}


def auto_clean(df: DataFrame, method: str = "auto") -> DataFrame:
    """CL-25: profile, recommend, clean."""
    if method == "auto":
        method = quality.recommend_cleaning(quality.table_profile(df)).first()["method"]
    return METHODS[method](df)
