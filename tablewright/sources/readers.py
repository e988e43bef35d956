"""Readers: delimited text, JSON, XML and cell grids as DataFrames."""

from __future__ import annotations

import re
import xml.parsers.expat
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import NUMBER_TEXT, col
from ..functions.stage import staged
from . import text_tables

# Cell texts that mean "missing".
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SAFE_KEY = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


class SourceError(ValueError):
    """The source is missing, unreadable or of an unknown kind."""


def _load(read, path) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as e:
        raise SourceError(f"cannot read {path}: {e.getCondition() or e}") from e


def null_tokens(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Text cells that spell a missing value become null."""
    return df.select([
        F.when(~F.trim(col(f.name)).isin(tokens), col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else col(f.name) for f in df.schema])


def infer_types(df: DataFrame) -> DataFrame:
    """Give all-text columns the narrowest of long, double and boolean that every value fits. One aggregate."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    lower = lambda n: F.lower(F.trim(col(n)))
    row = df.agg(*[e.alias(f"{k}{i}") for i, n in enumerate(names) for k, e in (
        ("n", F.count(col(n))), ("l", F.count_if(F.trim(col(n)).rlike(r"^[+-]?\d{1,18}$"))),
        ("d", F.count_if(lower(n).rlike(NUMBER_TEXT))), ("b", F.count_if(lower(n).isin("true", "false"))))]).first()
    kind = {}
    for i, n in enumerate(names):
        total = row[f"n{i}"]
        kind[n] = next((t for k, t in (("l", "long"), ("d", "double"), ("b", "boolean"))
                        if total and row[f"{k}{i}"] == total), None)
    return df.select([F.trim(col(n)).cast(kind[n]).alias(n) if kind.get(n) else col(n) for n in df.columns])


def read_csv(spark: SparkSession, path, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """SRC-1 and SRC-10: header row, missing-value tokens, inferred types; a bad record fails the read."""
    if isinstance(path, (list, tuple)) and not path:
        raise SourceError("the source list is empty")
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST").option("escape", '"')
    if schema is not None:
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        df = null_tokens(_load(reader.schema(text).csv, path))
        return df.select([col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return infer_types(null_tokens(_load(reader.csv, path)))


def read_tsv(spark: SparkSession, path) -> DataFrame:
    """SRC-2."""
    return read_csv(spark, path, sep="\t")


def read_strict_csv(spark: SparkSession, path, schema: T.StructType | None = None,
                    rejects: bool = False, header: bool = True) -> DataFrame | tuple[DataFrame, DataFrame]:
    """SRC-3: text cells, blank lines skipped, empty cells null; the first bad record fails the read.

    With `rejects` the bad records come back as a second table (line) instead.
    """
    base = spark.read.option("header", header).option("escape", '"')
    if schema is None:
        schema = _load(base.csv, path).schema
    if not rejects:
        return _load(base.option("mode", "FAILFAST").schema(schema).csv, path)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    # Saved once: good and bad records must come from the same parse.
    d = staged(_load(base.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
                     .schema(wide).csv, path))
    bad = F.col("_corrupt_record").isNotNull()
    return d.filter(~bad).drop("_corrupt_record"), d.filter(bad).select(F.col("_corrupt_record").alias("line"))


def read_text_maps(spark: SparkSession, path) -> DataFrame:
    """SRC-4 as (file, line, table, fields): one scan for any number of files, however many shapes they have.

    A file whose first non-blank line has a comma or a tab is a table: fields are its cells by name, '' where empty.
    Another file gives its non-blank lines as the field Content. `line` numbers the rows of a file from 1.
    """
    paths = [path] if isinstance(path, str) else list(path)
    try:
        absent = text_tables.missing(paths)
    except (OSError, ValueError) as e:
        raise SourceError(f"cannot read {path}: {e}") from e
    if absent or not paths:
        raise SourceError(f"cannot read {absent or paths}: nothing there")
    return text_tables.scan(spark, paths)


def read_text(spark: SparkSession, path) -> DataFrame:
    """SRC-4: a delimited table when the first non-blank line of a file has a comma or tab, else (file, Line, Content).

    Each file decides by its own first line. Files of several shapes give the columns of all of them, null where a file
    has no such column; with very many shapes take `read_text_maps`.
    """
    d = read_text_maps(spark, path)
    # A row per column name and one for plain files, whatever the number of files; every file shows its shape in row 1.
    shown = d.filter("line = 1").select("table", F.posexplode(F.map_keys("fields")).alias("p", "name"))
    shapes = shown.groupBy("table", "name").agg(F.min("p").alias("p")).orderBy("p", "name").collect()
    names = [r["name"] for r in shapes if r["table"]]
    plain = len(names) < len(shapes) or not names
    cells = [F.when(F.col("table"), F.try_element_at("fields", F.lit(n))).alias(n) for n in names]
    line = [F.when(~F.col("table"), F.col("file")).alias("file"), F.when(~F.col("table"), F.col("line")).alias("Line"),
            F.when(~F.col("table"), F.try_element_at("fields", F.lit(text_tables.CONTENT))).alias("Content")]
    return d.select(*cells, *(line if plain else []))


# ---------------------------------------------------------------- JSON

def _variant_text(v: Column) -> Column:
    """Scalars as text, objects and arrays as JSON text."""
    t = F.schema_of_variant(v)
    nested = t.startswith("OBJECT") | t.startswith("ARRAY")
    return F.when(v.isNull() | F.is_variant_null(v), None).when(nested, F.to_json(v)).otherwise(v.cast("string"))


def _truthy_text(v: Column) -> Column:
    """Text of a value, '' where it is null, false, 0 or empty."""
    t = F.schema_of_variant(v)
    text = _variant_text(v)
    number = ~(t.startswith("OBJECT") | t.startswith("ARRAY") | (t == "STRING") | (t == "BOOLEAN"))
    falsy = text.isNull() | (text == "") | ((t == "BOOLEAN") & (text == "false")) | (
        number & (text.try_cast("double") == 0))
    return F.when(falsy, "").otherwise(text)


def read_json(spark: SparkSession, path) -> DataFrame:
    """SRC-5: array of objects (columns of the first object), array of scalars (Index, Value) or object (Key, Value)."""
    return json_rows(_load(spark.read.option("wholetext", True).text, path), "value")


def json_rows(docs: DataFrame, text: str, rejects: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The rows of a column of JSON documents; each document decides its own shape and columns.

    An array whose first element is an object gives a row per element with the columns of that object, another array
    (Index, Value), an object (Key, Value). The result has the columns of all documents, null where a document has no
    such column. A text that is none of these fails the read, or, with `rejects`, comes back in a second table
    (document). Null texts are no documents.
    """
    v = F.try_parse_json("t")
    shape = F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))
    keys = F.json_object_keys(F.get_json_object("t", "$[0]"))
    d = docs.select(col(text).alias("t")).filter("t is not null").withColumn("v", v).withColumn(
        "k", F.when(shape.startswith("ARRAY"), keys)).withColumn(
        "kind", F.when(F.col("k").isNotNull(), "table").when(shape.startswith("ARRAY"), "list")
        .when(shape.startswith("OBJECT"), "object").otherwise("bad"))
    found = d.groupBy("kind").agg(F.count("*").alias("n"), F.min("t").alias("one")).collect()  # four kinds at most
    kinds = {r["kind"]: r for r in found}
    if "bad" in kinds and not rejects:
        raise SourceError(f"{kinds['bad']['n']} documents are no JSON array or object, such as {kinds['bad']['one'][:80]!r}")
    if not kinds:
        raise SourceError("there is no document")
    parts = []
    if "table" in kinds:
        tables = d.filter("kind = 'table'")
        # One row per column name, in the order of their first places.
        names = tables.select(F.posexplode("k").alias("p", "name")).groupBy("name").agg(F.min("p").alias("p"))
        names = [r["name"] for r in names.orderBy("p", "name").collect()]
        quote = lambda k: '$["' + k.replace("\\", "\\\\").replace('"', '\\"') + '"]'
        items = tables.select("k", F.explode(F.expr("try_cast(v as array<variant>)")).alias("value"))
        parts.append(items.select([F.when(F.array_contains("k", k), _truthy_text(F.try_variant_get("value", quote(k), "variant")))
                                   .alias(k) for k in names]))
    if "list" in kinds:
        items = d.filter("kind = 'list'").selectExpr("posexplode(try_cast(v as array<variant>)) as (pos, value)")
        parts.append(items.select(F.col("pos").cast("long").alias("Index"), F.to_json("value").alias("Value")))
    if "object" in kinds:
        entries = d.filter("kind = 'object'").select(
            F.explode(F.map_entries(F.expr("try_cast(v as map<string,variant>)"))).alias("e"))
        parts.append(entries.select(F.col("e.key").alias("Key"), _variant_text(F.col("e.value")).alias("Value")))
    if not parts:
        parts.append(docs.sparkSession.createDataFrame([], "Key string, Value string"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return (rows, d.filter("kind = 'bad'").select(F.col("t").alias("document"))) if rejects else rows


# ---------------------------------------------------------------- XML

def flatten_xml(text: str) -> dict[str, str]:
    """One document as path -> text: children are listed (`a.b[0]`), attributes sit under `$`, mixed text under `_`."""
    root: list = []
    stack: list[dict] = []

    def start(name, attributes):
        stack.append({"name": name, "attributes": attributes, "text": "", "children": {}})

    def end(_):
        node = stack.pop()
        (stack[-1]["children"].setdefault(node["name"], []) if stack else root).append(node)

    def data(chunk):
        if stack:
            stack[-1]["text"] += chunk

    parser = xml.parsers.expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.Parse(text, True)
    out: dict[str, str] = {}
    work = [(node["name"], node) for node in root]
    while work:
        path, node = work.pop(0)
        inner = node["attributes"] or node["children"]
        content = node["text"]
        if not inner:
            out[path] = content if content.strip() else ""
            continue
        if content.strip():
            out[f"{path}._"] = content.strip() if node["children"] else content
        out.update({f"{path}.$.{k}": v for k, v in node["attributes"].items()})
        work = [(f"{path}.{name}[{i}]", child) for name, group in node["children"].items()
                for i, child in enumerate(group)] + work
    return out


def read_xml(spark: SparkSession, path) -> DataFrame:
    """SRC-6: (file, fields map<path, text>), one row per document."""
    docs = _load(spark.read.option("wholetext", True).text, path).select(
        F.col("_metadata.file_path").alias("file"), "value")
    return flatten_documents(docs, "file", "value")


def flatten_documents(docs: DataFrame, key: str, text: str, rejects: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(key, fields map<path, text>) of a column of XML documents; a malformed one fails the read.

    With `rejects` the malformed ones come back as a second table (key, error) instead. Null texts are malformed.
    """

    def one(t: str | None) -> tuple[dict[str, str] | None, str | None]:
        try:
            return flatten_xml(t or ""), None
        except xml.parsers.expat.ExpatError as e:
            if not rejects:
                raise
            return None, str(e)

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [one(t) for t in pdf["_text"]]
            yield pd.DataFrame({key: pdf[key], "fields": [f for f, _ in out], "error": [e for _, e in out]})

    schema = T.StructType([docs.schema[key], T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
                           T.StructField("error", T.StringType())])
    rows = docs.select(col(key), col(text).alias("_text")).mapInPandas(flat, schema)
    if not rejects:
        return rows.drop("error")
    rows = staged(rows)  # good and bad documents must come from the same parse
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").drop("fields")


def xml_columns(docs: DataFrame) -> DataFrame:
    """The flattened documents as one column per path (paths of all documents, sorted)."""
    paths = sorted(r["p"] for r in docs.select(F.explode(F.map_keys("fields")).alias("p")).distinct().collect())
    keys = [col(c) for c in docs.columns if c != "fields"]
    return docs.select(*keys, *[F.try_element_at("fields", F.lit(p)).alias(p) for p in paths])


# ---------------------------------------------------------------- cell grids

def grid_to_table(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-7: cells (row, col, dtype, value, formula) of one sheet as a table and its parse errors.

    The first row gives the names; blank ones, and columns right of the last name, become `Column N`. dtype: 'd' date
    or time, 'e' error, anything else a plain value. Dates become ISO texts with their fractions; times of day stay as
    they are. Error cells and formulas without a result are null and listed.
    """
    spark = cells.sparkSession
    span = cells.agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.max("col").alias("w")).first()
    if span["lo"] is None:
        raise SourceError("the sheet is empty")
    head = {r["col"]: r["value"] for r in cells.filter(F.col("row") == span["lo"]).collect()}  # one row of the sheet
    width = span["w"]
    names = [head.get(i) if head.get(i) not in (None, "") else f"Column {i}" for i in range(1, width + 1)]
    broken = F.col("dtype") == "e"
    no_result = F.col("value").isNull() & F.col("formula").isNotNull()
    at = F.when(F.col("value").rlike(r"^\s*\d{4}-\d"), F.col("value").try_cast("timestamp"))
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(F.unix_micros(at) % 1_000_000 == 0, whole).otherwise(F.concat(whole, F.date_format(at, ".SSSSSS")))
    value = F.when(broken | no_result, None).when(F.col("dtype") == "d", F.coalesce(iso, F.col("value"))).otherwise(
        F.col("value"))
    body = cells.filter((F.col("row") > span["lo"]) & (F.col("col") <= width))
    wide = body.groupBy("row").agg(*[F.max(F.when(F.col("col") == i, value)).alias(f"c{i}") for i in range(1, width + 1)])
    rows = spark.range(span["lo"] + 1, span["hi"] + 1).select(F.col("id").alias("row"))
    table = rows.join(wide, "row", "left").select(
        "row", *[F.col(f"c{i}").alias(n) for i, n in enumerate(names, 1)])
    titles = F.get(F.array(*map(F.lit, names)), F.col("col") - 1)
    errors = body.filter(broken | no_result).select(
        F.col("row"), titles.alias("column"), F.when(broken, "error_cell").otherwise("formula_cell").alias("issue"),
        F.when(broken, F.col("value")).otherwise(F.col("formula")).alias("raw_value"))
    return table, errors


# ---------------------------------------------------------------- dispatch, preview, keys

READERS = {"csv": read_csv, "tsv": read_tsv, "txt": read_text, "json": read_json, "xml": read_xml}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: the reader for the path's extension."""
    found = re.search(r"\.([^./]+)$", path.rstrip("/"))
    kind = found.group(1).lower() if found else ""
    if kind not in READERS:
        raise SourceError(f"unsupported file type {kind or path!r}; supported: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path)


def preview(df: DataFrame, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """SRC-9: the first rows, and one row (rows, columns, names)."""
    shape = df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                   F.array(*map(F.lit, df.columns)).alias("names"))
    return df.limit(rows), shape


def dataset_key(path: Column) -> Column:
    """SRC-11: a safe key from a file path."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    key = F.regexp_replace(F.regexp_replace(stem, r"[^a-z0-9._-]", "_"), r"^[._-]+", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("dataset"))


def check_key(key: str) -> str:
    if not re.match(SAFE_KEY, key):
        raise SourceError(f"unsafe dataset key {key!r}")
    return key
