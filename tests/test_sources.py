import datetime as dt
import os

import pytest
from helpers import rows
from pyspark.sql import functions as F, types as T

from tablewright.plans import reports
from tablewright.sources import readers as rd, sinks as sk


def write(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_types_and_missing_spellings(spark, folder):
    path = write(folder, "a.csv", 'id,price,ok,name\n1,2.5,true,"x, ""y"""\n2,N/A,FALSE,null\n\n3,,true,None\n')
    df = rd.read_csv(spark, path)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string"]
    assert rows(df, "id") == [(1, 2.5, True, 'x, "y"'), (2, None, False, None), (3, None, True, None)]


def test_missing_file_and_list(spark, folder):
    with pytest.raises(rd.SourceError):
        rd.read_csv(spark, f"{folder}/none.csv")
    with pytest.raises(rd.SourceError):
        rd.read_csv(spark, [])


def test_ragged_csv_fails_or_is_rejected(spark, folder):
    path = write(folder, "b.csv", "a,b\n1,2\n\n3\n4,5,6\n7,\n")
    with pytest.raises(Exception):
        rd.read_strict_csv(spark, path).collect()
    good, bad = rd.read_strict_csv(spark, path, rejects=True)
    assert rows(good, "a") == [("1", "2"), ("7", None)] and sorted(r["line"] for r in bad.collect()) == ["3", "4,5,6"]


def test_text_shapes(spark, folder):
    table = rd.read_text(spark, write(folder, "t.txt", "\n a\tb\n1\t\n2\tx\n"))
    assert rows(table)[1] == ("2", "x") and rows(table)[0] == ("1", "")
    lines = rd.read_text(spark, write(folder, "l.txt", "first\n\n  \nsecond\nthird\n"))
    assert rows(lines.select("Line", "Content"), "Line") == [(1, "first"), (2, "second"), (3, "third")]


def test_any_number_of_text_files_is_one_scan(spark, folder, capsys):
    os.makedirs(f"{folder}/in")
    for i in range(60):
        write(f"{folder}/in", f"{i:02d}.txt", f"Chapter {i}, the {i}th\nfirst line, of {i}\nsecond\n")
    d = rd.read_text_maps(spark, f"{folder}/in")
    d.explain()
    assert capsys.readouterr().out.count("BatchScan") == 1 and d.rdd.getNumPartitions() == 1  # small files share a task
    got = rows(d.select("file", "line", "table", F.map_values("fields").alias("v")), "file", "line")
    assert [(r[1], r[2], list(r[3])) for r in got[:2]] == [(1, True, ["first line", " of 0"]), (2, True, ["second", ""])] and len(got) == 120


def test_text_cells_with_line_ends_repeated_names_and_odd_rows(spark, folder):
    write(folder, "t.txt", "\ufeff\n  \na,a,b\r\n\"x\ny\",2\r\n\r\n   \r\n1,2,3,4\n")
    got = rows(rd.read_text_maps(spark, f"{folder}/t.txt").select("line", "fields"), "line")
    assert got == [(1, {"a": "x\ny", "a_1": "2", "b": ""}), (2, {"a": "1", "a_1": "2", "b": "3"})]
    with pytest.raises(rd.SourceError):
        rd.read_text(spark, f"{folder}/none.txt")
    os.makedirs(f"{folder}/empty")
    assert rd.read_text(spark, f"{folder}/empty").collect() == []


def test_files_are_packed_by_size_and_never_cut():
    from tablewright.sources.text_tables import packed
    assert packed([("a", 5), ("b", 5), ("c", 30), ("d", 1), ("e", 1)], 12) == [["a", "b"], ["c"], ["d", "e"]]
    assert packed([], 12) == []


def test_leading_empty_files_are_packed_with_the_others(spark, folder):
    from tablewright.sources.text_tables import packed
    assert packed([("a", 0), ("b", 0), ("c", 5)], 12) == [["a", "b", "c"]] and packed([("a", 0), ("b", 50)], 12) == [["a"], ["b"]]
    write(folder, "a.txt", "")
    path = write(folder, "b.txt", "one\n\ntwo\n")
    assert sorted(r["Content"] for r in rd.read_text(spark, [f"{folder}/a.txt", path]).collect()) == ["one", "two"]


def test_each_text_file_has_its_own_shape(spark, folder):
    os.makedirs(f"{folder}/in")
    for name, text in (("a.txt", "k,p\n1,x\n2,\n"), ("b [1] %.txt", "\nk\tq\n3\ty,z\n"), ("c.txt", "only\n\nplain\n"), ("d.txt", "k,p\n4,w\n"),
                       ("e.txt", "p,k\nv,5\n"), ("f.txt", "\n \n")):
        write(f"{folder}/in", name, text)
    got = rd.read_text(spark, f"{folder}/in")
    assert sorted(got.columns) == ["Content", "Line", "file", "k", "p", "q"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows(got.select("k", "p", "q", "Line", "Content")), key=key) == sorted([
        ("1", "x", None, None, None), ("2", "", None, None, None), ("4", "w", None, None, None), ("5", "v", None, None, None),
        ("3", None, "y,z", None, None), (None, None, None, 1, "only"), (None, None, None, 2, "plain")], key=key)


def test_lines_of_a_file_in_many_splits(spark, folder):
    path = write(folder, "big.txt", "".join(f"line {i}\n" + ("\n" if i % 3 == 0 else "") for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = rd.read_text(spark, path)
        assert out.rdd.getNumPartitions() > 3
        assert [(r["Line"], r["Content"]) for r in out.orderBy("Line").collect()] == [(i + 1, f"line {i}") for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_json_shapes(spark, folder):
    objects = rd.read_json(spark, write(folder, "o.json", '[{"z": 1, "a": null, "n": {"k": [1]}}, {"a": "x", "z": 0, "b": 9}, {"z": false}]'))
    assert objects.columns == ["z", "a", "n"]
    assert rows(objects) == [("1", "", '{"k":[1]}'), ("", "x", ""), ("", "", "")]
    scalars = rd.read_json(spark, write(folder, "s.json", '["x", 2, null]'))
    assert rows(scalars, "Index") == [(0, '"x"'), (1, "2"), (2, "null")]
    entries = rd.read_json(spark, write(folder, "e.json", '{"a": 1, "b": {"c": 2}, "d": "t"}'))
    assert sorted(rows(entries)) == [("a", "1"), ("b", '{"c":2}'), ("d", "t")]
    with pytest.raises(rd.SourceError):
        rd.read_json(spark, write(folder, "x.json", "{nope"))


def test_xml_paths(spark, folder):
    path = write(folder, "d.xml", '<r v="1"><a>x</a><a k="2">y<b>z</b></a><c><d>1</d><d>2</d></c></r>')
    assert rd.read_xml(spark, path).first()["fields"] == {
        "r.$.v": "1", "r.a[0]": "x", "r.a[1]._": "y", "r.a[1].$.k": "2", "r.a[1].b[0]": "z", "r.c[0].d[0]": "1", "r.c[0].d[1]": "2"}
    assert rd.xml_columns(rd.read_xml(spark, path)).count() == 1


def test_grid(spark):
    cells = [(1, 1, "s", "name", None), (1, 2, "s", None, None), (1, 3, "s", "when", None), (2, 1, "s", "a", None), (2, 2, "n", None, "=B1+1"),
             (2, 3, "d", "2024-01-05 00:00:00", None), (4, 1, "e", "#REF!", "=X"), (4, 2, "n", "7", "=3+4")]
    table, errors = rd.grid_to_table(spark.createDataFrame(cells, "row long, col int, dtype string, value string, formula string"))
    assert table.columns == ["row", "name", "Column 2", "when"]
    assert rows(table, "row") == [(2, "a", None, "2024-01-05T00:00:00"), (3, None, None, None), (4, None, "7", None)]
    assert rows(errors, "row") == [(2, "Column 2", "formula_cell", "=B1+1"), (4, "name", "error_cell", "#REF!")]


def test_grid_keeps_cells_right_of_the_header_and_times(spark):
    cells = [(1, 1, "s", "a", None), (2, 1, "d", "10:30:00", None), (2, 2, "n", "99", None), (3, 1, "d", "2024-01-05 10:30:00.123", None)]
    table, errors = rd.grid_to_table(spark.createDataFrame(cells, "row long, col int, dtype string, value string, formula string"))
    assert table.columns == ["row", "a", "Column 2"] and errors.count() == 0
    assert rows(table, "row") == [(2, "10:30:00", "99"), (3, "2024-01-05T10:30:00.123000", None)]


def test_json_documents_of_different_shapes(spark):
    docs = spark.createDataFrame([('[{"a": 1}, {"b": 5}]',), ('[{"b": 2}]',), ("oops",), ('["x"]',), ('{"k": true}',), ("7",), (None,), ("[]",)], "t string")
    with pytest.raises(rd.SourceError, match="2 documents"):
        rd.json_rows(docs, "t")
    good, bad = rd.json_rows(docs, "t", rejects=True)
    assert sorted(r["document"] for r in bad.collect()) == ["7", "oops"]
    assert good.columns == ["a", "b", "Index", "Value", "Key"]
    assert sorted(map(str, rows(good))) == sorted(map(str, [
        ("1", None, None, None, None), ("", None, None, None, None), (None, "2", None, None, None),
        (None, None, 0, '"x"', None), (None, None, None, "true", "k")]))


def test_malformed_xml_is_rejected(spark):
    docs = spark.createDataFrame([(1, "<r><a>x</a></r>"), (2, "<r>"), (3, None)], "k int, t string")
    good, bad = rd.flatten_documents(docs, "k", "t", rejects=True)
    assert [(r["k"], r["fields"]) for r in good.collect()] == [(1, {"r.a[0]": "x"})]
    assert sorted(r["k"] for r in bad.collect()) == [2, 3]
    with pytest.raises(Exception):
        rd.flatten_documents(docs, "k", "t").collect()


def test_dispatch_and_keys(spark, folder):
    with pytest.raises(rd.SourceError):
        rd.read_any(spark, f"{folder}/x.xls")
    assert rd.read_any(spark, write(folder, "A.CSV", "a\n1\n")).first()["a"] == 1
    df = spark.createDataFrame([("/d/My File (1).csv",), ("/d/..hidden.csv",), ("/d/---.txt",), ("plain",)], "p string")
    assert [r[0] for r in df.select(rd.dataset_key(F.col("p"))).collect()] == ["my_file__1_", "hidden", "dataset", "plain"]


def test_sink_guards(spark, folder):
    df = spark.range(3)
    with pytest.raises(ValueError):
        sk.result_rows(df, "u", "d", "magic")
    with pytest.raises(ValueError):
        sk.export_tables({"a": df}, ["a", "b"], folder)
    with pytest.raises(ValueError):
        sk.catalogue_row(df, "d", "u", "n", 1, "lost")
    log = sk.activity_rows(spark, [{"user_id": "u", "action": "clean", "status": "error", "metadata": {"rows": 3}, "error_message": "no"}])
    assert log.first()["metadata"] == '{"rows":"3"}'
    with pytest.raises(ValueError):
        sk.activity_rows(spark, [{"user_id": "u", "action": "clean", "status": "odd"}])
    with pytest.raises(Exception, match="not allowed"):
        sk.activity_table(df, F.lit("u"), F.lit("a"), F.lit("odd"), F.lit("{}"), F.lit(None)).collect()
    sk.write_csv(df, f"{folder}/out")
    with pytest.raises(Exception):
        sk.write_csv(df, f"{folder}/out")  # never overwrites


def test_report_from_files(spark, folder):
    day = dt.date(2026, 1, 1)
    text = "date,region,revenue,units\n" + "".join(f"{day + dt.timedelta(days=i)},{'NSEW'[i % 4]},{1000 + i * 7 % 90},{i % 9}\n" for i in range(60))
    store = sk.BaselineStore(spark, f"{folder}/base")
    path = write(folder, "Clean Sales.csv", text)
    first = reports.report_from_files(spark, [path], store)
    assert not first["halted"] and first["drift"] is None and store.load("clean_sales")["rows"] == 60
    second = reports.report_from_files(spark, [path], store)
    assert second["drift"]["summary"].first()["findings"] == 0
    sections = {r["section"] for r in second["report"].collect()}
    assert {0, 1, 2, 3, 4} <= sections
    bad = write(folder, "bad.csv", "date,region,revenue\n" + "".join(f"{day},{'NS'[i % 2]}{i},{'' if i < 12 else i}\n" for i in range(20)))
    halted = reports.report_from_files(spark, [bad])
    assert halted["halted"] and "revenue" in halted["halt_reason"]


def test_ask(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k + k % 2, "ab"[k % 2]) for k in range(30)], "price double, cost double, kind string")
    out = reports.ask(df, "why is there a correlation between price and cost?")
    assert out["answer"].first()["answer"].startswith("Found strong correlation between price and cost")
