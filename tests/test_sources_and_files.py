import hashlib

import pytest

from countercheck.functions.names import ColumnError, adopt_spelling, by_folded_name, find_columns
from countercheck.operators import files as FI
from countercheck.sources.catalog import foreign_keys_of, information_schema_catalog, session_table_catalog
from countercheck.sources.flatten import flatten
from countercheck.sources.load import Source, SourceError, format_of, load
from countercheck.queries import shape
from countercheck.sinks.reports import write_csv


def test_names(spark):
    assert by_folded_name(["ID", "id", "Name"]) == {"id": "ID", "name": "Name"}
    assert find_columns(["NAME", "x"], ["Name"]) == (["Name"], ["x"])
    s, t = spark.createDataFrame([(1, 2)], "A int, b int"), spark.createDataFrame([(1, 2)], "a int, c int")
    assert adopt_spelling(t, s).columns == ["A", "c"]


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path, "a.csv", "id,name,ok,score,code\n1,x,true,1.5,007x\n2,N/A,False,,\n")
    df = load(spark, Source(path=path))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "boolean", "double", "string"]
    assert [tuple(r) for r in df.collect()] == [(1, "x", True, 1.5, "007x"), (2, None, False, None, None)]
    kept = load(spark, Source(path=path, na_values=(), columns=["NAME"]))
    assert [r["name"] for r in kept.collect()] == ["x", "N/A"]
    typed = load(spark, Source(path=path, schema="i int, n string, o string, s double, c string"))
    assert typed.columns == ["i", "n", "o", "s", "c"]
    semi = write(tmp_path, "b.txt", "id;name\n1;x\n2;y\n3;z\n")
    assert load(spark, Source(path=semi, options={"delimiter": ";"}, row_limit=2)).count() == 2


@pytest.mark.parametrize(
    ("text", "options"),
    [
        ('{"id":1,"n":{"a":{"b":2}}}\n{"id":2,"n":{"a":{"b":3}}}\n', {}),
        ('[{"id":1,"n":{"a":{"b":2}}},{"id":2,"n":{"a":{"b":3}}}]', {}),
        ('[\n {"id":1,\n  "n":{"a":{"b":2}}},\n {"id":2,"n":{"a":{"b":3}}}\n]', {"multiLine": "true"}),
    ],
)
def test_json(spark, tmp_path, text, options):
    df = load(spark, Source(path=write(tmp_path, "a.json", text), options=options))
    assert df.columns == ["id", "n.a.b"]
    assert [tuple(r) for r in df.collect()] == [(1, 2), (2, 3)]


def test_broken_json_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        load(spark, Source(path=write(tmp_path, "a.json", '{"id":1}\n{"id":\n'))).collect()


def test_csv_cells(spark, tmp_path):
    text = 'id,t\n9007199254740993001,"he said ""hi"""\n9007199254740993002,"two\nlines"\n1,back\\\n'
    df = load(spark, Source(path=write(tmp_path, "q.csv", text)))
    assert df.schema["id"].dataType.simpleString() == "decimal(38,0)"
    rows = {int(r["id"]): r["t"] for r in df.collect()}
    assert rows == {9007199254740993001: 'he said "hi"', 9007199254740993002: "two\nlines", 1: "back\\"}
    mixed = load(spark, Source(path=write(tmp_path, "m.csv", "v\n9007199254740993001\n1.5\n")))
    assert mixed.schema["v"].dataType.simpleString() == "string"


@pytest.mark.parametrize("bad", ["id,v\n3,4,5\n", "id,v\n3\n"])
def test_csv_rows_of_another_length_are_errors(spark, tmp_path, bad):
    with pytest.raises(Exception, match="(?i)malformed"):
        load(spark, Source(path=write(tmp_path, "l.csv", bad))).collect()


def test_csv_headers_must_agree(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    write(folder, "1.csv", "a,b\n1,x\n")
    write(folder, "2.csv", "b,a\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        load(spark, Source(format="csv", path=str(folder))).collect()


def test_written_csv_reads_back(spark, tmp_path):
    rows = [(1, 'a "b", c'), (2, "x\ny"), (3, " padded "), (4, "end\\")]
    df = spark.createDataFrame(rows, "id long, t string")
    write_csv(df, str(tmp_path / "w"))
    assert sorted(map(tuple, load(spark, Source(format="csv", path=str(tmp_path / "w"))).collect())) == rows


def test_xml_and_parquet(spark, tmp_path):
    path = write(tmp_path, "a.xml", "<rows><row><id>1</id><name>x</name></row><row><id>2</id><name>y</name></row></rows>")
    for options in ({"rowTag": "row"}, {"xpath": ".//row"}):
        assert load(spark, Source(path=path, options=options)).count() == 2
    with pytest.raises(SourceError):
        load(spark, Source(path=path))
    spark.range(4).write.parquet(str(tmp_path / "p.pq"))
    assert load(spark, Source(path=str(tmp_path / "p.pq"))).count() == 4


@pytest.mark.parametrize("name", ["source_xml", "source_csv"])
def test_files_that_one_task_reads_have_a_bound(spark, tmp_path, monkeypatch, name):
    """One file of customers becomes several, with every row in them."""
    monkeypatch.setattr(shape, "FILE_ROWS", 40)
    rows = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select(*shape.CUSTOMER)
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    out = shape.QUERIES[name][0](spark, str(tmp_path))
    assert len(out.inputFiles()) >= rows.count() / 40
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))


def test_table_query_and_errors(spark, tmp_path):
    spark.range(10).createOrReplaceTempView("people")
    assert load(spark, Source(table="people")).count() == 10
    assert load(spark, Source(query="select id from people where id < 3")).count() == 3
    for bad in (Source(), Source(path="x.unknown"), Source(format="csv"), Source(format="nope"), Source(format="jdbc")):
        with pytest.raises(SourceError):
            load(spark, bad)
    with pytest.raises(ColumnError):
        load(spark, Source(table="people", columns=["nope"]))
    assert format_of(Source(path="s3a://b/x.NDJSON")) == "json"


def test_flatten_leaves_flat_frames_alone(spark):
    df = spark.range(1)
    assert flatten(df) is df


def test_session_catalog(spark, tmp_path):
    spark.sql(f"create table cat_t (id int, code varchar(12)) using parquet location '{tmp_path}/cat'")
    rows = {r["column_name"]: r for r in session_table_catalog(spark, "cat_t").collect()}
    assert rows["code"]["max_length"] == 12 and rows["code"]["category"] == "STRING"
    assert session_table_catalog(spark, "no_such_table") is None
    spark.sql("drop table cat_t")


def test_information_schema(spark):
    columns = spark.createDataFrame(
        [("t", "id", 1, "integer", None, 32, "NO", None), ("t", "n", 2, "character varying", 9, None, "YES", "x"),
         ("t", "p", 3, "point", None, None, "YES", None)],
        "table_name string, column_name string, ordinal_position int, data_type string, "
        "character_maximum_length int, numeric_precision int, is_nullable string, column_default string",
    )
    keys = spark.createDataFrame([("t", "id")], "table_name string, column_name string")
    rows = {r["column_name"]: r for r in information_schema_catalog(columns, keys).collect()}
    assert (rows["id"]["category"], rows["id"]["is_primary_key"], rows["id"]["nullable"]) == ("INTEGER", True, False)
    assert (rows["n"]["max_length"], rows["n"]["default_value"], rows["n"]["category"]) == (9, "x", "STRING")
    assert rows["p"]["category"] == "OTHER"


def test_foreign_keys(spark):
    rows = spark.createDataFrame(
        [("fk", "c", "b", "p", "y", 2), ("fk", "c", "a", "p", "x", 1), ("odd", "c", "z", None, None, 1)],
        "constraint_name string, table_name string, column_name string, referred_table string, "
        "referred_column string, ordinal_position int",
    )
    (fk,) = foreign_keys_of(rows)
    assert (fk.columns, fk.referred_columns) == (("a", "b"), ("x", "y"))


@pytest.mark.parametrize("algorithm", ["sha256", "md5"])
def test_file_comparison(spark, tmp_path, algorithm):
    for side, texts in {"s": {"a": "1", "d/b": "2", "gone": "3"}, "t": {"a": "1", "d/b": "x", "new": "4"}}.items():
        for name, text in texts.items():
            path = tmp_path / side / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    sides = [FI.checksums(FI.list_files(spark, str(tmp_path / s)), algorithm) for s in "st"]
    compared = FI.compare_files(*sides)
    rows = {r["relative_path"]: r for r in compared.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        "a": "MATCH", "d/b": "MISMATCH", "gone": "MISSING_IN_TARGET", "new": "EXTRA_IN_TARGET",
    }
    assert rows["a"]["source_checksum"] == hashlib.new(algorithm, b"1").hexdigest()
    assert tuple(FI.file_summary(compared).first()) == (4, 3, "FAIL")
    one = FI.list_files(spark, str(tmp_path / "s" / "a")).first()
    assert (one["relative_path"], one["bytes"]) == ("a", 1)
    with pytest.raises(ValueError):
        FI.checksums(FI.list_files(spark, str(tmp_path / "s")), "nope")


def test_hidden_files_are_compared(spark, tmp_path):
    for side, texts in {"s": {"a": "1", "_b": "2", ".c/d": "3", "e/.f": "4"}, "t": {"a": "1", "_b": "x", ".c/d": "3"}}.items():
        for name, text in texts.items():
            path = tmp_path / side / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    sides = [FI.checksums(FI.list_files(spark, str(tmp_path / s))) for s in "st"]
    rows = {r["relative_path"]: r["status"] for r in FI.compare_files(*sides).collect()}
    assert rows == {"a": "MATCH", "_b": "MISMATCH", ".c/d": "MATCH", "e/.f": "MISSING_IN_TARGET"}
    one = FI.list_files(spark, str(tmp_path / "s" / "_b")).collect()
    assert [(r["relative_path"], r["bytes"]) for r in one] == [("_b", 1)]
