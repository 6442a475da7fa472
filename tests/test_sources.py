"""Readers: delimiter sniffing, encodings, format dispatch, empty rows/columns."""

import pytest

from tablewright.schema import OperatorError
from tablewright.sources.files import (detect_format, drop_empty, list_tables, load_tables, name_tables,
                                       read_csv, read_table, sniff_delimiter)
from tablewright.sources.records import records


def test_semicolon_sniffed(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("x;y;z\n1;2;3\n4;5;6\n")
    assert sniff_delimiter(spark, str(p)) == ";"
    out = read_csv(spark, str(p))
    assert out.columns == ["x", "y", "z"] and out.count() == 2
    assert dict(out.dtypes) == {"x": "bigint", "y": "bigint", "z": "bigint"}


def test_tab_and_types(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("n\tv\tb\n1\t1.5\ttrue\n2\t2\tfalse\n")
    out = read_table(spark, str(p))
    assert dict(out.dtypes) == {"n": "bigint", "v": "double", "b": "boolean"}


def test_latin1(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("name,city\nJosé,Málaga\n".encode("latin-1"))
    out = read_csv(spark, str(p), encoding="ISO-8859-1")
    assert out.first().name == "José"


def test_format_dispatch(spark, tmp_path):
    assert detect_format("/x/y.parquet") == "parquet"
    assert detect_format("/x/y.TSV") == "csv"
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    path = str(tmp_path / "t.json")
    df.write.json(path)
    assert read_table(spark, path).count() == 1


def test_drop_empty_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, None)], "a int, b string")
    out = drop_empty(df)
    assert out.columns == ["a"] and out.count() == 2


def test_naming_rule(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert list(name_tables([df])) == ["current"]
    assert list(name_tables([df, df])) == ["table_0", "table_1"]
    assert list(name_tables([df, df], ["x", None])) == ["x", "table_1"]


def test_csv_missing_words_and_quoted_breaks(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('a,b,t\n1,NA,"x\ny"\n2,3.5,"say ""hi"", n"\n3,NaN,null\n')
    out = read_csv(spark, str(p))
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "t": "string"}
    assert [tuple(r) for r in out.orderBy("a").collect()] == [(1, None, "x\ny"), (2, 3.5, 'say "hi", n'), (3, None, None)]


def test_union_of_csv_files_has_one_inference(spark, tmp_path):
    from tablewright.sources.files import union_files
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.csv").write_text("k,v\n2,x\n")
    out = union_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "csv")
    assert dict(out.dtypes) == {"k": "bigint", "v": "string"}
    assert sorted(tuple(r) for r in out.collect()) == [(1, "2"), (2, "x")]


ROWS = [("id", "note"), ("1", "plain"), ("2", "a\nb"), ("3", 'say ""x""\n\n""'), ("4", "\n" * 30 + "deep"), ("5", ""), ("6", "é,€"), ("7", "x" * 300 + "\n" + "y" * 300), ("8", "end")]


@pytest.mark.parametrize("size", [7, 40, 64, 1000, 1 << 20])
def test_records_over_many_splits(spark, tmp_path, size):
    """Records cut from splits of any size are those of Python's reader."""
    import csv
    import io
    text = "\n".join(f'{a},"{b}"' for a, b in ROWS) + "\n\n" + "\n".join(f'{i + 9},"q{i}\n{i}"\n{i + 500},z' for i in range(40)) + '\n999,"not closed\nat the end'
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    (tmp_path / "b.csv").write_text("\ufeffid,note\n70,b\n", encoding="utf-8")
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        found = records(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
        if size < 100:
            assert found.rdd.getNumPartitions() > 5
        got = [next(csv.reader(io.StringIO(r["record"]))) for r in found.collect() if not r["first"]]
        firsts = [r["record"] for r in found.collect() if r["first"]]
        out = read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], infer_types=False).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [r for r in csv.reader(io.StringIO(text)) if r][1:] + [["70", "b"]]
    assert sorted(got) == sorted(want) and firsts == ['id,"note"', "id,note"]
    missing = [[a, b or None] for a, b in want if a != "999"]
    assert sorted((tuple(r) for r in out if r["id"] != "999"), key=repr) == sorted(map(tuple, missing), key=repr)


def test_each_file_in_its_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,v\n1,é€\n".encode())
    (tmp_path / "b.csv").write_bytes("k,v\n2,é\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("k,v\n3,é\n".encode("utf-16"))
    out = read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "é€"), (2, "é")]
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "c.csv"), delimiter=",", encoding="UTF-16").collect()] == [(3, "é")]


def test_catalogue_lists_any_file_system(spark, tmp_path):
    for name in ("x", "y"):
        spark.range(3).write.parquet(f"file:{tmp_path}/t/{name}.parquet")
    spark.range(1).write.json(f"file:{tmp_path}/t/z.json")
    assert list_tables(spark, f"file:{tmp_path}/t") == ["x", "y"]
    assert {n: df.count() for n, df in load_tables(spark, f"file:{tmp_path}/t").items()} == {"x": 3, "y": 3}
    with pytest.raises(OperatorError):
        load_tables(spark, f"file:{tmp_path}/t", ["nope"])
    spark.range(2).write.parquet(f"{tmp_path}/plain")
    assert read_table(spark, f"{tmp_path}/plain").count() == 2
