import datetime

import numpy as np
import pytest

from constella.sources import files

SCHEMA = "t:t_id(int),t_name(str),t_flag(bool),t_day(date),dummy(str);"


def test_tbl(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("# head\n1|a|1|19970203|\n\n// note\n2|NULL|0|19980101|\n")
    rows = files.read_tbl(spark, str(tmp_path / "t.tbl"), files.parse_schema(SCHEMA)["t"]).orderBy("t_id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", True, datetime.date(1997, 2, 3)), (2, "NULL", False, datetime.date(1998, 1, 1))]


def test_binary(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    np.array([5, 6, 7], "<i8").tofile(d / "t_id.bin")
    np.array([1, 0, 1], "<i8").tofile(d / "t_name.bin")
    (d / "t_name_dict.tsv").write_text("NULL\t0\nx\t1\n")
    np.array([1, 0, 1], "<i1").tofile(d / "t_flag.bin")
    np.array([0, 86400, 86400 * 2], "<i8").tofile(d / "t_day.bin")
    rows = files.read_binary_table(spark, str(tmp_path), "t", files.parse_schema(SCHEMA)["t"]).orderBy("t_id").collect()
    day = datetime.date(1970, 1, 1)
    assert [tuple(r) for r in rows] == [(5, "x", True, day), (6, "NULL", False, day + datetime.timedelta(1)), (7, "x", True, day + datetime.timedelta(2))]


def test_long_column_in_ranges(spark, tmp_path):
    (tmp_path / "t").mkdir()
    n = 3 * files.PIECE + 11
    np.arange(n, dtype="<i8").tofile(tmp_path / "t" / "t_id.bin")
    got = files.read_binary_column(spark, str(tmp_path), "t", "t_id", "int")
    assert got.count() == n and got.where("pos != t_id").isEmpty()
    np.array([], "<i8").tofile(tmp_path / "t" / "t_no.bin")
    assert files.read_binary_column(spark, str(tmp_path), "t", "t_no", "int").isEmpty()


def test_dictionary_has_to_be_in_order(spark, tmp_path):
    for n, text in enumerate(("NULL\t0\nb\t1\na\t2\n", "a\t0\nb\t1\n", "NULL\t0\na\t2\n", "NULL\t0\na\t1\nb\t1\n")):
        (tmp_path / f"{n}.tsv").write_text(text)
        with pytest.raises(ValueError):
            files.read_dictionary(spark, str(tmp_path / f"{n}.tsv"))
    (tmp_path / "good.tsv").write_text("NULL\t0\n\t1\na\t2\n")
    assert sorted(files.read_dictionary(spark, str(tmp_path / "good.tsv")).collect()) == [("", 1), ("NULL", 0), ("a", 2)]


def test_schema_is_loaded_and_converted(spark, tmp_path):
    (tmp_path / "schema.txt").write_text("t:t_id(int),t_name(str);\nu:u_id(int);\n")
    (tmp_path / "t.tbl").write_text("1|a|\n2|NULL|\n")
    (tmp_path / "u.tbl").write_text("7|\n")
    text = files.load_tables(spark, str(tmp_path), "csv", views=True)
    assert sorted(text) == ["t", "u"] and spark.sql("SELECT sum(t_id) FROM t").first()[0] == 3
    schema = files.parse_schema((tmp_path / "schema.txt").read_text())
    files.write_binary_table(spark, str(tmp_path), "t", {"t_id": [1, 2], "t_name": ["a", None]}, schema["t"])
    files.write_binary_table(spark, str(tmp_path), "u", {"u_id": [7]}, schema["u"])
    assert files.convert(spark, str(tmp_path), str(tmp_path / "out"), "bin") == ["t", "u"]
    assert sorted(spark.read.parquet(str(tmp_path / "out" / "t.parquet")).collect()) == sorted(text["t"].collect())
    with pytest.raises(ValueError):
        files.load_tables(spark, str(tmp_path), "other")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string").coalesce(1)
    files.write_tsv(df, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert text[0] == "n\ts" and text[1] == "1\ta"
    assert files.preview(spark.range(20).coalesce(1), "id", 2) == ([0, 1], [18, 19])
    files.dump_column(df, "n", str(tmp_path / "dump"))
    assert next((tmp_path / "dump").glob("part-*")).read_text().split() == ["1", "2"]


def test_random_columns(spark):
    for kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        a, b = (files.random_column(spark, 100, kind, 3).collect() for _ in range(2))
        assert a == b and len(set(a)) > 50
