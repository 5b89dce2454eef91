"""CSV with lines that don't fit."""

from pyspark.sql import types as T

from tidemark.sources import io

SCHEMA = T.StructType().add("id", "long").add("day", "date").add("x", "double")


def test_rejects_stand_beside_typed_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,day,x\n1,2024-01-31,1.5\n2,yesterday,2.5\n3,2024-02-29,\n4,2024-03-31,4,more\n5,2024-03-31\n"6",2024-04-30,"6"\nseven,2024-04-30,7\n')
    rows, rejects = io.csv_and_rejects(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), SCHEMA)
    assert rows.schema.simpleString() == SCHEMA.simpleString()
    assert sorted((r["id"], str(r["day"]), r["x"]) for r in rows.collect()) == [(1, "2024-01-31", 1.5), (3, "2024-02-29", None), (6, "2024-04-30", 6.0)]
    assert sorted(r["line"] for r in rejects.collect()) == ["2,yesterday,2.5", "4,2024-03-31,4,more", "5,2024-03-31", "seven,2024-04-30,7"]


def test_nothing_but_good_or_bad_lines(spark, tmp_path):
    for name, text, good, bad in (("a", "id,day,x\n1,2024-01-31,1\n", 1, 0), ("b", "id,day,x\nno,2024-01-31,1\n", 0, 1), ("c", "id,day,x\n", 0, 0)):
        (tmp_path / f"{name}.csv").write_text(text)
        rows, rejects = io.csv_and_rejects(spark, str(tmp_path / f"{name}.csv"), str(tmp_path / name), SCHEMA)
        assert (rows.count(), rejects.count()) == (good, bad)
