"""Delimited files as they come: several files, other column orders, marks and blanks; and where jobs write."""

import pytest
from pyspark.sql import functions as F

from dyadspark import session
from dyadspark.operators import roster
from dyadspark.sources import readers

COLUMNS = [("A", "a", "bigint"), ("B", "b", "string")]


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


def test_columns_are_found_by_their_header(spark, tmp_path):
    path = write(tmp_path, x="B,A,C\nu,1,z\nv,2,z\n")
    assert sorted(tuple(r) for r in readers.read_csv(spark, path, COLUMNS).collect()) == [(1, "u"), (2, "v")]
    with pytest.raises(ValueError, match="Z"):
        readers.read_csv(spark, path, [("Z", "z", "string")])


def test_files_with_other_headers_are_refused(spark, tmp_path):
    path = write(tmp_path, x="A,B\n1,u\n", y="B,A\nv,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, path, COLUMNS).collect()


def test_marks_blanks_and_missing_cells(spark, tmp_path):
    path = write(tmp_path, x="\ufeffA , B\r\n 1, u \r\nNA,NA\r\n3,\r\nx,w\r\n")
    rows = readers.read_csv(spark, path, COLUMNS).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [(1, "u"), (None, None), (3, None), (None, "w")]))


def test_empty_header_cell(spark, tmp_path):
    path = write(tmp_path, x=",B\n1,u\n")
    assert [tuple(r) for r in readers.read_csv(spark, path, [("B", "b", "string")]).collect()] == [("u",)]


def test_row_order_follows_files_not_their_size(spark, tmp_path):
    big = "A,B\n" + "".join(f"{i},later\n" for i in range(1, 2000))
    path = write(tmp_path, a="A,B\n1,first\n", b=big)
    rows = readers.read_csv(spark, path, COLUMNS, row_number="place")
    assert rows.orderBy("place").first().b == "first"
    offspring = rows.select(
        F.col("a").alias("off_id"), F.lit(5).alias("parent"), F.col("b").alias("spouse_id"), F.lit(90.0).alias("confidence"),
        F.col("place").alias("file_row"))
    parents = {r.off_id: r.spouse_id for r in roster.genetic_parents(offspring).collect()}
    assert parents[1] == "first" and parents[2] == "later"


def test_intermediates_lie_in_one_folder_of_the_session(spark):
    one, two = session.shared_folder(spark), session.shared_folder(spark)
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0] == session.run_folder(spark)


def test_executors_elsewhere_need_a_shared_folder(spark):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "local-cluster[2,1,1024]"

    class Elsewhere:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.run_folder(Elsewhere())
