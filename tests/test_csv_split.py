"""CSV files read in parts against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from haggle.sources import csv_split

VALUES = ["plain", 'a "stray quote', '"quoted, comma"', '"line\nbreak ""x"" , y"', "", '""', " sp ", '"many\n\n\nlines\r\n,"', "é한", "'", '"x"y']


def whole(spark, path):
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    pairs = [x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))]
    return rows.select(F.create_map(*pairs).alias("fields"), F.monotonically_increasing_id().alias("ord"))


def rows_of(df):
    return [sorted(r.fields.items()) for r in df.orderBy("ord").collect()]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_parts_give_the_rows_of_the_whole(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    rows = ["name,가격,name,,b", *(",".join(rng.choice(VALUES) for _ in range(5)) for _ in range(1500)), "", "x,y", "a,b,c,d,e,f,g", '"open', "never closed, 1"]
    texts = {
        "long": "\ufeff" + "\n".join(rows), "crlf": "\r\n".join(rows[:200]) + "\r\n", "cr": "\r".join(["a,b", "1,2", '"x\r y",3']), "mixed": 'a,b\n1,2\r\n3,"x\ny"\n', "none": "", "header": "a,b\n",
        "wide": 'a,b\n1,"' + "long field\n" * 2000 + '"\n2,3\n', "head": '"a\nb",c\n1,2\n',
    }
    for name, text in texts.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode())
        assert rows_of(csv_split.csv_rows(spark, str(path))) == rows_of(whole(spark, str(path))), name
    assert csv_split._lines(spark, str(tmp_path / "long.csv")).rdd.getNumPartitions() > 20


def test_files_of_a_folder_follow_each_other(spark, tmp_path, small_blocks):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("a,b\n" + "".join(f'{i}-{k},"x\n{k}"\n' for k in range(300)))
    rows = csv_split.csv_rows(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.fields["a"] for r in rows] == [f"{i}-{k}" for i in range(3) for k in range(300)]
    assert len({r.ord for r in rows}) == 900 and all(r.fields["b"] == f"x\n{r.fields['a'].split('-')[1]}" for r in rows)


@pytest.mark.parametrize("line,outside,inside", [("a,b", False, True), ('"a', True, False), ('a"b,c', False, False), ('"a""', True, False), ('x,"y"z,"', True, True), ('a","b', True, True), ('""', False, True)])
def test_a_line_leaves_a_field_open_or_not(line, outside, inside):
    assert csv_split.ends_inside(line, False) is outside and csv_split.ends_inside(line, True) is inside
