"""Multi-line CSV files in many ranges against Spark's reader of whole files."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from evalspark.schemas import ITEMS
from evalspark.sources import split_csv
from evalspark.sources.readers import CSV_OPTIONS, read_annotations, read_items
from evalspark.sources.split_csv import Lines

HEAD = "TweetID,Username,CreateDate,Biased,Keyword,Text"


@pytest.fixture
def ranges(spark):
    """Ranges of a few bytes, so that a record lies in many of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def of(size):
        for name, value in zip(names, (size, "0", "1")):
            spark.conf.set(name, value)

    yield of
    for name in names:
        spark.conf.unset(name)


def table(spark, path, splittable):
    return sorted(map(tuple, read_items(spark, str(path), splittable=splittable).collect()), key=str)


def text(r):
    parts = ['"', '""', ",", "\n", "a", "b c", "é漢", '",', ',"', "\n\n", '"\n', "'", " "]
    return "".join(r.choices(parts, k=r.randint(0, 12)))


def write(path, rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(HEAD.split(","))
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def test_line_ends():
    ends = Lines().ends_inside
    for line, outside, inside in [
        ("a,b", False, True), ('"a,b', True, False), ('a,"b', True, False), ('a"b,c', False, False),
        ('"a""', True, False), ('"a"', False, False), ('"a"b",c', False, True), ('""', False, True),
        ('"""', True, False), ('","', False, True), ('a""', False, True), ('', False, True), ('"', True, False),
    ]:
        assert ends(line, False) == outside, line
        # Inside, the line goes on with the text of a field.
        assert ends(line, True) == ends('"' + line, False), line
    assert Lines(";", "'").ends_inside("a;'b", False)
    with pytest.raises(ValueError):
        Lines(delimiter="||")


@pytest.mark.parametrize("size", [19, 64, 100_000])
def test_equals_whole_files(spark, tmp_path, ranges, size):
    r = random.Random(size)
    rows = [(i, text(r) or None, "d", r.choice(["1", "0", "", "1.0"]), text(r), text(r)) for i in range(8 if size < 50 else 50)]
    write(tmp_path / "a.csv", rows[:5])
    write(tmp_path / "b.csv", rows[5:], "\r\n")
    (tmp_path / "c.csv").write_text(HEAD + "\n")
    expected = table(spark, tmp_path, False)
    assert len(expected) == len(rows)
    ranges(str(size))
    assert table(spark, tmp_path, True) == expected
    if size == 64:
        records = split_csv.read_records(spark, str(tmp_path))
        assert split_csv.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        lines = records.where("file LIKE '%a.csv'").orderBy("line").collect()
        raw = (tmp_path / "a.csv").read_text()
        assert "".join(x["record"] + "\n" for x in lines) == raw
        assert all(raw.split("\n")[x["line"]] == x["record"].split("\n")[0] for x in lines)


def test_text_after_a_closing_quote(spark, tmp_path, ranges):
    """Odd rows: quotes inside unquoted fields and text after a closing quote do not open a field."""
    body = ['1,u,d,1,k"k,te"xt', '2,u,d,0,"k"x,"a\nb"', '3,u,d,,"","x""y"', "", '4,u,d,1,"a ""b"" c",end', '5,"u",d,0,k, "q"']
    (tmp_path / "odd.csv").write_text("\n".join([HEAD, *body]) + "\n")
    expected = table(spark, tmp_path, False)
    ranges("16")
    assert table(spark, tmp_path, True) == expected
    assert [x[0] for x in expected] == [1, 2, 3, 4, 5]


def test_one_long_record(spark, tmp_path, ranges):
    """A quoted field over very many ranges, quotes and line breaks in it."""
    long = 'line, with "quotes"\n' * 60
    write(tmp_path / "x.csv", [(1, "u", "d", 1, "k", long), (2, "u", "d", 0, long, "short")])
    ranges("90")
    got = read_items(spark, str(tmp_path), splittable=True).orderBy("item_id").collect()
    assert [got[0]["text"], got[1]["keyword"], got[1]["text"]] == [long, long, "short"]


@pytest.mark.parametrize("row", ["7,u,d,1,k", "7,u,d,1,k,t,more", "x,u,d,1,k,t"])
def test_rows_that_do_not_fit_stop(spark, tmp_path, ranges, row):
    (tmp_path / "a.csv").write_text(f"{HEAD}\n1,u,d,1,k,t\n{row}\n")
    ranges("8")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_items(spark, str(tmp_path), splittable=True).collect()


def test_other_columns_stop(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD.replace("Keyword", "Topic") + "\n1,u,d,1,k,t\n")
    with pytest.raises(Exception, match="columns differ"):
        read_items(spark, str(tmp_path), splittable=True).collect()
    (tmp_path / "a.csv").write_text("﻿" + HEAD.lower() + "\n1,u,d,1,k,t\n")
    assert read_items(spark, str(tmp_path), splittable=True).count() == 1
    assert "enforceSchema" in CSV_OPTIONS and ITEMS.names[0] == "item_id"


def test_last_answer_across_files(spark, tmp_path, ranges):
    """Files follow each other by time of change, whatever their names; rows by their place."""
    for n, (name, answer) in enumerate([("z", "first"), ("m", "second"), ("a", "third")]):
        lines = [f"{HEAD},A_Decision,A_Explanation"]
        lines += [f'{i},u,d,1,k,t,Yes,"{answer}\n{i} {copy}"' for copy in (1, 2) for i in range(8)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / f"{name}.csv", (1_700_000_000 + n, 1_700_000_000 + n))
    ranges("100")
    table = read_annotations(spark, str(tmp_path), ["A"], splittable=True)
    last = table.groupBy("item_id").agg(F.max_by("A_Explanation", "ingest_seq").alias("last")).collect()
    last = {r["item_id"]: r["last"] for r in last}
    assert last == {i: f"third\n{i} 2" for i in range(8)}
    assert table.select("ingest_seq").distinct().count() == 48
