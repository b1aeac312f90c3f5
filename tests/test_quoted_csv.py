import random

import pytest
from pyspark.sql import functions as F

from lodgecast.schema import LISTING_SCHEMA
from lodgecast.sources.quoted_csv import _lines, blocks_inside, csv_records
from lodgecast.sources.tables import read_listings_csv

NAMES = LISTING_SCHEMA.fieldNames()
NAME_PLACE = NAMES.index("name")


def quoted(value):
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n\r') else value


def write_file(path, rows, end="\n", last=True):
    lines = [",".join(NAMES)] + [",".join(quoted(v) for v in row) for row in rows]
    path.write_text(end.join(lines) + (end if last else ""), newline="")


def listing_rows(n, seed):
    draw = random.Random(seed)
    bits = ["loft", 'the "best"', "a,b", "\n", "\n\n", "é 家", '"', "", " view ", '""\n"', "N/A"]
    rows = []
    for i in range(n):
        row = [""] * len(NAMES)
        row[0] = str(i)
        row[NAME_PLACE] = "x" + "".join(draw.choice(bits) for _ in range(draw.randint(0, 9)))
        row[NAMES.index("price")] = str(draw.randint(1, 900))
        rows.append(row)
    return rows


@pytest.fixture
def tiny_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("last", [True, False])
def test_one_file_read_by_many_tasks_equals_one_reader(spark, tmp_path, tiny_blocks, last):
    path = tmp_path / "a.csv"
    rows = listing_rows(400, 3)
    rows[200][NAME_PLACE] = "long\n" * 500  # one field over several blocks
    write_file(path, rows, last=last)
    assert _lines(spark, str(path)).select(F.spark_partition_id()).distinct().count() > 10
    assert blocks_inside(_lines(spark, str(path)))
    found = read_listings_csv(spark, str(path)).collect()
    want = read_listings_csv(spark, str(path), loose_quotes=True).collect()
    assert len(found) == 400 and sorted(found, key=str) == sorted(want, key=str)
    assert {r["name"] for r in found} >= {rows[200][NAME_PLACE]}


def test_carriage_returns_empty_lines_and_several_files(spark, tmp_path, tiny_blocks):
    for k in range(3):
        write_file(tmp_path / f"{k}.csv", listing_rows(40, k), end="\r\n" if k else "\n\n")
    found = read_listings_csv(spark, str(tmp_path)).collect()
    want = read_listings_csv(spark, str(tmp_path), loose_quotes=True).collect()
    assert len(found) == 120 and sorted(found, key=str) == sorted(want, key=str)


def test_header_is_checked_and_a_file_of_only_a_header_has_no_rows(spark, tmp_path):
    write_file(tmp_path / "none.csv", [])
    assert csv_records(spark, str(tmp_path / "none.csv"), NAMES).collect() == []
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="header"):
        csv_records(spark, str(tmp_path / "other.csv"), NAMES).collect()
