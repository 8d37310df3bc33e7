"""The sheet data source: columns by range, filters where rows are read, appends that are whole or nothing."""

import pytest
from pyspark.sql import functions as F

from recollect.sources import sheet

LEADS = "created_at,email,role"


@pytest.fixture
def sheets(spark):
    sheet.use_sheets(spark)
    return spark


def append(df, path):
    df.write.format("sheet").mode("append").option("path", path).save()


def test_append_and_read_by_column(sheets, tmp_path):
    path = f"{tmp_path}/s"
    read = lambda **o: sheets.read.format("sheet").options(path=path, **o).load()
    assert read(header=LEADS).count() == 0
    append(sheets.range(10).selectExpr("concat('t', id) a", "concat('m', id, '@x.co') b", "IF(id = 3, NULL, 'ñ \"q\"\n') c").repartition(3), path)
    append(sheets.createDataFrame([("t10", "m3@x.co", "again")], "a string, b string, c string"), path)
    rows = read(header=LEADS)
    assert rows.columns == ["created_at", "email", "role"] and rows.count() == 11
    emails = read(range="Leads!B2:B")
    assert emails.columns == ["B"] and sorted(r[0] for r in emails.collect()) == sorted([f"m{i}@x.co" for i in range(10)] + ["m3@x.co"])
    assert {r["role"] for r in rows.collect()} == {"", "again", 'ñ "q"\n'}
    found = rows.where(F.col("email") == "m3@x.co")
    assert sorted(r["created_at"] for r in found.collect()) == sorted(r["created_at"] for r in read(header=LEADS, equals="B=m3@x.co").collect()) == ["t10", "t3"]
    assert rows.where("lower(trim(email)) = 'm4@x.co'").count() == 1
    assert read(range="D:E").where("D IS NULL AND E IS NULL").count() == 11


def test_aborted_append_leaves_nothing(sheets, tmp_path):
    path = f"{tmp_path}/s"
    append(sheets.range(3).selectExpr("cast(id AS string) a"), path)
    bad = sheets.range(0, 40, 1, 4).selectExpr("IF(id = 33, raise_error('broken'), cast(id AS string)) a")
    with pytest.raises(Exception, match="broken"):
        append(bad, path)
    assert sheets.read.format("sheet").option("path", path).option("range", "A").load().count() == 3
    assert [f.name for f in (tmp_path / "s" / "_staged").iterdir()] == []
    with pytest.raises(Exception, match="append"):
        sheets.range(1).selectExpr("'x' a").write.format("sheet").mode("overwrite").option("path", path).save()


def test_ranges():
    assert [sheet.letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(sheet.number(sheet.letters(n)) == n for n in range(2000))
    assert list(sheet.columns_of("Leads!B:D")) == [1, 2, 3] and list(sheet.columns_of("b2")) == [1] and list(sheet.columns_of("My Sheet!D1:B9")) == [1, 2, 3]
    with pytest.raises(ValueError):
        sheet.columns_of("Leads!1:2")
