"""Workbooks as a format of Spark: dates, several files, pieces of a sheet joined; pairs by position."""

import datetime as dt
import random
import zipfile
import zlib
from xml.etree import ElementTree as ET

import pytest

from themescope.operators.index import numbered
from themescope.sources import results, xlsx

T = dt.datetime


def book(path, cells, formats=(), late=False, names=("data",)):
    """A workbook with a row of cells (value, style) a line, as other programs write it."""
    main = xlsx.MAIN[1:-1]
    custom = "".join(f'<numFmt numFmtId="{164 + k}" formatCode="{f.replace('"', '&quot;')}"/>' for k, f in enumerate(formats))
    styles = "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 22, 20, 46, *range(164, 164 + len(formats))))
    rows = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c s="{s}"><v>{v}</v></c>' for v, s in r) + "</row>" for r in cells)
    links = "".join(f'<Relationship Id="r{k}" Type="t" Target="/xl/worksheets/s{k}.xml"/>' for k in range(len(names)))
    listed = "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="r{k}"/>' for k, n in enumerate(names))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{xlsx.PACKAGE[1:-1]}">{links}</Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{xlsx.LINKS[1:-1]}"><workbookPr date1904="{int(late)}"/><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts>{custom}</numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs>{styles}</cellXfs></styleSheet>')
        for k in range(len(names)):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')


HEAD = [("day", 0), ("n", 0)]


def test_dates_are_timestamps(spark, tmp_path):
    book(tmp_path / "a.xlsx", [HEAD, [(45000.5, 2), (1.5, 0)], [(59, 1), (2, 0)], [(60, 1), (3, 0)], [(61, 1), (4, 0)]])
    xlsx.register(spark)
    df = spark.read.format("xlsx").load(str(tmp_path / "a.xlsx"))
    assert df.dtypes == [("day", "timestamp_ntz"), ("n", "double")]
    assert [r.day for r in df.collect()] == [T(2023, 3, 15, 12), T(1900, 2, 28), T(1900, 2, 28), T(1900, 3, 1)]
    assert xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx")).collect() == df.collect()


def test_formats_that_show_dates(tmp_path):
    formats = ("yyyy-mm-dd", "0.00", '"day" 0', "[Red]0", "[$-409]h:mm AM/PM", "0\\d", "General", "#,##0_d")
    book(tmp_path / "a.xlsx", [HEAD], formats)
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert xlsx.date_styles(z) == {1, 2, 3, 5, 9}
    assert xlsx.moment(0.75) == "18:00:00" and xlsx.moment(0.0, True) == "00:00:00"
    assert xlsx.moment(1.0, True) == T(1904, 1, 2) and xlsx.moment(43831.999999) == T(2020, 1, 1, 23, 59, 59, 914000)
    for t in (T(1900, 1, 1), T(1900, 2, 28, 6), T(1900, 3, 1), T(2024, 2, 29, 23, 59, 59)):
        assert xlsx.moment(xlsx.serial_of(t)) == t


def test_several_files_and_sheets_are_several_tasks(spark, tmp_path):
    for k in range(3):
        book(tmp_path / f"{k}.xlsx", [[("n", 0), ("t", 0)], [(k, 0), (f"x{k}", 0)], [(k + 0.5 if k == 2 else 9, 0), (3, 0)]], names=("data", "more"))
    (tmp_path / "other.txt").write_text("no workbook")
    xlsx.register(spark)
    read = lambda **o: spark.read.format("xlsx").options(**o).load(str(tmp_path))
    one = read()
    assert one.rdd.getNumPartitions() == 3 and one.dtypes == [("n", "double"), ("t", "string")]
    assert sorted((r.n, r.t) for r in one.collect()) == [(0.0, "x0"), (1.0, "x1"), (2.0, "x2"), (2.5, "3"), (9.0, "3"), (9.0, "3")]
    assert read(sheet="*").rdd.getNumPartitions() == 6 and read(sheet="*").count() == 12
    picked = spark.read.format("xlsx").schema("t string, missing double").load(str(tmp_path))
    assert picked.columns == ["t", "missing"] and {r.missing for r in picked.collect()} == {None}
    with pytest.raises(Exception, match="no sheet"):
        read(sheet="nowhere").collect()


def test_checksums_of_pieces_combine():
    rng = random.Random(0)
    for a, b in ((0, 0), (0, 5), (7, 0), (1, 1), (1000, 70_001)):
        x, y = rng.randbytes(a), rng.randbytes(b)
        assert xlsx.combined_crc(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


def test_pieces_of_many_tasks_are_one_sheet(spark, tmp_path):
    path = str(tmp_path / "big.xlsx")
    df = spark.range(0, 30_000, 1, 7).selectExpr("id", "concat('row <', id, '> & more ', repeat('é', id % 50)) AS t", "timestamp_ntz'2024-01-02 03:04:05' AS at", "id % 3 = 0 AS flag", "CASE WHEN id % 2 = 0 THEN id / 8 END AS x", "array(id) AS l")
    xlsx.write_xlsx(df, path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        root = ET.fromstring(z.read("xl/worksheets/sheet1.xml"))
        assert len(root[0]) == 30_001
    back = xlsx.read_xlsx(spark, path)
    assert back.dtypes == [("id", "bigint"), ("t", "string"), ("at", "timestamp_ntz"), ("flag", "boolean"), ("x", "double"), ("l", "string")]
    want = df.withColumn("l", df.l.cast("string")).collect()
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in want]
    assert [p.name for p in tmp_path.iterdir()] == ["big.xlsx"]


def test_a_failed_task_and_a_full_sheet_leave_nothing(spark, tmp_path, monkeypatch):
    df = spark.range(0, 100, 1, 4)
    with pytest.raises(Exception):  # noqa: B017
        xlsx.write_xlsx(df.selectExpr("CASE WHEN id = 60 THEN raise_error('no') ELSE id END AS id"), str(tmp_path / "a.xlsx"))
    assert list(tmp_path.iterdir()) == []
    writer = xlsx.SheetWriter(str(tmp_path / "b.xlsx"), "data", df.schema)
    (tmp_path / writer.folder.rsplit("/", 1)[1]).mkdir()
    with pytest.raises(ValueError, match="a sheet holds"):
        writer.commit([xlsx.Written(0, "nowhere", xlsx.Piece(rows=xlsx.MOST_ROWS))])
    assert list(tmp_path.iterdir()) == []
    xlsx.write_xlsx(df.limit(0), str(tmp_path / "c.xlsx"))
    assert list(xlsx.read_sheet((tmp_path / "c.xlsx").read_bytes(), "data")) == [["id"]]


# ---- pairs by position


def test_rows_are_numbered_in_the_order_of_files(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.csv").write_text("a,b\n" + "".join(f"{k},{n}\n" for n in range(k * 300)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        df = spark.read.csv(str(tmp_path), header=True, schema="a int, b int")
        assert df.rdd.getNumPartitions() > 5
        rows, n = numbered(df)
        got = sorted(rows.collect(), key=lambda r: r.position)
        want = [(k, m) for k in range(5) for m in range(k * 300)]
        assert n == len(want) and [(r.a, r.b, r.position) for r in got] == [(*w, p) for p, w in enumerate(want)]
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Sort" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    made, n = numbered(spark.range(10, 0, -1).toDF("k"))
    assert n == 10 and [r.k for r in sorted(made.collect(), key=lambda r: r.position)] == list(range(10, 0, -1))
    assert numbered(spark.range(0))[1] == 0


def test_input_and_results_are_paired_by_their_places(spark, tmp_path):
    spark.createDataFrame([(k, f"t{k}") for k in range(50)], "n int, title string").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(f"c{k}", f"r{k}") for k in range(50)], "primary_class string, title string").coalesce(1).write.parquet(str(tmp_path / "out"))
    rows, done = spark.read.parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "out"))
    pairs = results.zipped(rows, done)
    assert pairs.columns == ["n", "title", "primary_class", "result_title"]
    assert all((r.title, r.primary_class, r.result_title) == (f"t{r.n}", f"c{r.n}", f"r{r.n}") for r in pairs.collect()) and pairs.count() == 50
    with pytest.raises(ValueError, match="50 rows can't be paired with 49"):
        results.zipped(rows, done.limit(49))
    results.write_csv(rows, done, str(tmp_path / "csv"), key=None)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 50
