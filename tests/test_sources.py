"""CSV scanning, tables, models on disk, and the incremental form of cleaning."""

import pytest
from pyspark.sql import functions as F

from cartloom.operators import cleaning
from cartloom.sources import files, tables
from cartloom.sources.fixtures import INVOICE_COLUMNS
from cartloom.streaming import incremental


def test_malformed_lines_still_load(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("Invoice,Price,Country\n1,abc,France\n2,3.5\n3,4,Spain\n")
    rows = files.csv_scan(spark, str(tmp_path / "bad.csv"), keep_corrupt=True).orderBy("Invoice").collect()
    assert [(r["Invoice"], r["Price"], r["Country"]) for r in rows] == [("1", "abc", "France"), ("2", "3.5", None), ("3", "4", "Spain")]
    assert [r[files.CORRUPT] is not None for r in rows] == [False, True, False]


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.csv_scan(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize("separator", files.SEPARATORS)
def test_round_trip_of_each_separator(spark, tmp_path, lines, separator):
    df = lines([{"CustomerID": None}, {"Description": "a;b|c", "Price": 3.25}])
    df = df.withColumn("Price", F.col("Price").cast("decimal(18,4)"))
    path = str(tmp_path / "out.csv")
    files.write_csv(df, path, separator)
    assert files.detect_separator(spark, path) == separator
    back = files.typed_invoice_lines(files.csv_scan(spark, path))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select(*INVOICE_COLUMNS).collect()))


def test_encoding_is_found_anywhere_in_the_file(spark, tmp_path):
    body = b"Invoice,Country\n" + b"1,France\n" * 5000
    (tmp_path / "u.csv").write_bytes(body + "2,Réunion\n".encode())
    (tmp_path / "l.csv").write_bytes(body + "2,Réunion\n".encode("iso-8859-1"))
    assert files.detect_encoding(spark, str(tmp_path / "u.csv")) == "utf-8"
    assert files.detect_encoding(spark, str(tmp_path / "l.csv")) == "iso-8859-1"
    assert files.csv_scan(spark, str(tmp_path / "l.csv")).where("Country = 'Réunion'").count() == 1


def test_catalog_and_cache(spark, tmp_path):
    for name in ("b.csv", "a.csv", "c.txt"):
        (tmp_path / name).write_text("x,y\n1,2\n")
    assert [r["file"] for r in files.file_catalog(spark, str(tmp_path)).collect()] == ["a.csv", "b.csv"]
    cache = files.ScanCache(spark)
    path = str(tmp_path / "a.csv")
    assert cache.load(path) is cache.load(path)
    assert cache.load(path, force=True).count() == 1


def test_a_changed_file_is_read_again(spark, tmp_path):
    cache, path = files.ScanCache(spark), tmp_path / "a.csv"
    path.write_text("x,y\n1,2\n")
    first = cache.load(str(path))
    assert [tuple(r) for r in first.collect()] == [("1", "2")]
    path.write_text("x,y\n1,2\n30,40\n")
    again = cache.load(str(path))
    assert again is not first and again.count() == 2
    assert cache.load(str(path)) is again
    with pytest.raises(FileNotFoundError):
        cache.load(str(tmp_path / "none.csv"))


def test_a_changed_table_is_seen_by_the_next_query(spark, sf_dir, tmp_path):
    import shutil

    from cartloom.plans.mart import GIVEN, mart_for

    for name in GIVEN:
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    mart = mart_for(spark, str(tmp_path))
    before = mart.orders.count()
    assert mart_for(spark, str(tmp_path)) is mart
    fewer = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 2 = 0").toPandas()
    fewer.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    assert mart_for(spark, str(tmp_path)).orders.count() == len(fewer) < before


def test_encoding_is_judged_by_the_first_lines_of_every_split(spark, tmp_path):
    body = b"Invoice,Country\n" + b"1,France\n" * 50 + "2,Réunion\n".encode("iso-8859-1")
    (tmp_path / "l.csv").write_bytes(body)
    assert files.detect_encoding(spark, str(tmp_path), sample_lines=20) == "utf-8"
    assert files.detect_encoding(spark, str(tmp_path), sample_lines=None) == "iso-8859-1"
    wrong = files.csv_scan(spark, str(tmp_path), "utf-8", ",")
    assert wrong.agg(files.unreadable_lines(wrong)).first()[0] == 1


def test_a_load_counts_its_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;é\n2;\n")
    row = files.load_metrics(spark, str(tmp_path / "a.csv")).first()
    assert (row["rows"], row["columns"], row["encoding"], row["unreadable_lines"]) == (2, 2, "utf-8", 0)
    assert row["loading_seconds"] > 0 and row["file_size_mb"] == (tmp_path / "a.csv").stat().st_size / 1024 / 1024


def test_absent_targets_are_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "A"), (2, "B")], "customer_id int, target string")
    path = str(tmp_path / "segments")
    assert tables.read_segments(spark, path, ["A"], like=df).count() == 0
    tables.write_segments(df, path)
    assert [r["customer_id"] for r in tables.read_segments(spark, path, ["A", "Z"]).collect()] == [1]


def test_stream_equals_batch(spark, tmp_path, mart):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    first, second = mart.raw.randomSplit([0.5, 0.5], seed=1)
    for part in (first, second):
        part.write.mode("append").parquet(source)
        incremental.start_cleaning(spark, source, mart.raw.schema, target, marks).awaitTermination()
    streamed = incremental.read_cleaned(spark, target)
    batch = cleaning.clean_dataset_lib(mart.raw).select(*streamed.columns)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_csv_quotes_and_small_prices(spark, tmp_path):
    from cartloom.sources.files import csv_scan, typed_invoice_lines, write_csv

    header = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
    body = '1,A,"BOX 12"" RED, LARGE",3,12/1/2010 8:26,0.001,17.0,France\n2,B,"say ""hi""",1,12/1/2010 8:26,2.5,,Spain\n'
    (tmp_path / "plain.csv").write_bytes((header + body).encode())
    rows = typed_invoice_lines(csv_scan(spark, str(tmp_path / "plain.csv"))).orderBy("Invoice").collect()
    assert [(r["Description"], r["Quantity"], float(r["Price"]), r["CustomerID"]) for r in rows] == [
        ('BOX 12" RED, LARGE', 3, 0.001, 17), ('say "hi"', 1, 2.5, None)
    ]
    (tmp_path / "broken.csv").write_bytes((header + '1,A,"two\nlines",3,12/1/2010 8:26,1,17,France\n').encode())
    assert csv_scan(spark, str(tmp_path / "broken.csv"), multi_line=True).first()["Description"] == "two\nlines"
    kept = csv_scan(spark, str(tmp_path / "plain.csv")).withColumn("Description", F.lit('  a "b", c '))
    write_csv(kept, str(tmp_path / "again"))
    assert {r["Description"] for r in csv_scan(spark, str(tmp_path / "again")).collect()} == {'  a "b", c '}
