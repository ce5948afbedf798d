"""Cleaning and validation on small literal frames."""

import datetime as dt

from pyspark.sql import functions as F

from cartloom.operators import cleaning, profile, quality


def test_missing_values_keep_null_customers(lines):
    df = lines(
        [{}, {"CustomerID": None}, {"Description": None}, {"Invoice": None}, {"StockCode": None}, {"Price": None},
         {"Price": 0}, {"Price": -5}, {"Quantity": None}]
    )
    kept = cleaning.clean_missing(df).collect()
    assert sorted((r["CustomerID"] is None, float(r["Price"])) for r in kept) == [(False, -5.0), (False, 2.5), (True, 2.5)]


def test_duplicates_are_dropped_once(lines):
    df = lines([{}] * 3 + [{"StockCode": "B"}] * 3 + [{"CustomerID": None}] * 2)
    assert cleaning.drop_duplicates(df).count() == 3
    row = profile.exact_duplicates(df).first()
    assert (row["rows"], row["duplicates"]) == (8, 5)
    assert profile.duplicate_rows(df).count() == 8


def test_dates_parse_or_become_null(lines):
    df = cleaning.parse_dates(lines([{"InvoiceDate": "12/1/2010 8:26"}, {"InvoiceDate": "not a date"}, {"InvoiceDate": None}]))
    rows = df.orderBy(F.col("InvoiceDate").desc_nulls_last()).collect()
    assert rows[0]["InvoiceDate"] == dt.datetime(2010, 12, 1, 8, 26)
    assert (rows[0]["Year"], rows[0]["Month"], rows[0]["DayOfWeek"], rows[0]["Hour"]) == (2010, 12, 2, 8)
    assert rows[1]["InvoiceDate"] is None and rows[2]["Year"] is None


def test_returns_and_amounts(lines):
    df = cleaning.clean_dataset_lib(lines([{"Invoice": "C55", "Quantity": -2}, {"Invoice": "56"}, {"CustomerID": -1, "Invoice": "57"}]))
    got = {r["InvoiceClean"]: (r["IsReturn"], float(r["TotalAmount"])) for r in df.collect()}
    assert got == {"55": (True, -5.0), "56": (False, 5.0)}


def test_report_names_the_steps(lines):
    row = cleaning.cleaning_report(lines([{}, {}, {"Description": None}, {"Price": 2000, "Invoice": "C1"}])).first()
    assert (row["rows_before"], row["rows_after"]) == (4, 2)
    assert "missing_descriptions_removed" in row["steps"] and "duplicates_removed" in row["steps"]
    assert "return_quantity_inconsistency_noted" in row["steps"] and "expensive_items_flagged" in row["steps"]
    assert "missing_invoices_removed" not in row["steps"]


def test_switches(lines):
    df = lines([{}, {}, {"Description": None}])
    assert cleaning.clean_dataset_lib(df, handle_missing=False, remove_duplicates=False).count() == 3
    assert "IsReturn" not in cleaning.clean_dataset_lib(df, returns=False).columns


def test_guests_number_every_row_even_among_copies(lines):
    df = cleaning.infer_types(lines([{"CustomerID": None}] * 40 + [{"CustomerID": None, "StockCode": "Z"}, {"CustomerID": 9}]))
    out = cleaning.assign_guests(df).collect()
    guests = sorted(r["CustomerID"] for r in out if r["CustomerID"].startswith("GUEST_"))
    assert guests == [f"GUEST_{i:06d}" for i in range(41)]
    assert [r["CustomerID"] for r in out if not r["CustomerID"].startswith("GUEST_")] == ["9"]
    assert next(r["CustomerID"] for r in out if r["StockCode"] == "Z") == "GUEST_000040"
    assert cleaning.clean_until_logic(lines([{"CustomerID": None}] * 3 + [{}, {}])).count() == 4


def test_suspicious_and_outliers(lines):
    rows = [{"Price": p, "StockCode": f"s{i}"} for i, p in enumerate([1, 2, 3, 4, 1000, 0])]
    out = {r["StockCode"]: r for r in cleaning.clean_dataset_nb(lines(rows)).collect()}
    assert [k for k, r in out.items() if r["Price_Outlier"]] == ["s4"]
    assert [k for k, r in out.items() if r["Suspicious"]] == ["s5"]


def test_empty_and_single_row(lines):
    assert cleaning.clean_dataset_lib(lines([{}])).count() == 1
    empty = lines([{}]).limit(0)
    assert cleaning.clean_dataset_lib(empty).count() == 0
    verdict = quality.validate_dataset(empty, ["Invoice"]).where("rule in ('is_valid', 'dataset_not_empty')").collect()
    assert not any(r["passed"] for r in verdict)
    assert not quality.quick_check(empty, ["Invoice"])


def test_validation_rules(lines):
    df = lines([{"StockCode": str(i), "Description": None} for i in range(10)])
    rules = {r["rule"]: r["passed"] for r in quality.validate_dataset(df, ["Invoice", "order_date"]).collect()}
    assert not rules["required_columns"] and not rules["empty_columns"] and not rules["is_valid"]
    assert quality.quick_check(lines([{"StockCode": str(i)} for i in range(10)]), ["Invoice"])
    looks = {r["column_name"]: r["looks_numeric"] for r in quality.numeric_text_columns(df).collect()}
    assert looks["StockCode"] and looks["Invoice"] and not looks["Country"]
    score = quality.quality_score(quality.quality_metrics(df)).first()["quality_score"]
    assert 0 <= score <= 100


def test_absent_columns_are_passed_over(spark):
    frame = spark.createDataFrame([(1,), (2,), (3,)], "RandomColumn int")
    assert sorted(r.RandomColumn for r in cleaning.clean_dataset_lib(frame).collect()) == [1, 2, 3]
    priced = spark.createDataFrame([("536365", 0.0), (None, 2.0), ("C536366", 3.0)], "Invoice string, Price double")
    assert [(r.Invoice, r.InvoiceClean, r.IsReturn) for r in cleaning.clean_dataset_lib(priced).collect()] == [("C536366", "536366", True)]


def test_amounts_keep_all_decimals_of_the_price(lines):
    one = lines([{"Quantity": 1}]).withColumn("Price", F.lit("0.001").cast("decimal(18,4)"))
    assert float(cleaning.clean_dataset_lib(one).first()["TotalAmount"]) == 0.001
    assert float(cleaning.clean_dataset_nb(one).first()["Total_Amount"]) == 0.001
    row = cleaning.clean_dataset_nb(one).first()
    assert not row["Suspicious"]
    assert cleaning.apply_business_rules(one.withColumn("Price", F.lit(0.0005))).first()["TotalAmount"] == 0.0005


def test_report_follows_switches_and_columns(lines, spark):
    switches = ("handle_missing", "remove_duplicates", "parse", "returns")
    df = lines([{}, {}, {"Description": None}, {"Description": None}, {"Price": 2000, "Invoice": "C1"}, {"CustomerID": -4}, {"Price": 0}])
    frames = [df, df.drop("CustomerID"), df.drop("Price"), df.drop("Quantity", "Invoice"), df.select("Country"), df.limit(0)]
    for frame in frames:
        for n in range(16):
            chosen = {s: bool(n >> i & 1) for i, s in enumerate(switches)}
            row, out = cleaning.cleaning_report(frame, **chosen).first(), cleaning.clean_dataset_lib(frame, **chosen)
            assert (row["rows_before"], row["rows_after"]) == (frame.count(), out.count()), (frame.columns, chosen)
            assert (row["columns_before"], row["columns_after"]) == (len(frame.columns), len(out.columns))
            assert ("date_parsing" in row["steps"]) == ("Year" in out.columns)
            assert ("returns_detected" in row["steps"]) == ("IsReturn" in out.columns)
            assert ("total_amount_calculated" in row["steps"]) == ("TotalAmount" in out.columns)
    steps = cleaning.cleaning_report(df, handle_missing=False, remove_duplicates=False).first()["steps"].split(", ")
    assert "missing_values_handled" not in steps and "duplicates_removed" not in steps and "invalid_customer_ids_removed" in steps
    assert cleaning.cleaning_report(df.select("Country")).first()["steps"] == "duplicates_removed, business_rules_validated, data_types_optimized"


def test_guests_move_once_and_a_hot_line_is_split(lines, spark):
    df = cleaning.infer_types(lines([{"CustomerID": None}] * 30 + [{"CustomerID": None, "Country": None}]))
    plan = cleaning.guest_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
    got = {r["Country"]: r["CustomerID"] for r in cleaning.guest_lines(df).collect() if r["Country"] is None}
    assert got == {None: "GUEST_000000"}
