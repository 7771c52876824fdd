"""CSV in splits: equal to the whole-file parser, in file order, broken records reported."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from funnelkit.operators import clean, quality
from funnelkit.sources import files
from funnelkit.sources.records import csv_records
from funnelkit.sources.schemas import RAW_ORDERS, RAW_PRODUCTS, RAW_USERS
from tests.conftest import rows


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _products(path, n, seed, end="\n"):
    rng = random.Random(seed)
    bits = ["plain", "two\nlines", 'a "quoted" word', ",", "\n\n", " ", "é", '"', "x" * 300, "a\nb\nc\nd", "1"]
    body = [(str(i), "".join(rng.choice(bits) for _ in range(rng.randrange(1, 5))), f"{i}.5") for i in range(n)]
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["product_id", "product_name", "base_price"])
        out.writerows(body)
    return [(int(a), b, float(c)) for a, b, c in body]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_equal_the_whole_file(small_splits, tmp_path, end):
    spark, path = small_splits, str(tmp_path / "p.csv")
    want = _products(path, 700, seed=1, end=end)
    df = files.read_csv(spark, path, RAW_PRODUCTS, multiline="split")
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    assert rows(df.orderBy("_arrival"), *RAW_PRODUCTS.fieldNames()) == want   # order kept
    whole = files.read_csv(spark, path, RAW_PRODUCTS)
    assert sorted(rows(whole)) == sorted(want)


def test_one_record_over_many_splits(small_splits, tmp_path):
    path = str(tmp_path / "long.csv")
    long = "\n".join(f"line {i}" for i in range(4000))
    with open(path, "w", newline="") as f:
        f.write(f'product_id,product_name,base_price\n1,"{long}",2.0\n\n2,b,3.0\n')
    df = files.read_csv(small_splits, path, RAW_PRODUCTS, multiline="split").orderBy("_arrival")
    assert rows(df, *RAW_PRODUCTS.fieldNames()) == [(1, long, 2.0), (2, "b", 3.0)]


def test_folder_of_files(small_splits, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    want = [r for i in range(4) for r in _products(str(folder / f"part-{i}.csv"), 90, seed=i)]
    df = files.read_csv(small_splits, str(folder), RAW_PRODUCTS, multiline="split")
    assert rows(df.orderBy("_arrival"), *RAW_PRODUCTS.fieldNames()) == want


def test_unclosed_quote_stays_local(spark, tmp_path):
    path = str(tmp_path / "open.csv")
    with open(path, "w", newline="") as f:
        f.write('product_id,product_name,base_price\n1,"a\nb",1.0\n2,"open,2.0\n3,c,3.0\n4,d,4.0\n')
    got = csv_records(spark, path).where("NOT first").orderBy("_arrival").select("record").collect()
    assert [r[0] for r in got] == ['1,"a\nb",1.0', '2,"open,2.0', "3,c,3.0", "4,d,4.0"]


@pytest.mark.parametrize("multiline", [True, False, "split"])
def test_broken_records_are_reported_never_lost(spark, tmp_path, multiline):
    users, products, orders = (str(tmp_path / f"{t}.csv") for t in files.TABLES)
    with open(users, "w") as f:
        f.write("user_id,signup_date,region,channel\n1,2023-01-01,EU,web\n2,2023-01-01,EU\n")
    with open(products, "w") as f:
        f.write("product_id,product_name,base_price\n10,a,1.0\n11,b,2.0,extra\n12\n")
    with open(orders, "w") as f:
        f.write("order_id,user_id,product_id,quantity,order_stage,order_date\n"
                "1,1,10,2,Visited,2024-01-01 00:00:00\n2,1,10,x,Visited,2024-01-01 00:00:00,more\n")
    raw = {t: files.read_csv(spark, p, s, multiline=multiline, keep_bad=True) for t, p, s in
           zip(files.TABLES, (users, products, orders), (RAW_USERS, RAW_PRODUCTS, RAW_ORDERS), strict=True)}
    assert {t: df.count() for t, df in raw.items()} == {"users": 2, "products": 3, "orders": 2}
    bad = {r.product_id: r._bad for r in raw["products"].collect()}
    assert bad[10] is None and bad[11]["_record"].strip() == "11,b,2.0,extra" and "_record" in bad[12]
    report = {(r.check_name, r.column_name): r.n_issues for r in quality.validation_report(
        raw["users"], raw["products"], clean.fix_quantities(raw["orders"])).collect()}
    assert [report["broken_record", f"{t}.all"] for t in files.TABLES] == [1, 2, 1]
    assert report["not_numeric", "orders.quantity"] == 1
    assert report["total_issues", "all"] == 4 + 1


def test_empty_file_and_only_header(spark, tmp_path):
    path = str(tmp_path / "head.csv")
    with open(path, "w") as f:
        f.write("product_id,product_name,base_price\n")
    df = files.read_csv(spark, path, RAW_PRODUCTS, multiline="split", keep_bad=True)
    assert df.count() == 0 and F.col("_arrival") is not None and "_arrival" in df.columns
