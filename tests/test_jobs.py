"""File sources, the cleaning job, the streaming adapter and skewed keys."""

import os

from pyspark.sql import functions as F

from funnelkit.operators import clean, dropoff, quality
from funnelkit.plans.cleaning import run_cleaning
from funnelkit.sources import files
from funnelkit.sources import fixtures as fx
from funnelkit.sources.schemas import RAW_ORDERS
from funnelkit.streaming import clean_batches
from tests.conftest import rows

RAW_ORDER_ROWS = [
    "order_id,user_id,product_id,quantity,order_stage,order_date",
    "3,1,10,-2,Purchased,2024-01-02 10:00:00",
    "1,1,10,4,Visited,2024-01-01 10:00:00",
    "3,2,11,9,Visited,2024-01-05 10:00:00",
    "2,2,11,0,Checkout Initiated,2024-01-03 10:00:00",
    "1,9,12,7,Purchased,not a date",
    "4,2,12,1,Checkout Initiated,2024-01-04 10:00:00",
]


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def _raw_files(tmp_path):
    d = tmp_path / "raw"
    _write(str(d / "users.csv"), ["user_id,signup_date,region,channel",
                                  "1,2023-05-01,EU,web", "2,oops,US,ads"])
    _write(str(d / "products.csv"), ["product_id,product_name,base_price",
                                     "10,a,1.0", "11,b,2.0", "12,c,3.0", "13,d,4.0",
                                     "14,e,900.0"])
    _write(str(d / "orders.csv"), RAW_ORDER_ROWS)
    return {t: str(d / f"{t}.csv") for t in ("users", "products", "orders")}


def test_arrival_order_gives_keep_first_in_file_order(spark, tmp_path):
    paths = _raw_files(tmp_path)
    df = files.with_arrival_order(files.read_csv(spark, paths["orders"], RAW_ORDERS), "csv")
    kept = clean.deduplicate(df, "order_id", ["_arrival"])
    assert sorted(rows(kept, "order_id", "user_id")) == [(1, 1), (2, 2), (3, 1), (4, 2)]
    pq = str(tmp_path / "orders_pq")
    files.read_csv(spark, paths["orders"], RAW_ORDERS).coalesce(1).write.parquet(pq)
    dfp = files.with_arrival_order(spark.read.parquet(pq), "parquet")
    keptp = clean.deduplicate(dfp, "order_id", ["_arrival"])
    assert sorted(rows(keptp, "order_id", "user_id")) == [(1, 1), (2, 2), (3, 1), (4, 2)]


def test_cleaning_job_end_to_end(spark, tmp_path):
    paths = _raw_files(tmp_path)
    out = run_cleaning(spark, paths, str(tmp_path / "clean"))
    t = files.read_tables(spark, out, fmt="parquet", raw=False)
    orders = sorted(rows(t["orders"], "order_id", "quantity", "order_stage"))
    # first rows kept, -2 -> 2, the zero row dropped
    assert orders == [(1, 4, "Visited"), (3, 2, "Purchased"), (4, 1, "Checkout Initiated")]
    prices = dict(rows(t["products"], "product_id", "base_price"))
    assert prices[14] == 2.5 and prices[10] == 1.0
    signup = dict(rows(t["users"], "user_id", "signup_date"))
    assert str(signup[1]) == "2023-05-01" and signup[2] is None


def test_streaming_adapter_cleans_each_batch(spark, tmp_path):
    src = tmp_path / "landing"
    _write(str(src / "part-0.csv"), RAW_ORDER_ROWS)
    stream = (spark.readStream.schema(RAW_ORDERS).option("header", True)
              .csv(str(src)))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = clean_batches(stream, out, ckpt)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out)
    assert got.count() == 5  # the zero-quantity row dropped
    assert got.where(F.col("quantity") < 0).count() == 0
    assert got.where(F.col("order_date").isNull()).count() == 1


def test_hot_key_holding_a_third_of_rows(spark):
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(42)).otherwise(F.col("id")).alias("order_id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("user_id"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 2 == 0, "Checkout Initiated").otherwise("Purchased")
        .alias("order_stage")).repartition(6)
    kept = clean.deduplicate(df, "order_id", ["pos"])
    assert kept.count() == n - n // 3 + 1
    assert kept.where("order_id = 42").collect()[0].pos == 0
    audit = clean.dedup_audit(df, "order_id", ["pos"]).collect()[0]
    assert audit.duplicates_found == n // 3 - 1
    assert audit.sample_duplicate_ids == "[42, 42, 42, 42, 42]"
    users = spark.range(50).select(F.col("id").alias("user_id"),
                                   F.lit("EU").alias("region"), F.lit("web").alias("channel"))
    d = dropoff.checkout_dropoff(df, users).collect()[0]
    data = rows(df, "user_id", "order_stage")
    checkout = {u for u, s in data if s == "Checkout Initiated"}
    bought = {u for u, s in data if s == "Purchased"}
    assert (d.checkout_initiated, d.purchased) == (len(checkout), len(checkout & bought))
    assert quality.orphans(df, users.where("user_id <> 7"), "user_id").count() == \
        df.where("user_id = 7").count()


def test_skewed_product_join_is_split_by_aqe(spark):
    """With broadcast off, a product holding a third of the purchases is split."""
    from funnelkit.operators import metrics
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 30000
        orders = spark.range(n).select(
            F.col("id").alias("order_id"), (F.col("id") % 100).alias("user_id"),
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 500)
            .alias("product_id"),
            F.lit(1).cast("long").alias("quantity"), F.lit("Purchased").alias("order_stage"),
            F.lit("2024-01-03 00:00:00").cast("timestamp_ntz").alias("order_date"))
        products = spark.range(500).select(F.col("id").alias("product_id"),
                                           F.lit(2.0).alias("base_price"))
        users = spark.range(100).select(F.col("id").alias("user_id"),
                                        F.lit("EU").alias("region"),
                                        F.lit("web").alias("channel"))
        df = metrics.kpi_totals(orders, products, users)
        r = df.collect()[0]
        assert (r.total_revenue, r.total_orders) == (2.0 * n, n)
        final = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_approximate_outlier_path(spark):
    rng = __import__("numpy").random.default_rng(3)
    vals = [float(v) for v in rng.gamma(2.0, 30.0, 2000).round(2)] + [9000.0, 9500.0]
    df = spark.createDataFrame([(i, "x", v) for i, v in enumerate(vals)],
                               "product_id long, product_name string, base_price double")
    exact = clean.outlier_params(df).collect()[0]
    approx = clean.outlier_params(df, exact=False).collect()[0]
    assert abs(approx.upper_fence - exact.upper_fence) / exact.upper_fence < 0.05
    assert approx.n_outliers >= 2


def test_cleaning_job_csv_output_reads_back(spark, tmp_path):
    paths = _raw_files(tmp_path)
    pq = run_cleaning(spark, paths, str(tmp_path / "clean_pq"))
    csv = run_cleaning(spark, paths, str(tmp_path / "clean_csv"), out_fmt="csv")
    a = files.read_tables(spark, pq, fmt="parquet", raw=False)
    b = files.read_tables(spark, csv, fmt="csv", raw=False)
    for name in ("users", "products", "orders"):
        assert a[name].schema == b[name].schema
        assert sorted(rows(a[name]), key=str) == sorted(rows(b[name]), key=str)


def test_arrival_order_across_files(spark, tmp_path):
    d = tmp_path / "multi"
    first = spark.createDataFrame([(1, 10), (2, 20)], "order_id long, user_id long")
    second = spark.createDataFrame([(1, 99), (3, 30)], "order_id long, user_id long")
    first.coalesce(1).write.parquet(str(d / "part=a"))
    second.coalesce(1).write.parquet(str(d / "part=b"))
    df = files.with_arrival_order(spark.read.parquet(str(d)), "parquet")
    kept = clean.deduplicate(df, "order_id", ["_arrival"])
    assert sorted(rows(kept, "order_id", "user_id")) == [(1, 10), (2, 20), (3, 30)]


def test_arrival_order_joins_no_rows_by_file(spark, tmp_path):
    """A file's rows stay where they are read: its start comes to them, at any size."""
    path, limit = str(tmp_path / "rows"), "spark.sql.autoBroadcastJoinThreshold"
    spark.range(90).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(path)
    old = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "-1")   # as beyond the limit
        df = files.with_arrival_order(spark.read.parquet(path))
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(rows(df)) == [(i, i) for i in range(90)]
    finally:
        spark.conf.set(limit, old)


def test_arrival_order_sorts_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from funnelkit.plans import registry
    monkeypatch.setattr(registry, "FILE_LINES", 20, raising=False)
    keys, sf = range(1, 201), str(tmp_path)
    spark.createDataFrame([(k, 1, "O", 1.0, None, "5-LOW") for k in keys], fx.TABLE_SCHEMAS["orders"]
                          ).write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame([(k, k % 9, 1, n, 5.0, 2.5, 0.0, 0.0, "N", "O", None) for k in keys for n in (1, 2)],
                          fx.TABLE_SCHEMAS["lineitem"]).write.parquet(f"{sf}/lineitem.parquet")
    df = registry.arrival_order(spark, sf)
    stored = spark.read.parquet(*df.inputFiles())
    sizes = [r["count"] for r in stored.groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 60   # fixed files held 80 or more
    assert sorted(rows(df, "_arrival", "order_id", "ord1")) == [
        (2 * (k - 1) + n - 1, k, n) for k in keys for n in (1, 2)]


def _reports(spark, out):
    return {k: sorted(rows(spark.read.parquet(v)), key=str) for k, v in out.items()
            if k not in files.TABLES}


def test_cleaning_job_reports_equal_the_operators(spark, tmp_path):
    """Observed counts and the stored first copies give what the audits give on the raw rows."""
    from funnelkit.operators import clean as c
    lines = RAW_ORDER_ROWS + [f"{i % 7},{i % 4},{10 + i % 9},{i % 5 - 2},{['Visited', 'Lost', ''][i % 3]},"
                              f"2024-02-{i % 28 + 1:02d} 08:00:00" for i in range(90)]
    for name, body in {"some": lines, "none": RAW_ORDER_ROWS[:1]}.items():
        paths = _raw_files(tmp_path / name)
        _write(paths["orders"], body)
        out = run_cleaning(spark, paths, str(tmp_path / name / "clean"))
        raw = files.read_tables(spark, paths, keep_bad=True)
        orders = files.with_arrival_order(raw["orders"], "csv")
        kept = c.deduplicate(orders, "order_id", ["_arrival"])
        stored = files.read_tables(spark, out, fmt="parquet", raw=False)
        want = {"validation": quality.validation_report(raw["users"], raw["products"], c.fix_quantities(kept)),
                "dedup_audit": c.dedup_audit(orders, "order_id", ["_arrival"]),
                "quantity_audit": c.quantity_audit(kept, "quantity", "order_id", ["_arrival"]),
                "price_corrections": c.price_correction_log(raw["products"].drop("_bad")),
                "orders_profile": quality.orders_profile(stored["orders"]),
                "stage_mix": quality.stage_mix(stored["orders"])}
        got = _reports(spark, out)
        assert got == {k: sorted(rows(df), key=str) for k, df in want.items()}
        for k, df in want.items():
            assert spark.read.parquet(out[k]).columns == df.columns


def test_cleaning_job_reads_raw_orders_twice_and_leaves_no_scratch(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from funnelkit.session import ensure_checkpoint_dir
    paths, plans = _raw_files(tmp_path), []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    count, first, write = DataFrame.count, DataFrame.first, files.write_table
    monkeypatch.setattr(DataFrame, "count", lambda self: (seen(self), count(self))[1])
    monkeypatch.setattr(DataFrame, "first", lambda self: (seen(self), first(self))[1])
    monkeypatch.setattr(files, "write_table", lambda df, *a, **k: (seen(df), write(df, *a, **k))[1])
    before = set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))
    run_cleaning(spark, paths, str(tmp_path / "clean"))
    after = set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))
    assert not any("first-copies" in name for name in after - before)
    # the count; the other read is the one that stores the first copies
    csv_reads = [p for p in plans if "quantity" in p and "csv" in p.lower() and "order_stage" in p]
    assert len(csv_reads) <= 1
