"""Sources, stores, ledger (S1, S2, S4, S11, S12/S13, F4, O3, M4) and streaming scoring."""
import os
import tempfile
import time

import numpy as np
from pyspark.sql import functions as F

from reviewlens.operators.dbn import dbn_train_or_load
from reviewlens.operators.hbos import HBOSModel
from reviewlens.sources import scan_books, scan_reviews, source_catalog
from reviewlens.sources.store import RunLedger, latest_checkpoint, table_fingerprint, tuning_status
from reviewlens.streaming.scoring import file_stream, score_stream, start_scoring


def test_csv_scan_with_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="rl-csv-")
    with open(os.path.join(d, "Books_rating.csv"), "w") as fh:
        fh.write('Id,Title,Price,User_id,profileName,review/helpfulness,review/score,review/time,review/summary,review/text\n')
        fh.write('1,Book A,,u1,p,7/10,5.0,940636800,Nice,"multi\nline text"\n')
        fh.write('2,Book B,,NA,p,0/0,NaN,940636800,,short\n')
    with open(os.path.join(d, "books_data.csv"), "w") as fh:
        fh.write("Title,description,authors,image,previewLink,publisher,publishedDate,infoLink,categories,ratingsCount\n")
        fh.write("Book A,,,,,,,,Fiction,100\n")
    r = scan_reviews(spark, os.path.join(d, "Books_rating.csv")).orderBy("title").collect()
    assert len(r) == 2 and r[0]["review_text"] == "multi\nline text"
    assert r[1]["user_id"] is None and r[1]["score"] is None and r[1]["summary"] is None
    b = scan_books(spark, os.path.join(d, "books_data.csv")).collect()
    assert b[0]["ratings_count"] == 100.0
    cat = source_catalog(spark, d, required=["Books_rating", "books_data"])
    assert {x["stem"] for x in cat.collect()} == {"Books_rating", "books_data"}


def test_fingerprint_order_free(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 3)
    assert table_fingerprint(df) == table_fingerprint(df.orderBy(F.desc("id")).repartition(3))
    assert table_fingerprint(df) != table_fingerprint(df.where("id > 0"))


def test_ledger_resume_pending_latest(spark):
    base = tempfile.mkdtemp(prefix="rl-ledger-")
    led = RunLedger(spark, base)
    res = spark.range(5).withColumnRenamed("id", "row_id")
    led.complete("r1", "tune", "hbos", res)
    led.append("r1", "tune", "lof", "started")
    time.sleep(0.01)
    led.append("r1", "tune", "lof", "failed", {"error": "x"})
    assert led.is_done("r1", "tune", "hbos") and not led.is_done("r1", "tune", "lof")
    assert led.pending("r1", "tune", ["hbos", "lof", "dbscan"]) in (["lof", "dbscan"], ["dbscan", "lof"])
    assert led.result("r1", "tune", "hbos").count() == 5
    last = latest_checkpoint(led.events()).first()
    assert last["model"] == "lof" and last["status"] == "failed"
    st = tuning_status(led.state(), ["hbos", "lof", "dbscan"]).first()
    assert st["tuned"] == ["hbos"] and sorted(st["untuned"]) == ["dbscan", "lof"]
    assert abs(st["progress_pct"] - 100.0 / 3) < 1e-9


def test_dbn_store_roundtrip(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.random(4).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>")
    base = tempfile.mkdtemp(prefix="rl-dbn-")
    kw = dict(hidden_layers=[3], layer_configs=[{"learning_rate": 0.05, "n_iter": 2}])
    a = dbn_train_or_load(spark, base, df, **kw)
    b = dbn_train_or_load(spark, base, df, **kw)      # loaded, not retrained
    assert np.allclose(a.layers[0].W, b.layers[0].W)
    h = b.transform(df).select(F.size("dbn_features")).distinct().collect()
    assert [r[0] for r in h] == [3]


def test_stream_scoring_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="rl-stream-in-")
    df = spark.createDataFrame([(i, float(i % 7), float((i * 13) % 11)) for i in range(300)],
                               "row_id long, a double, b double")
    df.repartition(3).write.mode("overwrite").parquet(d)
    m = HBOSModel.fit(df, cols=["a", "b"])
    stream = file_stream(spark, d, df.schema)
    q, out = start_scoring(score_stream(m, stream), "hbos_test_" + os.path.basename(d).replace("-", "_"))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    exp = m.transform(df)
    assert got.count() == 300
    assert got.where("is_anomaly").count() == exp.where("is_anomaly").count()
