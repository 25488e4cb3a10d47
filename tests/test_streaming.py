from plumbline.streaming import ingest as I


def test_log_is_drained_once_and_latest_wins(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"k": 1, "seq": 1, "v": "old"}\n{"k": 1, "seq": 3, "v": "new"}\n{"k": 2, "seq": 2, "v": "x"}\n{"k": 2, "se')
    run = lambda: I.ingest(I.read_log(spark, str(log), "k long, seq long, v string"), ["k"], "seq", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (log / "b.json").write_text('{"k": 2, "seq": 9, "v": "y"}\n')
    run()
    run()
    got = I.latest(spark.read.parquet(str(tmp_path / "out")).drop("batch"), ["k"], "seq").collect()
    assert {(r["k"], r["seq"], r["v"]) for r in got} == {(1, 3, "new"), (2, 9, "y")}
