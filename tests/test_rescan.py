"""The query of a second scan: what its driver does doesn't grow with the files."""

import duckdb

from cairn.operators import store
from cairn.plans import registry


def test_the_driver_does_as_much_for_many_files_as_for_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FEW", 0)  # up to so many sources are literals of a plan
    client = spark.sparkContext._gateway._gateway_client
    send, calls = client.send_command, []
    monkeypatch.setattr(client, "send_command", lambda command, *a, **k: calls.append(command) or send(command, *a, **k))
    took = []
    for n in (60, 6000):
        sf = str(tmp_path / f"{len(took)}")
        spark.range(n, numPartitions=2).selectExpr("id as doc_id", "if(id % 50 = 1, null, concat('words of ', id)) as text").union(
            spark.sql("select 17L, 'words of 17'")  # an id twice: one file
        ).write.parquet(f"{sf}/documents.parquet")
        calls.clear()
        out = registry.QUERIES["rescan_files"](spark, sf)
        took.append(len(calls))
        got = sorted(map(tuple, out.collect()))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT DISTINCT * FROM '{sf}/documents.parquet/*.parquet'")
        assert got == sorted(con.execute(registry.SQL["rescan_files"]).fetchall()) and len(got) > n / 4
    assert took[1] < took[0] + 500, took  # 198 more files are deleted
    assert not any("globStatus" in c for c in calls)  # a listing in the driver's memory
