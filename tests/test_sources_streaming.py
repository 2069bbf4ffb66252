import json
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from missiva.sources import json_parts
from missiva.sources import readers as R
from missiva.sources import writers as W
from missiva.streaming import incremental as I


def test_corpus_csv(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text('id,date,sender,recipient,place,location,text\n1,1914-08-01, Peter ,Trine,,"1,2,3","to ""linjer""\n her"\nx,1914-01-01,a,b,c,d,e\n2,bad,,b,c,d,e\n', encoding="utf-8")
    got = R.read_corpus_csv(spark, str(p)).orderBy("id").collect()
    assert [r["id"] for r in got] == [1, 2]
    assert got[0]["sender"] == "Peter" and got[0]["place"] == "" and got[0]["text"] == 'to "linjer"\n her' and got[0]["date"] == date(1914, 8, 1)
    assert got[1]["date"] is None


def test_json_and_geojson(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text(json.dumps([{"Text": "x", "LetterDate": "d"}]))
    assert set(R.read_corpus_json(spark, str(a)).columns) == {"text", "letterdate"}
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"features": [{"properties": {"place_id": "1", "place": "Arys"}, "geometry": {"type": "Point", "coordinates": [21.9, 53.8]}}]}))
    r = R.read_geojson(spark, str(g)).first()
    assert (r["lat"], r["lng"], r["aliases"]) == (53.8, 21.9, [])


def test_keyed_json_and_vectors(spark, tmp_path):
    k = tmp_path / "k.json"
    k.write_text(json.dumps({"7": {"mean": 0.5}, "8": {"mean": -1.0}}))
    got = {r["id"]: r["mean"] for r in R.read_keyed_json(spark, str(k), "struct<mean:double>").collect()}
    assert got == {"7": 0.5, "8": -1.0}
    v = tmp_path / "v.csv"
    v.write_text("0,1,2\n3,0,4\n")
    assert np.allclose(R.read_vector_csv(spark, str(v), 3).first()["vector"], [0.6, 0, 0.8])
    with pytest.raises(ValueError):
        R.read_vector_csv(spark, str(v), 4)


def test_packed_vectors(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    p = tmp_path / "v.bin"
    p.write_bytes(x.tobytes())
    index = spark.createDataFrame([("a", 2), ("b", 0)], "id string, position long")
    got = {r["id"]: list(r["vector"]) for r in R.read_packed_vectors(spark, str(p), index, 3).collect()}
    assert got == {"a": [6, 7, 8], "b": [0, 1, 2]}
    W.write_vectors(index, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_events_and_optional(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text('Date,EndDate,Front,Battle,Location,Coordinates,wikipedia\n1915-01-02,,W,B,x,"1.5, 2.5",\n1914-08-05,1914-08-16,W,A,y,"3, bad",u\n')
    got = R.read_events_csv(spark, str(p)).orderBy("event_id").collect()
    assert [(r["event_id"], r["battle"], r["lat"], r["lng"]) for r in got] == [(1, "A", 3.0, None), (2, "B", 1.5, 2.5)]
    assert got[1]["end"] == date(1915, 1, 2)
    empty = R.read_optional(spark, str(tmp_path / "none"), "id int, mean double")
    assert empty.count() == 0 and empty.columns == ["id", "mean"]


def test_write_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 1914), (2, 1915)], "id int, year int")
    W.write_tables({"letters": df}, str(tmp_path), partition={"letters": "year"})
    assert R.read_optional(spark, str(tmp_path / "letters"), "id int, year int").filter("year = 1914").count() == 1


def test_stream_counts_and_upserts(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    sch = "id int, ts timestamp, t string"
    spark.createDataFrame([(1, datetime(2020, 1, 1), "a"), (2, datetime(2020, 2, 1), "b")], sch).write.parquet(src)
    stream = spark.readStream.schema(sch).parquet(src)
    q = I.monthly_density_stream(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("m").start()
    q.processAllAvailable()
    q.stop()
    assert {r["month"]: r["count"] for r in spark.table("m").collect()} == {"2020-01": 1, "2020-02": 1}
    for again in range(2):
        w = (
            spark.readStream.schema(sch).parquet(src).writeStream.foreachBatch(I.upsert_changed(state, "id", ["t"]))
            .option("checkpointLocation", str(tmp_path / f"c{again}")).start()
        )
        w.processAllAvailable()
        w.stop()
        assert spark.read.parquet(state).count() == 2
    assert spark.read.parquet(state).filter(F.col("fingerprint").isNull()).count() == 0


def test_a_value_that_returns_counts_as_changed(spark, tmp_path):
    state = str(tmp_path / "state")
    run = I.upsert_changed(state, "id", ["t"])
    for epoch, text in enumerate(["A", "A", "B", "A"]):
        run(spark.createDataFrame([(1, text)], "id long, t string"), epoch)
    run(spark.createDataFrame([(1, "A")], "id long, t string"), 3)
    assert spark.read.parquet(state).count() == 3


AWKWARD = ['plain', 'a } brace { and ] [', 'quote " and \\ and "}"', '\\', 'line\nend', 'æø \U0001f600', '', '},{"x": {']


@pytest.mark.parametrize("indent,size", [(None, 64), (2, 200), (None, 1 << 27), (1, 7)])
def test_large_json_is_read_in_ranges(spark, tmp_path, indent, size):
    rows = [{"Id": i, "Text": AWKWARD[i % 8] * (1 + i % 3), "Inner": {"k": [i, {"z": AWKWARD[i % 7]}]}} for i in range(150 if size > 7 else 12)]
    keyed = {f"k{{{r['Id']}": {"id": r["Id"], "text": r["Text"]} for r in rows}
    for name, data in (("a.json", rows), ("b.json", rows[:1]), ("k.json", keyed), ("n.json", {"a": 1, "b": 2, "c}": 3})):
        (tmp_path / name).write_text(json.dumps(data, indent=indent) + ("\n" if indent else ""), encoding="utf-8")
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "none.json").write_text("{}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        schema = "Id long, Text string, Inner struct<k: array<string>>"
        got = R.read_corpus_json(spark, str(tmp_path / "a.json"), schema)
        assert got.columns == ["id", "text", "inner"]
        assert sorted((r["id"], r["text"]) for r in got.collect()) == [(r["Id"], r["Text"]) for r in rows]
        assert all(json.loads(r["inner"]["k"][1])["z"] == AWKWARD[r["id"] % 7] for r in got.collect())
        if size < 1000:
            assert json_parts.json_entries(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() > 1
        both = R.read_corpus_json(spark, str(tmp_path / "[ab].json"), schema)
        assert both.count() == len(rows) + 1
        found = R.read_keyed_json(spark, str(tmp_path / "k.json"), "struct<id:long,text:string>", "key")
        assert {r["key"]: {"id": r["id"], "text": r["text"]} for r in found.collect()} == keyed
        assert {r["id"]: r["value"] for r in R.read_keyed_json(spark, str(tmp_path / "n.json"), "long").collect()} == {"a": 1, "b": 2, "c}": 3}
        assert R.read_corpus_json(spark, str(tmp_path / "empty.json"), schema).collect() == []
        assert R.read_keyed_json(spark, str(tmp_path / "none.json"), "long").collect() == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
