from skimlight.engine import SearchEngine
from skimlight.sources import changelog
from skimlight.streaming import ingest as stream

SCHEMA = "seq long, index_code string, docid string, deleted boolean, ts int, fields map<string,string>"


def log(spark, path, rows):
    changelog.append(spark.createDataFrame(rows, SCHEMA), path)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, path, [(i, f"code{i % 3}", f"d{i % 5}", i % 7 == 6, i, {"text": f"word{i} common"} if i % 7 != 6 else None) for i in range(30)])
    engine = SearchEngine(spark, str(tmp_path / "live"))
    checkpoint = str(tmp_path / "checkpoint")
    stream.ingest(stream.open_log(spark, path), engine, checkpoint, "code1", once=True).awaitTermination()
    log(spark, path, [(100 + i, "code1", f"d{i}", False, i, {"text": f"later{i}"}) for i in range(3)])
    stream.ingest(stream.open_log(spark, path), engine, checkpoint, "code1", once=True).awaitTermination()
    rebuilt = SearchEngine(spark, str(tmp_path / "rebuilt"))
    rebuilt.recover(changelog.read(spark, path, "code1"))
    for name in ("documents", "postings", "dynamic"):
        assert rows_of(getattr(engine, name)()) == rows_of(getattr(rebuilt, name)())
    assert engine.count("later1") == 1
    before = engine.store.manifest.deltas.copy()
    engine.apply(changelog.read(spark, path), batch=0)  # replayed
    assert engine.store.manifest.deltas == before


def test_deal(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, path, [(i, f"code{i % 3}", f"d{i}", False, i, {"text": "x"}) for i in range(300)])
    stream.deal(stream.open_log(spark, path), str(tmp_path / "dealt"), str(tmp_path / "c"), once=True).awaitTermination()
    info = changelog.log_info(changelog.read(spark, str(tmp_path / "dealt"))).collect()
    assert {(r.index_code, r.records) for r in info} == {(f"code{i}", 100) for i in range(3)}
    changelog.demultiplex(changelog.read(spark, path), str(tmp_path / "batch"))
    assert changelog.read(spark, str(tmp_path / "batch"), "code2").count() == 100


def test_popularity_stream(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame([("1", "text", "a b a é"), ("2", "text", "b")], "docid string, field string, text string").write.parquet(path)
    texts = spark.readStream.schema("docid string, field string, text string").parquet(path)
    query = stream.popularity_stream(texts).writeStream.outputMode("complete").format("memory").queryName("popular").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.term, r.cnt) for r in spark.table("popular").collect()} >= {("a", 2), ("b", 2)}
