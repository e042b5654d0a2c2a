from datetime import datetime, timedelta, timezone

from docloom.sources import schemas, tables
from docloom.streaming import archive

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def event(i, day=0, doc="d", label="A"):
    return (i, doc, label, "human", None, T0 + timedelta(days=day), None, None)


def test_append_once(spark, tmp_path):
    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda rows: schemas.to_frame(spark, rows, "label_events").write.mode("append").parquet(incoming)
    run = lambda: archive.append_new(archive.read_stream(spark, incoming, schemas.LABEL_EVENTS), out, "label_events", "event_id", str(tmp_path / "cp")).awaitTermination(120)
    write([event(1), event(1), event(2)])
    run()
    write([event(2), event(3)])
    run()
    run()
    assert sorted(r.event_id for r in tables.read_table(spark, out, "label_events").collect()) == [1, 2, 3]


def test_windows(spark, tmp_path):
    incoming = str(tmp_path / "in")
    schemas.to_frame(spark, [event(1), event(2), event(3, 1), event(4, 1, label="B"), event(5, 9)], "label_events").coalesce(1).write.parquet(incoming)
    counts = archive.windowed_counts(archive.read_stream(spark, incoming, schemas.LABEL_EVENTS), "created_at", "class_key")
    q = counts.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start.day, r.class_key): r.n for r in spark.table("windows").collect()}
    assert got == {(1, "A"): 2, (2, "A"): 1, (2, "B"): 1}
    d = archive.distinct_stream(archive.read_stream(spark, incoming, schemas.LABEL_EVENTS), "document_id", "created_at")
    q = d.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 1
