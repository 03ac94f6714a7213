"""Sources, sinks and the streaming path."""

import uuid

import pytest
from pyspark.sql import functions as F

from evweave.operators import metrics as M
from evweave.schema import EVENT_VIEW_SCHEMA
from evweave.session import scratch_path
from evweave.sources import io as IO
from evweave.sources.tables import event_view
from evweave.streaming import events as ST
from evweave.queries.common import labelled, labelled_sr

from conftest import SF001


def test_round_trip_schema(spark):
    ev = event_view(spark, SF001)
    back = IO.round_trip(ev, IO.new_store(spark, "t-rt"))
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in ev.schema]
    assert back.count() == ev.count()


def test_evaluation_json_round_trip(spark):
    path = IO.new_store(spark, "t-json")
    d = labelled_sr(spark, SF001)
    IO.write_evaluation_json(M.evaluation_json(d, 0.4), path)
    back = {(r["weighted"], r["class"]): r for r in IO.read_evaluation_json(spark, path).collect()}
    rep = {(r["weighted"], r["class"]): r
           for r in M.class_report(M.confusion(M.with_prediction(d, 0.4))).collect()}
    assert back.keys() == rep.keys()
    for k in rep:
        assert abs(back[k]["f1"] - rep[k]["f1"]) < 1e-12


def test_build_or_read_does_not_rebuild(spark):
    path = IO.new_store(spark, "t-s7")
    ev = event_view(spark, SF001).withColumn("dataset", F.col("sample"))
    first = IO.build_or_read(spark, path, lambda: IO.merged_signal_dataset(ev, "sig2000")).count()
    again = IO.build_or_read(spark, path, lambda: ev.limit(0).withColumn("role", F.lit("x"))).count()
    assert first == again > 0


def test_stream_equals_batch(spark):
    src = scratch_path(spark, f"t-stream-src-{uuid.uuid4().hex[:8]}")
    sink = scratch_path(spark, f"t-stream-out-{uuid.uuid4().hex[:8]}")
    event_view(spark, SF001).repartition(3).write.parquet(src)
    stream = ST.label_stream(ST.read_event_stream(spark, src, EVENT_VIEW_SCHEMA, 1), "sig", 0.5)
    q = ST.write_stream(stream, sink, f"t-{uuid.uuid4().hex[:6]}")
    q.awaitTermination(120)
    got = spark.read.parquet(sink)
    want = labelled(spark, SF001)
    assert got.count() == want.count()
    assert got.agg(F.sum("label")).first()[0] == want.agg(F.sum("label")).first()[0]


def test_stream_running_yields(spark):
    src = scratch_path(spark, f"t-stream-y-{uuid.uuid4().hex[:8]}")
    event_view(spark, SF001).repartition(2).write.parquet(src)
    name = f"y_{uuid.uuid4().hex[:6]}"
    q = ST.write_yields_stream(ST.running_yields(ST.read_event_stream(spark, src, EVENT_VIEW_SCHEMA)), name, name)
    q.awaitTermination(120)
    got = spark.table(name).agg(F.sum("entries")).first()[0]
    assert got == event_view(spark, SF001).count()


def test_checkpoint_folder_comes_from_the_session(spark):
    from evweave.session import ensure_checkpoint_dir
    configured = spark.conf.get("spark.checkpoint.dir")
    got = ensure_checkpoint_dir(spark)
    assert configured.replace("file:", "").rstrip("/") in got.replace("file:", "")
    assert scratch_path(spark, "x").startswith(got.rstrip("/"))


def test_half_written_stores_are_not_read(spark, tmp_path):
    from evweave.operators import sweep as W
    from evweave.sources import io as IO
    ev = spark.range(6).selectExpr("id", "cast(id % 2 as string) as role", "'d' as dataset")
    path = str(tmp_path / "store")
    (tmp_path / "store" / "_temporary").mkdir(parents=True)
    assert IO.build_or_read(spark, path, lambda: ev).count() == 6
    (tmp_path / "store" / "_SUCCESS").unlink()
    assert IO.build_or_read(spark, path, lambda: ev.limit(3)).count() == 3
    calls = []

    def run(p):
        calls.append(p["comb_id"])
        return spark.range(2).withColumnRenamed("id", "th")

    sw = str(tmp_path / "sweep")
    grid = [{"comb_id": i} for i in range(3)]
    assert W.run_sweep(spark, grid[:2], run, sw).count() == 4
    (tmp_path / "sweep" / "part-comb_id=0" / "_SUCCESS").unlink()
    assert W.run_sweep(spark, grid, run, sw).count() == 6
    assert calls == [0, 1, 0, 2]


def test_scratch_tables_go_and_kept_ones_stay(spark):
    import os

    from evweave.session import materialize, release, scratch

    def there(df_files):
        return all(os.path.exists(f.replace("file://", "").replace("file:", "")) for f in df_files)

    before = materialize(spark.range(5))
    with scratch(spark) as s:
        a = materialize(spark.range(10))
        with scratch(spark) as inner:
            b = materialize(spark.range(20))
            c = inner.keep(materialize(spark.range(30)))
        assert not there(b.inputFiles()) and there(c.inputFiles())
        kept = s.keep(materialize(a.unionByName(c)))
    assert kept.count() == 40 and there(kept.inputFiles()) and there(before.inputFiles())
    assert not there(a.inputFiles()) and not there(c.inputFiles())
    with pytest.raises(ZeroDivisionError):
        with scratch(spark):
            d = materialize(spark.range(3))
            1 / 0
    assert not there(d.inputFiles())
    release(before, kept)
    assert not there(before.inputFiles())
