"""Event files, metric states and the pruning of trials."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewalk.operators import metrics, trials
from edgewalk.sources import eventfiles as ev
from edgewalk.sources import sinks


def plain_crc(data: bytes) -> int:
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = state >> 1 ^ (ev.POLYNOMIAL if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksums():
    # Published test vectors.
    assert (ev.crc32c(b"123456789"), ev.crc32c(bytes(32)), ev.crc32c(b"\xff" * 32)) == (0xE3069283, 0x8A9136AA, 0x62A8AB43)
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 100, 1023, 1024, 1025, 1027, 3000):
        data = rng.randbytes(n)
        assert ev.crc32c(data) == plain_crc(data)


def test_events_come_back(spark, tmp_path):
    rows = [(f"run{s % 3}", t, s, s / 7 - 3) for s in range(300) for t in ("loss", "auc")] + [("run0", "loss", -5, 1e300), ("run1", "é", 1 << 40, None), ("run1", "", 1 << 40, 2.0)]
    df = spark.createDataFrame(rows, "run string, tag string, step long, value double").withColumn("offset", F.lit(1))
    assert ev.write_events(df, str(tmp_path / "logs")) >= 3
    read = ev.read_events(spark, str(tmp_path / "logs"))
    assert ev.event_faults(read).count() == 0
    got = sorted((r.run.rsplit("/", 1)[1], r.tag, r.step, r.value) for r in ev.event_scalars(read).collect())
    with np.errstate(over="ignore"):
        assert got == sorted((r, t, s, float(np.float32(v))) for r, t, s, v in rows if v is not None)
    assert ev.write_events(df.where("false"), str(tmp_path / "none")) == 0
    with pytest.raises(Exception, match="a run, a tag and a step"):
        ev.write_events(df.withColumn("tag", F.lit(None).cast("string")), str(tmp_path / "bad"))


def test_damaged_event_files(spark, tmp_path):
    good = [ev.frame(ev.scalar_event("a", s, s)) for s in range(4)]
    broken = bytearray(good[1])
    broken[20] ^= 1
    length = bytearray(good[2])
    length[8] ^= 1
    files = {
        "torn": good[0] + good[1][:-3], "head": good[0] + good[1][:5], "data": good[0] + bytes(broken) + good[2], "length": good[0] + bytes(length) + good[3],
        "event": ev.frame(b"\x2a\xff") + good[3], "text": ev.frame(b"\x2a\x04\x0a\x02\x0a\x00") + good[3], "empty": b"",
    }
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "events.out.tfevents.1").write_bytes(data)
    (tmp_path / "torn" / "notes.txt").write_text("x")
    read = ev.read_events(spark, str(tmp_path))
    name = F.element_at(F.split("run", "/"), -1).alias("name")
    assert sorted(tuple(r) for r in ev.event_faults(read).select(name, "offset", "state").collect()) == sorted([
        ("torn", len(good[0]), "torn"), ("head", len(good[0]), "torn"), ("data", len(good[0]), "bad_data"), ("length", len(good[0]), "bad_length"), ("event", 0, "bad_event"),
    ])
    steps = sorted((r.name, r.step) for r in ev.event_scalars(read).select(name, "step").collect())
    assert steps == sorted([("torn", 0), ("head", 0), ("data", 0), ("data", 2), ("length", 0), ("event", 3), ("text", 3)])


def test_tensors_and_images(spark, tmp_path):
    def event(step, inner):
        return ev.frame(ev._put(ev.EVENT_STEP, step, 0) + ev._put(ev.EVENT_SUMMARY, ev._put(ev.SUMMARY_VALUE, inner)))

    image = lambda b: ev._put(ev.VALUE_TAG, b"roc") + ev._put(ev.VALUE_IMAGE, ev._put(ev.IMAGE_HEIGHT, 3, 0) + ev._put(ev.IMAGE_WIDTH, 300, 0) + ev._put(ev.IMAGE_BYTES, b))
    tensor = lambda t, n, b: ev._put(ev.VALUE_TAG, b"t") + ev._put(ev.VALUE_TENSOR, ev._put(ev.TENSOR_TYPE, t, 0) + ev._put(n, b))
    data = event(1, image(b"first")) + event(7, image(b"last")) + event(2, tensor(ev.FLOAT_TYPE, ev.TENSOR_FLOATS, struct.pack("<f", 0.5))) + event(3, tensor(ev.DOUBLE_TYPE, ev.TENSOR_BYTES, struct.pack("<d", 0.1))) + event(4, tensor(7, ev.TENSOR_BYTES, b"x"))
    (tmp_path / "x.tfevents.0").write_bytes(data)
    read = ev.read_events(spark, str(tmp_path))
    assert [(r.tag, r.step, bytes(r.image), r.height, r.width) for r in ev.last_images(read).collect()] == [("roc", 7, b"last", 3, 300)]
    assert sorted((r.step, r.value) for r in ev.event_scalars(read).collect()) == [(2, 0.5), (3, 0.1)]
    assert read.where("kind = 'other'").count() == 1


def scored(spark, n=400, classes=4):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        p = [round(rng.random(), 1) + 0.01 for _ in range(classes)]
        rows.append((i, rng.choice([-1, 0, 1, 2, 2]), [x / sum(p) for x in p], p.index(max(p)), rng.choice(["train", "val"]), i % 2))
    return spark.createDataFrame(rows, "id long, target int, probabilities array<double>, prediction int, stage string, epoch int")


def test_states_of_batches_merge_in_any_order(spark, tmp_path):
    rows = scored(spark)
    plain = lambda found: sorted((r.stage, r.epoch, r.n, *(None if v is None else round(v, 9) for v in (r.loss, r.accuracy, r.f1, r.auroc))) for r in found.collect())
    want = plain(metrics.stage_metrics(rows))
    assert len(want) == 4
    path = str(tmp_path / "state")
    for batch in (3, 0, 4, 2, 1, 3):
        sinks.put_state(metrics.metric_state(rows.where(F.col("id") % 5 == batch)), path, batch)
    assert plain(metrics.state_metrics(metrics.merged(spark.read.parquet(path)))) == want
    some = rows.where("id % 5 < 2")
    assert plain(metrics.state_metrics(metrics.merged(spark.read.parquet(path).where("batch_key < 2")))) == plain(metrics.stage_metrics(some))
    assert metrics.state_metrics(metrics.merged(metrics.metric_state(rows.where("target = -1")))).count() == 0
    sinks.reset_state(spark, path)
    sinks.reset_state(spark, path)
    assert not (tmp_path / "state").exists()


def plain_pruned(reports):
    best = {}
    for t, s, v in reports:
        best[t, s] = max((x for x in (best.get((t, s)), v) if x is not None), default=None)
    out = {}
    for (t, s), v in best.items():
        earlier = sorted(x for (a, b), x in best.items() if b == s and a < t and x is not None)
        n = len(earlier)
        out[t, s] = bool(v is not None and t >= 5 and s >= 5 and n and v < 0.5 * earlier[(n - 1) // 2] + 0.5 * earlier[n // 2])
    return out


@pytest.mark.parametrize("bits", [2, 5, 15])
def test_pruning_by_running_medians(spark, bits):
    rng = random.Random(bits)
    reports = [(rng.randrange(300), s, rng.choice([None, float(rng.randrange(20)), rng.random()])) for s in (4, 5, 6) for _ in range(300)] + [(1, 9, 2.0), (10, 9, 1.0)]
    df = spark.createDataFrame(reports, "trial long, step long, value double").withColumn("tb", F.lit("x")).repartition(3)
    got = {(r.trial, r.step): r.prune for r in trials.pruned(df, bits=bits).collect()}
    assert got == plain_pruned(reports) and sum(got.values()) > 100
    assert trials.pruned(df.where("false"), bits=bits).count() == 0
