"""Searches over settings: verdicts in any order of reports, trials that are stopped while their tasks run, and training in trials."""

import math
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import Row

from edgewalk.config import Config
from edgewalk.operators import search, trials
from edgewalk.plans.prepare import from_edges
from edgewalk.sources import weights as store


def one_after_the_other(curves, startup, warmup):
    """States and kept reports if each trial ends before the next one starts."""
    kept, states = {}, {}
    for number, curve in sorted(curves.items()):
        kept[number], states[number] = {}, "COMPLETE"
        for step, value in enumerate(curve):
            kept[number][step] = value
            others = [v for n, r in kept.items() if n < number and (v := r.get(step)) is not None and not math.isnan(v)]
            if number >= startup and step >= warmup and others and value is not None and value < statistics.median(others):
                states[number] = "PRUNED"
                break
    return states, kept


def test_verdicts_do_not_depend_on_the_order_of_reports():
    rng = np.random.default_rng(4)
    for _ in range(60):
        curves = {int(n): [None if rng.random() < 0.05 else float(v) for v in rng.integers(0, 6, rng.integers(0, 7))] for n in rng.choice(20, 8, replace=False)}
        stopped = []
        board = search.Board(curves, 3, 1, stopped.append)
        going = {n: list(enumerate(c)) for n, c in curves.items()}
        while going:
            n = int(rng.choice(sorted(going)))
            try:
                board.report(n, *going[n].pop(0)) if going[n] else board.end(n, "COMPLETE")
            except search.Stopped:
                board.end(n, "FAIL", "a cancelled job")
                going.pop(n)
                continue
            if board.trials[n].state != "RUNNING":
                going.pop(n)
        states, kept = one_after_the_other(curves, 3, 1)
        assert {n: t.state for n, t in board.trials.items()} == states and {n: t.reports for n, t in board.trials.items()} == kept
        assert sorted(stopped) == sorted(n for n, s in states.items() if s == "PRUNED")


def test_verdicts_equal_those_over_a_table_of_reports(spark):
    rng = np.random.default_rng(8)
    curves = {n: [float(v) for v in rng.random(6)] for n in range(12)}
    found, reports = search.run_trials(spark, {n: (n, curves[n]) for n in curves}, lambda c, report: [report(i, v) for i, v in enumerate(c[1])], parallel=5, startup=3, warmup=2)
    judged = {(r.trial, r.step) for r in trials.pruned(reports, 3, 2).where("prune").collect()}
    rows = {r.trial: r for r in found.collect()}
    assert judged == {(n, r.pruned_at) for n, r in rows.items() if r.state == "PRUNED"} and judged
    assert all(r.value == max(curves[n][: r.steps]) and (r.state == "PRUNED" or r.steps == 6) for n, r in rows.items())


def test_a_pruned_trials_tasks_end_and_others_go_on(spark):
    def slowly(batches):
        for batch in batches:
            time.sleep(120)
            yield batch

    def objective(number, report):
        if number == 2:
            raise ValueError("bad settings")
        if number == 1:
            report(0, 0.1)
            spark.range(0, 4, 1, 4).mapInArrow(slowly, "id long").count()  # goes on until the verdict
        else:
            time.sleep(3)
            assert spark.range(1000).count() == 1000
            report(0, 0.5 + number / 100)

    began = time.time()
    found, reports = search.run_trials(spark, {n: n for n in range(4)}, objective, parallel=4, startup=0, warmup=0)
    assert time.time() - began < 60
    rows = {r.trial: r for r in found.collect()}
    assert [rows[n].state for n in range(4)] == ["COMPLETE", "PRUNED", "FAIL", "COMPLETE"] and rows[1].pruned_at == 0
    assert rows[2].error == "ValueError: bad settings" and rows[2].value is None and reports.count() == 3
    for _ in range(50):
        active = spark.sparkContext.statusTracker().getActiveJobsIds()
        if not active:
            break
        time.sleep(0.2)
    assert not active


def test_no_settings(spark):
    found, reports = search.run_trials(spark, {}, None)
    assert found.count() == reports.count() == 0


def test_trials_train_and_keep_their_best_version(spark, tmp_path):
    rows = [(f"k{i}", i, 0, int(u), int(v), int(u + v) % 2) for i, (u, v) in enumerate(np.random.default_rng(4).integers(0, 60, (900, 2)))]
    edges = spark.createDataFrame(rows, "edge_key string, major long, minor long, u long, v long, label int")
    base = Config().override("dataset.walks_per_node=4", "model.nlayers=1", f"training.checkpoint_dir={tmp_path}/versions")
    drawn = trials.search_space(spark, 2).collect()
    settings = {r.trial: search.settings_of(r, base).override("training.epochs=2", "dataset.num_walks=0", "dataset.max_walk_length=6", "training.batch_size=64") for r in drawn}
    assert all(c.model.embedding_dim % c.model.nhead == 0 for c in settings.values())
    found, reports = search.run_trials(spark, settings, search.training_objective(lambda cfg: from_edges(edges, cfg)), parallel=2)
    assert [(r.trial, r.state, r.steps, r.error) for r in found.orderBy("trial").collect()] == [(0, "COMPLETE", 2, None), (1, "COMPLETE", 2, None)]
    for n in settings:
        folder = settings[n].training.checkpoint_dir
        assert folder.endswith(f"trial_{n}") and store.versions(spark, folder)[-1] == 2
    assert reports.where("value is not null").count() > 0


def test_settings_of_a_row():
    row = Row(trial=3, nhead=4, emb=16, max_walk_length=20.0, num_walks=200000.0, lr=1e-5, weight_decay=0.1, batch_size=32.0, gradient_clip_val=0.5, early_stopping_patience=7.0, hidden_dim=8.0, nlayers=2.0, dropout=0.25, epochs=15.0)
    cfg = search.settings_of(row, Config())
    assert (cfg.training.lr, cfg.training.epochs, cfg.model.dropout, cfg.dataset.num_walks, cfg.training.checkpoint_dir) == (1e-5, 15, 0.25, 200000, "")
    with pytest.raises(AttributeError):
        search.settings_of(Row(trial=1), Config())
