"""A search over settings: trials that train at the same time and are stopped when the median rule prunes them.

Each trial runs in a thread of the driver, and its Spark jobs carry the trial's tag. After each epoch a trial reports its
validation score. A report of a trial is judged once all trials of smaller numbers have reported that step or have ended:
below the median of what they reported, the trial is pruned (the rule of ``trials.pruned``, with its startup and warmup).
Trials don't wait for verdicts; one that comes late cancels the trial's running jobs by their tag, and reports behind
the pruned step are dropped. So trials end in the same states, with the same reports, however many run at a time.

A trial that raises is FAIL with its message, its reports stay and others go on. Reports that are null or no number are
neither pruned nor counted; a step that is reported twice keeps the first value. The driver holds one number for each
trial and epoch. No settings give an empty table.
"""

from __future__ import annotations

import math
import statistics
import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession

from ..config import Config
from . import training

COMPLETE, PRUNED, FAIL, RUNNING = "COMPLETE", "PRUNED", "FAIL", "RUNNING"
TRIALS = "trial long, state string, value double, steps long, pruned_at long, error string"
REPORTS = "trial long, step long, value double"


class Stopped(Exception):
    """Raised in a trial that has been pruned."""


@dataclass
class Trial:
    state: str = RUNNING
    reports: dict[int, float | None] = field(default_factory=dict)
    judged: set[int] = field(default_factory=set)
    pruned_at: int | None = None
    error: str | None = None

    def ended(self) -> bool:
        return self.state != RUNNING and len(self.judged) == len(self.reports)

    def known_at(self, step: int) -> bool:
        """Whether what this trial reported at a step can't change any more."""
        return self.ended() or step in self.judged


class Board:
    """The reports of all trials and the verdicts on them; ``cancel`` is told the trials to stop."""

    def __init__(self, numbers: Iterable[int], startup: int, warmup: int, cancel: Callable[[int], None]):
        self.trials = {n: Trial() for n in sorted(numbers)}
        self.startup, self.warmup, self.cancel, self.lock = startup, warmup, cancel, threading.RLock()

    def check(self, number: int) -> None:
        with self.lock:
            if self.trials[number].pruned_at is not None:
                raise Stopped(number)

    def report(self, number: int, step: int, value: float | None) -> None:
        with self.lock:
            self.check(number)
            self.trials[number].reports.setdefault(step, value)
            self._judge()
            self.check(number)

    def end(self, number: int, state: str, error: str | None = None) -> None:
        with self.lock:
            one = self.trials[number]
            if one.pruned_at is None:
                one.state, one.error = state, error
            self._judge()

    def _judge(self) -> None:
        """Judge in the order of trials: a verdict depends on smaller numbers only, so one pass settles what can be."""
        earlier: list[Trial] = []
        for number, one in self.trials.items():
            for step in sorted(one.reports.keys() - one.judged):
                if not all(e.known_at(step) for e in earlier):
                    break
                one.judged.add(step)
                if self._below(number, step, one.reports[step], earlier):
                    one.reports = {k: v for k, v in one.reports.items() if k <= step}
                    one.state, one.pruned_at, one.error = PRUNED, step, None
                    self.cancel(number)
                    break
            earlier.append(one)

    def _below(self, number: int, step: int, value: float | None, earlier: list[Trial]) -> bool:
        if number < self.startup or step < self.warmup or not _is_number(value):
            return False
        others = [v for e in earlier if _is_number(v := e.reports.get(step))]
        return bool(others) and value < statistics.median(others)


def _is_number(value: float | None) -> bool:
    return value is not None and not math.isnan(value)


@dataclass
class Reporter:
    """What a trial gets: call it with a step and a value; ``check`` raises ``Stopped`` once the trial is pruned."""

    board: Board
    number: int

    def __call__(self, step: int, value: float | None) -> None:
        self.board.report(self.number, step, value)

    def check(self) -> None:
        self.board.check(self.number)


def run_trials(spark: SparkSession, settings: dict[int, Config], objective: Callable[[Config, Reporter], None], parallel: int = 4, startup: int = 5, warmup: int = 5) -> tuple[DataFrame, DataFrame]:
    """Run ``objective`` for every trial's settings, ``parallel`` at a time, smaller numbers first: trials and reports.

    A trial's value is the best of its reports, null without any; ``steps`` counts them.
    """
    sc, run = spark.sparkContext, uuid.uuid4().hex
    tag = lambda number: f"search-{run}-{number}"
    board = Board(settings, startup, warmup, lambda number: sc.cancelJobsWithTag(tag(number)))
    waiting, taking = iter(sorted(settings)), threading.Lock()

    def work() -> None:
        while True:
            with taking:
                number = next(waiting, None)
            if number is None:
                return
            sc.addJobTag(tag(number))
            try:
                objective(settings[number], Reporter(board, number))
                board.end(number, COMPLETE)
            except Exception as e:  # a trial's fault is its result; a cancelled job of a pruned trial ends here, too
                board.end(number, FAIL, f"{type(e).__name__}: {e}"[:2000])
            finally:
                sc.removeJobTag(tag(number))

    threads = [InheritableThread(target=work) for _ in range(min(parallel, len(settings)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    best = lambda one: max(filter(_is_number, one.reports.values()), default=None)
    rows = [(n, one.state, best(one), len(one.reports), one.pruned_at, one.error) for n, one in board.trials.items()]
    reports = [(n, step, value) for n, one in board.trials.items() for step, value in sorted(one.reports.items())]
    return spark.createDataFrame(rows, TRIALS), spark.createDataFrame(reports, REPORTS)


def settings_of(row: Row, base: Config) -> Config:
    """The settings of a row of ``trials.search_space``; each trial keeps its versions in a folder of its own."""
    whole = {
        "dataset.max_walk_length": row.max_walk_length, "dataset.num_walks": row.num_walks, "model.nhead": row.nhead, "model.embedding_dim": row.emb, "model.hidden_dim": row.hidden_dim,
        "model.nlayers": row.nlayers, "training.batch_size": row.batch_size, "training.early_stopping_patience": row.early_stopping_patience, "training.epochs": row.epochs,
    }
    parts = {"model.dropout": row.dropout, "training.lr": row.lr, "training.weight_decay": row.weight_decay, "training.gradient_clip_val": row.gradient_clip_val}
    folder = [f"training.checkpoint_dir={base.training.checkpoint_dir}/trial_{row.trial}"] if base.training.checkpoint_dir else []
    return base.override(*(f"{k}={int(v)}" for k, v in whole.items()), *(f"{k}={float(v)!r}" for k, v in parts.items()), *folder)


def training_objective(prepare: Callable[[Config], object]) -> Callable[[Config, Reporter], None]:
    """Train on what ``prepare`` makes of the settings, keep the best version and the last, and report the validation AUROC of each epoch.

    Training stops by itself when the score has stopped rising (``early_stopping_patience``).
    """

    def objective(cfg: Config, report: Reporter) -> None:
        training.fit_prepared(prepare(cfg), cfg, keep="best", report=report)

    return objective
