"""Pickled studies: trials come back as rows, and a pickle can't import or run anything."""

import datetime
import enum
import json
import pickle
import sys
import threading
import types
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from edgewalk import cli
from edgewalk.operators import trials
from edgewalk.sources import eventfiles, studies


@pytest.fixture
def library(monkeypatch):
    """Classes as a search library pickles them, in modules that only the writer can import."""
    names = ("optuna", "optuna.trial", "optuna.trial._frozen", "optuna.trial._state", "optuna.study", "optuna.study.study", "optuna.storages", "optuna.storages._in_memory")
    made = {n: types.ModuleType(n) for n in names}
    for n, m in made.items():
        monkeypatch.setitem(sys.modules, n, m)
    state = enum.IntEnum("TrialState", list(zip(studies.STATES, range(5), strict=True)), module="optuna.trial._state")
    made["optuna.trial._state"].TrialState = state

    def cls(module, name, **methods):
        made[module].__dict__[name] = type(name, (), {"__module__": module, **methods})
        return made[module].__dict__[name]

    return types.SimpleNamespace(
        State=state, Trial=cls("optuna.trial._frozen", "FrozenTrial"), Info=cls("optuna.storages._in_memory", "_StudyInfo"), Study=cls("optuna.study.study", "Study"),
        Storage=cls("optuna.storages._in_memory", "InMemoryStorage", __getstate__=lambda self: {k: v for k, v in self.__dict__.items() if k != "_lock"}),
    )


def filled(cls, **held):
    one = cls()
    one.__dict__.update(held)
    return one


def study(lib, rows, name="searched"):
    made = [filled(lib.Trial, _number=n, state=lib.State[s], _values=None if v is None else [v], _datetime_start=datetime.datetime(2024, 1, 1), _params=p, _user_attrs=a, _system_attrs=defaultdict(list), intermediate_values=r) for n, s, v, p, a, r in rows]
    storage = filled(lib.Storage, _studies={0: filled(lib.Info, trials=made, name=name)}, _lock=threading.RLock())
    return filled(lib.Study, study_name=name, _storage=storage, _study_id=0)


ROWS = [
    (0, "COMPLETE", -0.75, {"training.lr": 0.5, "model.nhead": 4, "model.embedding_dim": 32}, {}, {0: 0.5, 1: 0.75}),
    (1, "PRUNED", -0.5, {"training.lr": 0.25, "model.nhead_emb_combo": 2}, {}, {0: 0.25}),
    (2, "COMPLETE", -0.875, {"training.lr": None, "model.nhead_emb_combo": 19}, {"actual_nhead": 8, "actual_embedding_dim": 64, "é": [1, "x"]}, {}),
    (3, "FAIL", None, {}, {}, {}), (4, "COMPLETE", 0.0, {"dataset.name": "alpha"}, {}, {}),
]


def test_a_saved_study_gives_its_trials(spark, tmp_path, library):
    for k, protocol in enumerate((2, 4, 5)):
        (tmp_path / f"study_{k}.pkl").write_bytes(pickle.dumps(study(library, ROWS, None if k == 2 else f"s{k}"), protocol=protocol))
    (tmp_path / "study_3.pkl").write_bytes(zlib.compress(pickle.dumps(study(library, ROWS[:2], "packed"))))
    (tmp_path / "study_4.pkl").write_bytes(pickle.dumps(study(library, [], "empty")))
    read = studies.read_pickled_studies(spark, str(tmp_path / "study_*.pkl"))
    got = {(r.study, r.trial): (r.state, r.value, r.val_auc, r.params, r.user_attrs, r.reports) for r in read.collect()}
    assert {s for s, _ in got} == {"s0", "s1", "study_2", "packed"} and len(got) == 17
    for name in ("s0", "s1", "study_2"):
        assert got[name, 0] == ("COMPLETE", -0.75, 0.75, {"training.lr": "0.5", "model.nhead": "4", "model.embedding_dim": "32"}, {}, {0: 0.5, 1: 0.75})
        assert got[name, 2][3:5] == ({"training.lr": None, "model.nhead_emb_combo": "19"}, {"actual_nhead": "8", "actual_embedding_dim": "64", "é": '[1, "x"]'})
        assert got[name, 3] == ("FAIL", None, None, {}, {}, {})
        assert got[name, 4][3] == {"dataset.name": "alpha"}
    columns = studies.trial_columns(read.where("study = 's0'"), ("training.lr",))
    assert {r.trial: (r.heads, r.dims, r["training.lr"]) for r in trials.described(columns).collect()} == {0: ("4", "32", "0.5"), 1: ("1", "16", "0.25"), 2: ("8", "64", None), 3: ("Unknown", "Unknown", None), 4: ("Unknown", "Unknown", None)}
    assert [(r.trial, r["rank"]) for r in trials.top_trials(trials.completed(columns)).orderBy("rank").collect()] == [(2, 1), (0, 2), (4, 3)]
    assert sorted((r.trial, r.step, r.value) for r in studies.study_reports(read.where("study = 's1'")).collect()) == [(0, 0, 0.5), (0, 1, 0.75), (1, 0, 0.25)]
    assert studies.study_reports(read).where(F.col("study") == "empty").count() == 0


def test_boards_of_pickled_studies_and_event_files(spark, tmp_path, library, monkeypatch, capsys):
    (tmp_path / "a.pkl").write_bytes(pickle.dumps(study(library, ROWS)))
    monkeypatch.setattr(cli, "SparkSession", type("S", (), {"builder": type("B", (), {"appName": lambda self, n: self, "getOrCreate": lambda self: spark})()}))
    cli.main(["board", "--study-path", str(tmp_path / "*.pkl"), "--output-config", str(tmp_path / "best")])
    best = json.loads("".join(p.read_text() for p in (tmp_path / "best").glob("part-*")))
    assert best["model"]["nhead"] == "8" and best["model"]["embedding_dim"] == "64" and best["dataset"]["max_walk_length"] == 50
    cli.main(["report", "--study-path", str(tmp_path / "*.pkl")])
    eventfiles.write_events(spark.createDataFrame([("r", "loss", s, s / 4) for s in range(4)], "run string, tag string, step long, value double"), str(tmp_path / "logs"))
    cli.main(["events", "--log-dir", str(tmp_path / "logs")])
    said = capsys.readouterr().out
    assert "PRUNED" in said and "0.875" in said and "0.75" in said


class Call:
    def __init__(self, what, *args):
        self.what, self.args = what, args

    def __reduce__(self):
        return self.what, self.args


def test_hostile_files_raise_and_run_nothing(spark, tmp_path, library):
    import os
    import subprocess

    mark = tmp_path / "ran"
    for k, bad in enumerate((Call(os.system, f"touch {mark}"), Call(eval, f"open({str(mark)!r}, 'w')"), Call(subprocess.call, ["touch", str(mark)]), Call(getattr, 1, "real"))):
        (tmp_path / f"bad{k}.pkl").write_bytes(pickle.dumps(filled(library.Study, _storage=bad)))
        with pytest.raises(Exception, match=f"bad{k}.pkl can't be read as a study: a study must not name"):
            studies.read_pickled_studies(spark, str(tmp_path / f"bad{k}.pkl")).collect()
    for k, data in enumerate((b"not a pickle", pickle.dumps([1, 2]), pickle.dumps(study(library, ROWS))[:-40], pickle.dumps(filled(library.Study, study_name="far", _storage=filled(library.Info, url="db"))))):
        (tmp_path / f"odd{k}.pkl").write_bytes(data)
        with pytest.raises(Exception, match=f"odd{k}.pkl can't be read as a study"):
            studies.read_pickled_studies(spark, str(tmp_path / f"odd{k}.pkl")).collect()
    (tmp_path / "empty.pkl").write_bytes(b"")
    assert studies.read_pickled_studies(spark, str(tmp_path / "empty.pkl")).count() == 0
    assert not mark.exists()
