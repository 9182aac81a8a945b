"""Pickled studies as tables of trials, without importing or running anything that a pickle names.

A pickle may name any function to be called. Here a name stands for an empty record, a call of it keeps its arguments, and
only names of ``MODULES`` and of a few plain builders are read at all: any other raises ``ValueError``. A study has
its trials in its storage in memory, or as a list; a study whose trials lie in a database has none in its file and raises.

A file is read whole by one task (2 GB at most). A value is told as it was minimised; ``val_auc`` is its negative.
"""

from __future__ import annotations

import datetime
import io
import json
import pickle
import zlib
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _bytes_of(text: str, encoding: str) -> bytes:
    """Older protocols write bytes as text of that one encoding."""
    if encoding not in ("latin1", "latin-1"):
        raise ValueError(f"a study must not name the encoding {encoding}")
    return text.encode("latin1")


# Packages whose objects become plain records, builders of plain values, the numbers of states, and names.
MODULES = ("optuna", "threading", "_thread", "logging")
BUILDERS = {
    ("collections", "OrderedDict"): OrderedDict, ("collections", "defaultdict"): defaultdict, ("builtins", "set"): set, ("builtins", "frozenset"): frozenset, ("builtins", "dict"): dict, ("builtins", "list"): list,
    ("builtins", "int"): int, ("builtins", "float"): float, ("datetime", "datetime"): datetime.datetime, ("datetime", "timedelta"): datetime.timedelta,
    ("_codecs", "encode"): _bytes_of,
}
STATES = ("RUNNING", "COMPLETE", "PRUNED", "FAIL", "WAITING")
TRIAL_CLASS, STATE_CLASS = "FrozenTrial", "TrialState"
ZLIB_HEAD = b"\x78"

STUDY_SCHEMA = "study string, trial long, state string, value double, val_auc double, params map<string,string>, user_attrs map<string,string>, reports map<long,double>"


class Record:
    """What stands for an object of a named class: its class's name, the arguments of its making and its attributes."""

    name = ""

    def __new__(cls, *args, **_):
        made = object.__new__(cls)
        made.args = args
        return made

    def __init__(self, *_, **__):
        pass

    def __setstate__(self, state) -> None:
        if isinstance(state, tuple):
            state = {k: v for part in state if part for k, v in part.items()}
        self.__dict__.update(state)


class Reader(pickle.Unpickler):
    """An unpickler that imports nothing: names become records or plain builders, or raise."""

    def __init__(self, data: bytes):
        super().__init__(io.BytesIO(data))
        self._made: dict[str, type] = {}

    def find_class(self, module: str, name: str):
        module = "builtins" if module == "__builtin__" else module
        if (module, name) in BUILDERS:
            return BUILDERS[module, name]
        if module.split(".")[0] not in MODULES:
            raise ValueError(f"a study must not name {module}.{name}")
        return self._made.setdefault(name, type("Record", (Record,), {"name": name}))

    def persistent_load(self, pid):
        raise ValueError("a study has no outer objects")


def load_plain(data: bytes):
    """The object of a pickle, plain or compressed by zlib."""
    raw = zlib.decompress(data) if data[:1] == ZLIB_HEAD else data
    return Reader(raw).load()


def _trials(root) -> Iterator[Record]:
    """Every trial that an object holds, once each, wherever it lies."""
    seen, todo = set(), [root]
    while todo:
        one = todo.pop()
        if id(one) in seen or isinstance(one, (str, bytes, int, float, type(None))):
            continue
        seen.add(id(one))
        if isinstance(one, Record) and one.name == TRIAL_CLASS:
            yield one
        elif isinstance(one, Record):
            todo += [one.__dict__]
        elif isinstance(one, dict):
            todo += list(one.values())
        elif isinstance(one, (list, tuple, set, frozenset)):
            todo += list(one)


def _first(record: Record, *names: str):
    return next((record.__dict__[n] for n in names if record.__dict__.get(n) is not None), None)


def _text(values: dict | None) -> list[tuple[str, str | None]]:
    plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v) if isinstance(v, (bool, int, float, list, dict)) else repr(v)
    return [(str(k), plain(v)) for k, v in sorted((values or {}).items(), key=lambda kv: str(kv[0]))]


def _state(found) -> str:
    number = found.args[0] if isinstance(found, Record) and found.name == STATE_CLASS else found
    return STATES[number]


def study_rows(data: bytes) -> list[tuple]:
    """(study name, trial, state, value, params, user_attrs, reports) of a pickled study's trials; raises if it is none."""
    root = load_plain(data)
    out = {}
    for t in _trials(root):
        values = _first(t, "_values", "values")
        value = values[0] if values else _first(t, "_value", "value")
        reports = [(int(k), float(v)) for k, v in sorted((_first(t, "intermediate_values", "_intermediate_values") or {}).items())]
        number = int(_first(t, "_number", "number") or 0)
        out[number] = (number, _state(_first(t, "state", "_state")), None if value is None else float(value), _text(_first(t, "_params", "params")), _text(_first(t, "_user_attrs", "user_attrs")), reports)
    if not isinstance(root, Record) or (not out and "_storage" in root.__dict__ and not _holds_trials(root)):
        raise ValueError("no study with its trials")
    name = _first(root, "study_name", "_study_name")
    return [(name, *out[n]) for n in sorted(out)]


def _holds_trials(root: Record) -> bool:
    """Whether a study without trials is an empty one in memory; else its trials lie elsewhere."""
    return isinstance(root.__dict__["_storage"], Record) and "_studies" in root.__dict__["_storage"].__dict__


def read_pickled_studies(spark: SparkSession, path: str) -> DataFrame:
    """The trials of all study files of a glob: ``STUDY_SCHEMA``. A study without a name takes its file's.

    A file that isn't a study, or names what a study has no need of, raises and tells its path; an empty file has no trials. Null values stay null.
    """
    pairs = lambda v: pa.map_(pa.string(), v)
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64(), pairs(pa.string()), pairs(pa.string()), pa.map_(pa.int64(), pa.float64())]
    schema = pa.schema(list(zip(("file", "study", "trial", "state", "value", "params", "user_attrs", "reports"), types, strict=True)))

    def decoded(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = study_rows(content.as_py())
                except Exception as e:
                    raise ValueError(f"{name.as_py()} can't be read as a study: {e}") from e
                if rows:
                    columns = [[name.as_py()] * len(rows), *zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(decoded, "file string, study string, trial long, state string, value double, params map<string,string>, user_attrs map<string,string>, reports map<long,double>")
    name = F.coalesce("study", F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?\z", 1))
    return rows.select(name.alias("study"), "trial", "state", "value", (-F.col("value")).alias("val_auc"), "params", "user_attrs", "reports")


def trial_columns(studies: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """study, trial, state, val_auc, and for ``described`` nhead, emb, attr_nhead, attr_emb, combo, and the parameters ``names`` as columns of text."""
    # The names that searches gave to heads and embedding.
    p, a = F.col("params"), F.col("user_attrs")
    fixed = (p["model.nhead"].alias("nhead"), p["model.embedding_dim"].alias("emb"), a["actual_nhead"].alias("attr_nhead"), a["actual_embedding_dim"].alias("attr_emb"), F.expr("try_cast(params['model.nhead_emb_combo'] as bigint)").alias("combo"))
    return studies.select("study", "trial", "state", "val_auc", *fixed, *(p[n].alias(n) for n in names))


def study_reports(studies: DataFrame) -> DataFrame:
    """(study, trial, step, value) of what trials reported on their way, the input of ``pruned`` study by study."""
    return studies.select("study", "trial", F.explode("reports").alias("step", "value"))
