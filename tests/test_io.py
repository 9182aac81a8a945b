"""Sources, sinks, the cache, logs and the command line, by writing and reading again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from edgewalk import cli
from edgewalk.config import Config
from edgewalk.operators import splits, trials
from edgewalk.plans.prepare import Prepared, load, prepare, prepare_cached, save
from edgewalk.sources import edges as src
from edgewalk.sources import records, sinks


def lines_of(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def edge_file(path, n=400, seed=1, separator=" ", nodes=40):
    rng = random.Random(seed)
    rows = [(rng.randrange(nodes), rng.randrange(nodes), rng.choice([-1, 0, 1])) for _ in range(n)]
    path.write_text("".join(f"{separator.join(map(str, r))}{separator}9.5\n" for r in rows))
    return rows


def test_edge_keys_do_not_depend_on_file_splits(spark, tmp_path):
    rows = edge_file(tmp_path / "a.txt") + edge_file(tmp_path / "b.txt", 100, 2)
    got, parts = [], []
    for size, least in (("64m", "64m"), ("300", "1"), ("64m", "1")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", least)
        parts.append(src.read_lines(spark, str(tmp_path)).rdd.getNumPartitions())
        edges = src.load_spaced(spark, str(tmp_path))
        assert [(r.u, r.v, r.label) for r in edges.orderBy("major", "minor").collect()] == rows
        got.append(sorted((r.edge_key, r.split_id) for r in splits.split_edges(edges).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(set(parts)) == 3 and got[0] == got[1] == got[2] and len({k for k, _ in got[0]}) == 500


def test_edge_keys_of_equal_file_names_in_two_folders(spark, tmp_path):
    want = {}
    for day, seed in (("day=1", 3), ("day=2", 4), ("odd name", 5)):
        (tmp_path / day).mkdir()
        for k, row in enumerate(edge_file(tmp_path / day / "part.txt", 40, seed)):
            want[f"{day.replace(' ', '%20')}/part.txt-{k}"] = row
    got = []
    for size, least in (("64m", "64m"), ("200", "1"), ("64m", "1")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", least)
        for path in (str(tmp_path), f"{tmp_path}/*"):
            edges = src.load_spaced(spark, path)
            assert {r.edge_key: (r.u, r.v, r.label) for r in edges.collect()} == want
            got.append(sorted((r.edge_key, r.split_id) for r in splits.split_edges(edges).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(g == got[0] for g in got)


def test_split_keeps_columns_of_any_name(spark):
    names = ["rank", "drawn", "n_all", "row", "_bucket", "_k", "_n", "split_id"]
    rows = [(f"k{i}", i % 5, i % 7, i % 3, *range(i, i + len(names))) for i in range(50)]
    got = splits.split_edges(spark.createDataFrame(rows, ["edge_key", "u", "v", "label", *names]))
    assert got.columns == ["edge_key", "u", "v", "label", *names]
    assert sorted(tuple(r)[:-1] for r in got.collect()) == sorted(r[:-1] for r in rows)


def test_comma_files_and_names(spark, tmp_path):
    rows = edge_file(tmp_path / "r.csv", 50, 3, ",")
    assert [(r.u, r.v, r.label) for r in src.get_loader("bitcoin-otc")(spark, str(tmp_path / "r.csv")).orderBy("minor").collect()] == rows
    with pytest.raises(ValueError):
        src.get_loader("no such dataset")
    src.register_loader("mine", src.load_commas)
    assert src.get_loader("mine") is src.load_commas


def small(folder):
    return Config().override("dataset.name=toy", "dataset.num_walks=20", "dataset.max_walk_length=4", f"preprocess.folder={folder}")


def test_the_cache_tells_datasets_apart(spark, tmp_path, monkeypatch):
    edge_file(tmp_path / "a.txt", 60, 5)
    edge_file(tmp_path / "b.txt", 60, 6, nodes=7)
    cfg = small(tmp_path / "cache")
    a, b = (prepare_cached(spark, str(tmp_path / f), cfg) for f in ("a.txt", "b.txt"))
    assert a.meta()["vocab_size"] != b.meta()["vocab_size"] and len(list((tmp_path / "cache").iterdir())) == 2
    want = sorted(map(str, a.encoded.collect()))
    with monkeypatch.context() as m:
        m.setattr("edgewalk.plans.prepare.prepare", None)  # a hit builds nothing
        again = prepare_cached(spark, str(tmp_path / "a.txt"), cfg)
    assert sorted(map(str, again.encoded.collect())) == want and again.meta() == a.meta()
    assert again.view("val").count() == a.view("val").count()
    edge_file(tmp_path / "a.txt", 61, 7)
    assert prepare_cached(spark, str(tmp_path / "a.txt"), cfg).split.count() == 61


def test_a_torn_cache_is_built_again(spark, tmp_path):
    edge_file(tmp_path / "a.txt", 60, 5)
    cfg = small(tmp_path / "cache")
    first = prepare_cached(spark, str(tmp_path / "a.txt"), cfg)
    want = sorted(map(str, first.encoded.collect()))
    (base,) = (tmp_path / "cache").iterdir()
    for table in ("encoded", "walks", "manifest"):
        for part in (base / table).glob("*part-*"):
            part.unlink()
        assert load(spark, str(base)) is None
        again = prepare_cached(spark, str(tmp_path / "a.txt"), cfg)
        assert sorted(map(str, again.encoded.collect())) == want and load(spark, str(base)) is not None


def test_a_killed_writer_leaves_nothing_to_load(spark, tmp_path, monkeypatch):
    edge_file(tmp_path / "a.txt", 60, 5)
    cfg = small(tmp_path / "cache")
    with monkeypatch.context() as m:
        m.setattr(Prepared, "meta", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            prepare_cached(spark, str(tmp_path / "a.txt"), cfg)
    names = [p.name for p in (tmp_path / "cache").iterdir()]
    assert names and all(n.startswith("_") for n in names)
    assert prepare_cached(spark, str(tmp_path / "a.txt"), cfg).split.count() == 60


def test_the_second_writer_loses(spark, tmp_path):
    edge_file(tmp_path / "a.txt", 60, 5)
    edge_file(tmp_path / "b.txt", 70, 6)
    a, b = (prepare(spark, str(tmp_path / f), small("")) for f in ("a.txt", "b.txt"))
    base = str(tmp_path / "cache" / "key")
    assert save(a, base) and not save(b, base)
    assert load(spark, base).split.count() == 60
    assert [p.name for p in (tmp_path / "cache").iterdir()] == ["key"] and not [p for p in (tmp_path / "cache" / "key").iterdir() if p.name.startswith("_")]


def test_appends_that_are_tried_again(spark, tmp_path):
    rows = [(i, "COMPLETE", 0.5 + i / 100, 0.1, f"s{i % 2}") for i in range(6)]
    path = str(tmp_path / "studies")
    sinks.append_trials(spark.createDataFrame(rows[:4], TRIALS), path)
    sinks.append_trials(spark.createDataFrame(rows[2:], TRIALS), path)
    sinks.append_trials(spark.createDataFrame(rows[2:], TRIALS), path)
    got = records.read_studies(spark, path)
    assert sorted(tuple(r) for r in got.select("trial", "state", "val_auc", "`training.lr`", "study").collect()) == rows
    metrics = str(tmp_path / "metrics")
    for run, n in (("a", 3), ("b", 2), ("a", 3)):
        sinks.append_metrics(spark.createDataFrame([("loss", k, float(n)) for k in range(n)], records.SCALAR_SCHEMA), metrics, run)
    assert sorted((r.run, r.step) for r in records.read_scalars(spark, metrics, ("loss",)).collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]


def test_toy_ratings_and_boards(spark, tmp_path):
    toy = src.toy_graph(spark)
    sinks.write_toy_edges(toy, str(tmp_path / "toy"))
    text = lines_of(tmp_path / "toy")
    assert text[0] == "% toy dataset" and text[1].startswith("1 2 ") and all(x.endswith("\t1.0") for x in text[1:]) and len(text) == 101
    assert src.load_spaced(spark, str(tmp_path / "toy")).count() == 100
    (tmp_path / "r.csv").write_text("1,2,3,10.5\n2,3,-1,11.0\n")
    rated = src.read_ratings(spark, str(tmp_path / "r.csv"))
    sinks.write_ratings(rated.withColumn("binary_rating", (F.col("rating") > 0).cast("int")), str(tmp_path / "out"))
    assert lines_of(tmp_path / "out") == ["1,2,1,10.5", "2,3,0,11.0"]
    (tmp_path / "bad.csv").write_text("1,2,x,10.5\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        src.read_ratings(spark, str(tmp_path / "bad.csv")).collect()


def test_metrics_tables(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for step in range(3):
        sinks.append_metrics(spark.createDataFrame([("loss", step, 1.0 / (step + 1)), ("auc", step, 0.5)], records.SCALAR_SCHEMA), path)
    assert records.read_scalars(spark, path).count() == 6
    one = records.read_scalars(spark, path, ("loss",))
    assert "tag" in one._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert [tuple(r) for r in trials.last_values(one).collect()] == [("loss", 2, pytest.approx(1 / 3))]


TRIALS = "trial long, state string, val_auc double, `training.lr` double, study string"


def test_studies_boards_and_the_command_line(spark, tmp_path, capsys, monkeypatch):
    rows = [(0, "COMPLETE", 0.6, 0.1, "s1"), (1, "FAIL", None, 0.2, "s1"), (2, "PRUNED", 0.9, 0.3, "s1"), (3, "COMPLETE", 0.0, 0.4, "s1"), (0, "COMPLETE", 0.7, 0.5, "s2")]
    sinks.append_trials(spark.createDataFrame(rows, TRIALS), str(tmp_path / "studies"))
    studies = records.read_studies(spark, str(tmp_path / "studies"))
    assert studies.count() == 5
    assert [(r.study, r.trial, r["rank"]) for r in trials.leaderboard(trials.completed(studies)).orderBy("rank").collect()] == [("s2", 0, 1), ("s1", 0, 2), ("s1", 3, 3)]
    assert {tuple(r) for r in trials.statuses(studies).collect()} == {("s1", "COMPLETE", 2, 2), ("s1", "FAIL", 1, 0), ("s1", "PRUNED", 1, 1), ("s2", "COMPLETE", 1, 1)}
    monkeypatch.setattr(cli, "SparkSession", type("S", (), {"builder": type("B", (), {"appName": lambda self, n: self, "getOrCreate": lambda self: spark})()}))
    cli.main(["board", "--study-path", str(tmp_path / "studies"), "--top-n", "2", "--output-csv", str(tmp_path / "csv"), "--output-config", str(tmp_path / "cfg")])
    assert lines_of(tmp_path / "csv")[0].startswith("trial,") and len(lines_of(tmp_path / "csv")) == 3
    best = json.loads("\n".join(lines_of(tmp_path / "cfg")))
    assert best["training"]["lr"] == 0.5 and best["dataset"]["num_walks"] == sinks.CONFIG_DEFAULTS["dataset.num_walks"]
    cli.main(["report", "--study-path", str(tmp_path / "studies")])
    edge_file(tmp_path / "a.txt", 60, 5)
    cli.main(["profile", "--path", str(tmp_path / "a.txt"), "dataset.name=toy", "dataset.num_walks=10", "dataset.max_walk_length=3"])
    cli.main(["train", "--path", str(tmp_path / "a.txt"), "dataset.name=toy", "dataset.num_walks=10", "dataset.max_walk_length=3", "training.epochs=1", f"training.checkpoint_dir={tmp_path}/versions"])
    assert (tmp_path / "versions" / "version=1").is_dir()
    said = capsys.readouterr().out
    assert "PRUNED" in said and "vocab_size" in said and "val_auc" in said


def test_logs_of_a_search(spark, tmp_path, monkeypatch, capsys):
    log = ["start", "Trial 0 hyperparameters:", "  lr: 0.1", "epoch 1 Val AUC: 0.61", "epoch 2 Val AUC: 0.65", "Trial 0 finished with value: 0.65 and parameters: {\"lr\": 0.1, \"nhead\": None}", "Trial 1 hyperparameters:", "Trial 1 finished with value: 0 and parameters: {\"lr\": 0.2}"]
    (tmp_path / "log.txt").write_text("\n".join(log))
    lines = records.read_log(spark, str(tmp_path / "log.txt"))
    assert [r.value for r in lines.orderBy("line_no").collect()] == log
    got = {r.trial: (r.val_auc, r.params) for r in trials.parse_trial_log(lines).collect()}
    assert got == {0: (0.61, {"lr": "0.1", "nhead": None}), 1: (None, {"lr": "0.2"})}
    monkeypatch.setattr(cli, "SparkSession", type("S", (), {"builder": type("B", (), {"appName": lambda self, n: self, "getOrCreate": lambda self: spark})()}))
    cli.main(["log", "--log-path", str(tmp_path / "log.txt"), "--output", str(tmp_path / "parsed")])
    assert spark.read.json(str(tmp_path / "parsed")).count() == 2


def test_medians_and_descriptions(spark):
    reports = [(t, s, float(t * 10 + s)) for t in range(8) for s in range(8)] + [(8, 6, 0.0), (8, 7, 99.0), (9, 2, 0.0)]
    got = {(r.trial, r.step): r.prune for r in trials.pruned(spark.createDataFrame(reports, "trial long, step long, value double")).collect()}
    want = {}
    for t, s, v in reports:
        earlier = sorted(x for a, b, x in reports if b == s and a < t)
        n = len(earlier)
        median = (earlier[(n - 1) // 2] + earlier[n // 2]) / 2 if n else None
        want[t, s] = bool(t >= 5 and s >= 5 and n and v < median)
    assert got == want and sum(got.values()) == 1
    rows = spark.createDataFrame([(0, "4", None, None, None, 3), (1, None, None, "8", "16", 3), (2, None, None, None, None, 19), (3, None, None, None, None, None)], "trial long, nhead string, emb string, attr_nhead string, attr_emb string, combo long")
    assert {r.trial: (r.heads, r.dims) for r in trials.described(rows).collect()} == {0: ("4", "32"), 1: ("8", "16"), 2: ("8", "16"), 3: ("Unknown", "Unknown")}


def test_old_files_are_deleted(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"c{i}").write_text("x")
    files = spark.createDataFrame([(str(tmp_path), float(i), f"c{i}") for i in range(5)], "folder string, mtime double, name string")
    assert sinks.delete_old(files, 2) == 3 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["c3", "c4"]


def test_search_ranges(spark):
    rows = trials.search_space(spark, 400).collect()
    for name, (kind, *bounds) in trials.RANGES.items():
        values = [r[name] for r in rows]
        assert set(values) <= set(map(float, bounds)) if kind == "choice" else bounds[0] <= min(values) and max(values) <= bounds[1], name
    assert all(r.emb % r.nhead == 0 for r in rows)
