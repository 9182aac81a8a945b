"""``python -m edgewalk.cli prepare|profile|train|board|report|log|events``: preparation, profiles, training, studies, search logs and event files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .operators import profile, training, trials
from .plans.prepare import prepare_cached
from .sources import eventfiles, records, sinks, studies

# The settings of a search that boards show.
SETTINGS = (
    "dataset.max_walk_length", "dataset.num_walks", "training.lr", "training.weight_decay", "training.batch_size", "training.gradient_clip_val", "training.early_stopping_patience", "training.epochs",
    "model.hidden_dim", "model.nlayers", "model.dropout",
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="edgewalk")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("prepare", "profile", "train"):
        one = sub.add_parser(name)
        one.add_argument("--config", help="JSON file of settings")
        one.add_argument("--path", required=True, help="where the dataset lies")
        one.add_argument("overrides", nargs="*", help="section.key=value")
    # The names of options that users know.
    board = sub.add_parser("board")
    board.add_argument("--study-path", required=True, help="glob of trial tables, or of pickled studies (*.pkl)")
    board.add_argument("--top-n", type=int, default=10)
    board.add_argument("--output-csv")
    board.add_argument("--output-config")
    report = sub.add_parser("report")
    report.add_argument("--study-path", required=True, help="glob of trial tables, or of pickled studies (*.pkl)")
    events = sub.add_parser("events")
    events.add_argument("--log-dir", required=True, help="folder of event files")
    log = sub.add_parser("log")
    log.add_argument("--log-path", required=True, help="text of a search")
    log.add_argument("--output", required=True, help="folder of JSON lines")
    return p


def study_table(spark: SparkSession, path: str) -> DataFrame:
    """Trials of trial tables or of pickled studies, whose heads and embedding come from any of their three places."""
    if not path.endswith(".pkl"):
        return records.read_studies(spark, path)
    read = studies.read_pickled_studies(spark, path)
    known = trials.described(studies.trial_columns(read, SETTINGS))
    return known.drop("nhead", "emb", "attr_nhead", "attr_emb", "combo").withColumnsRenamed({"heads": "model.nhead", "dims": "model.embedding_dim"})


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("edgewalk").getOrCreate()
    if args.command == "events":
        rows = eventfiles.read_events(spark, args.log_dir)
        trials.last_values(eventfiles.event_scalars(rows), ("run", "tag")).orderBy("run", "tag").show(100, truncate=False)
        eventfiles.event_faults(rows).show(truncate=False)
        return
    if args.command == "report":
        found = study_table(spark, args.study_path)
        trials.statuses(found).orderBy("study", "state").show(truncate=False)
        trials.best_trial(trials.completed(found)).show(truncate=False)
        return
    if args.command == "log":
        trials.parse_trial_log(records.read_log(spark, args.log_path)).write.mode("overwrite").json(args.output)
        return
    if args.command == "board":
        best = trials.leaderboard(trials.completed(study_table(spark, args.study_path)), args.top_n, args.top_n)
        best.show(args.top_n, truncate=False)
        if args.output_csv:
            sinks.write_leaderboard(best, args.output_csv)
        if args.output_config:
            sinks.write_best_config(best, args.output_config)
        return
    cfg = Config.load(args.config, *args.overrides) if args.config else Config().override(*args.overrides)
    ready = prepare_cached(spark, args.path, cfg)
    print(ready.meta())
    if args.command == "train":
        state, history = training.fit_prepared(ready, cfg)
        for row in history:
            print(row)
        print({"epochs": state.epoch, **{f"test_{k}": v for k, v in training.evaluated(ready.view("test", pad=False), state).items()}})
    if args.command == "profile":
        for rows in (profile.label_histogram(ready.edges), profile.stage_summary(ready.views()), profile.stage_sparsity(ready.views())):
            rows.show(truncate=False)


if __name__ == "__main__":
    main()
