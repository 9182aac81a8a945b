"""Hand-made cases of the graph operators."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgewalk.config import Config, Dataset
from edgewalk.functions import tokens as tok
from edgewalk.operators import encode, metrics, profile, splits, transformer, trials, vocab, walks
from edgewalk.plans.prepare import from_edges
from edgewalk.ranking import checkpointed
from edgewalk.sources import edges as src

EDGE = "edge_key string, major long, minor long, u long, v long, label int"


def edge_frame(spark, triples):
    return spark.createDataFrame([(f"0-{i}", 0, i, *t) for i, t in enumerate(triples)], EDGE)


def token_frame(spark, *walk_texts):
    return spark.createDataFrame([(w, i, t) for w, text in enumerate(walk_texts) for i, t in enumerate(text.split())], "walk_id long, pos int, token string")


@pytest.fixture(scope="module")
def walk(spark):
    tokens = token_frame(spark, "N_1 E_0 N_2 E_1 N_3 E_0 N_4 E_1 N_5")
    words = vocab.vocabulary(tokens, edge_frame(spark, [(1, 2, 0)]))
    lookup = spark.createDataFrame([(1, 2, 0, 0), (2, 3, 1, 1), (3, 4, 0, 2), (4, 5, 1, 3)], "u long, v long, label int, split_id int")
    return tokens, words, vocab.class_map(words), encode.encode_walks(tokens, words, lookup)


def test_vocabulary_in_order_of_first_meeting(walk):
    _, words, classes, _ = walk
    got = [r.token for r in words.orderBy("token_id").collect()]
    assert got == ["<PAD>", "<MASK>", "<UNK>", "N_1", "E_0", "N_2", "E_1", "N_3", "N_4", "N_5"]
    assert {r.token: r.class_id for r in classes.collect()} == {"E_0": 0, "E_1": 1}


@pytest.mark.parametrize("stage, x, label, attn", [
    ("train", "3 4 5 1 7 1 8 1 9 0", "-1 -1 -1 1 -1 -1 -1 -1 -1 -1", "1 1 1 1 1 0 1 0 1 0"),
    ("val", "3 4 5 6 7 1 8 1 9 0", "-1 -1 -1 -1 -1 0 -1 -1 -1 -1", "1 1 1 1 1 1 1 0 1 0"),
    ("test", "3 4 5 6 7 4 8 1 9 0", "-1 -1 -1 -1 -1 -1 -1 1 -1 -1", "1 1 1 1 1 1 1 1 1 0"),
])
def test_stage_views(walk, stage, x, label, attn):
    _, _, classes, encoded = walk
    rows = encode.stage_view(encode.padded(encoded, 10), classes, stage).orderBy("pos").collect()
    assert [r.x for r in rows] == list(map(int, x.split()))
    assert [r.label for r in rows] == list(map(int, label.split()))
    assert [r.attn for r in rows] == list(map(int, attn.split()))


def test_an_edge_in_no_split_is_shown_without_label(spark, walk):
    tokens, words, classes, _ = walk
    none = spark.createDataFrame([], "u long, v long, label int, split_id int")
    rows = encode.stage_view(encode.encode_walks(tokens, words, none), classes, "train").collect()
    assert {(r.label, r.attn) for r in rows} == {(-1, 1)} and not [r for r in rows if r.x == 1]


def test_unknown_tokens_and_ids(spark, walk):
    _, words, classes, _ = walk
    coded = tok.encode(spark.createDataFrame([("N_77",)], "token string"), words).collect()[0]
    assert coded.token_id == 2
    assert tok.decode(spark.createDataFrame([(99,)], "token_id long"), words).collect()[0].token == "<UNK>"
    assert tok.encode_label(spark.createDataFrame([("E_9",)], "token string"), classes).collect()[0].class_id == -1
    assert tok.decode_label(spark.createDataFrame([(9,)], "class_id long"), classes).collect()[0].token == "<UNK_LABEL>"
    t = spark.createDataFrame([("E_-1",), ("N_4",), (None,)], "token string")
    got = t.select(tok.parse_edge_label(F.col("token")).alias("e"), tok.parse_node(F.col("token")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(-1, None), (None, 4), (None, None)]


def test_ordered_dedup(spark):
    rows = [(1, 2, 0), (2, 3, 1), (1, 2, 0), (3, 4, -1), (2, 3, 1), (4, 5, 0), (1, 2, 0)]
    got = splits.dedup_ordered(edge_frame(spark, rows)).orderBy("major", "minor").collect()
    assert [(r.u, r.v, r.label) for r in got] == [(1, 2, 0), (2, 3, 1), (3, 4, -1), (4, 5, 0)]


def test_split_sizes_and_precedence(spark):
    split = splits.split_edges(edge_frame(spark, [(i, i + 1, 0) for i in range(10)]), Dataset())
    assert sorted(r["count"] for r in split.groupBy("split_id").count().collect()) == [1, 2, 3, 4]
    twice = spark.createDataFrame([("a", 1, 2, 0, 3), ("b", 1, 2, 0, 0), ("c", 5, 6, 1, 2), ("d", 5, 6, 1, 1)], "edge_key string, u long, v long, label int, split_id int")
    assert {(r.u, r.split_id) for r in splits.split_lookup(twice).collect()} == {(1, 0), (5, 1)}


def test_ratios_must_sum_to_one():
    with pytest.raises(ValueError):
        Config().override("dataset.train_ratio=0.5")
    with pytest.raises(KeyError):
        Config().override("dataset.unknown=1")
    assert Config().override("training.epochs=3", "dataset.name=toy").training.epochs == 3


def test_walks_stop_at_sinks_and_after_enough_steps(spark):
    edges = edge_frame(spark, [(1, 2, 0), (2, 3, 1)])
    long = walks.walk_tokens(walks.random_walks(edges, 20, 5)).groupBy("walk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), " ").alias("w"))
    assert {r.w for r in long.collect()} == {"N_1 E_0 N_2 E_1 N_3", "N_2 E_1 N_3"}
    assert {r["max(pos)"] for r in walks.walk_tokens(walks.random_walks(edges, 20, 1)).groupBy("walk_id").max("pos").collect()} == {2}


def test_no_edges_no_walks(spark):
    assert walks.random_walks(edge_frame(spark, []), 5, 3).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(-1, 1)), min_size=1, max_size=25))
def test_walks_are_walks(spark, triples):
    edges = edge_frame(spark, triples)
    for limit in (10**6, 0):
        paths = walks.random_walks(edges, 12, 4, 7, limit).collect()
        assert len(paths) == 12
        for p in paths:
            node = p.start
            for e in p.path:
                assert (node, e.v, e.label) in triples
                node = e.v
            assert len(p.path) == 4 or node not in {u for u, _, _ in triples}


def test_a_step_moves_walkers_and_not_edges(spark):
    """Between the scan of the edges and the join of any step there is no exchange; walkers have one for each step."""
    rows = [(i % 97, (i * 7) % 101, i % 3) for i in range(3000)]
    edges = edge_frame(spark, rows).select("u", "v", "label")
    nodes = walks.node_table(edges)
    filed = walks.FiledEdges(edges, nodes)
    cur = spark.range(500).select(F.col("id").alias("walk_id"), (F.col("id") % 97).alias("node")).join(nodes, "node").select("walk_id", "node", "deg", "fan", F.array().cast("array<struct<v:bigint,label:int>>").alias("path"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    cur = checkpointed(cur)
    for step in (1, 2, 3):
        cur = walks.step_on(cur, filed.rows(), step, 1)
    lines = cur._jdf.queryExecution().executedPlan().toString().split("\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    scans = [k for k, x in enumerate(lines) if "FileScan" in x and filed.name in x]
    assert len(scans) == 3 and sum("Exchange" in x for x in lines) == 3
    for k in scans:
        level = depth[k]
        for above in range(k - 1, -1, -1):
            if depth[above] < level:
                level = depth[above]
                assert "Exchange" not in lines[above]
                if "Join" in lines[above]:
                    break
    assert cur.count() == 500
    filed.drop()
    assert not spark.catalog.tableExists(filed.name)


def test_blocks_that_many_walkers_visit_are_filed_in_copies(spark):
    """Node 0 takes most edges and has few of its own: its walkers are dealt over copies of its block."""
    rows = [(i, 0, 1) for i in range(1, 400)] + [(0, i, 0) for i in range(1, 400)] + [(i, i + 1, 0) for i in range(1, 100)]
    edges = edge_frame(spark, rows).select("u", "v", "label")
    fans = {r.node: r.fan for r in walks.node_table(edges).collect()}
    assert fans[0] > 50 and sum(fans.values()) <= walks.FAN + len(fans)
    a, b = (sorted(map(tuple, walks.walk_tokens(walks.random_walks(edges, 300, 9, 3, n)).collect())) for n in (10**6, 0))
    assert a == b


def test_both_ways_of_walking_agree(spark):
    edges = edge_frame(spark, [(i % 5, (i * 3) % 7, i % 3 - 1) for i in range(40)])
    a, b = (sorted(map(tuple, walks.walk_tokens(walks.random_walks(edges, 30, 6, 1, n)).collect())) for n in (10**6, 0))
    assert a == b


@pytest.mark.parametrize("labels, counts, weights", [
    ([0, 0, 1, 1, 1, 2], [2, 3, 1], [1.0, 2 / 3, 2.0]), ([0, 0, 1, 1, 1], [2, 3, 0], [5 / 6, 5 / 9, 1.0]), ([1, 1, 1, 1], [0, 4, 0], [1.0, 1 / 3, 1.0]),
    ([0, -1, 1, -1, 1, 2], [1, 2, 1], [4 / 3, 2 / 3, 4 / 3]), ([-1], [0, 0, 0], [1.0, 1.0, 1.0]),
])
def test_class_weights(spark, labels, counts, weights):
    rows = metrics.class_weights(profile.dense_counts(spark.createDataFrame([(x,) for x in labels], "label int"), 3)).orderBy("class_id").collect()
    assert [r.n for r in rows] == counts
    assert [r.weight for r in rows] == pytest.approx(weights)


@pytest.mark.parametrize("matrix, recall", [([[50, 30, 20], [25, 45, 30], [15, 35, 50]], 0.483333), ([[80, 15, 5], [10, 75, 15], [5, 10, 85]], 0.8)])
def test_confusion(spark, matrix, recall):
    pairs = [(t, p) for t, row in enumerate(matrix) for p, n in enumerate(row) for _ in range(n)]
    m = metrics.confusion(spark.createDataFrame(pairs, "target int, prediction int"), 3)
    assert {(r["true"], r["pred"]): r.n for r in m.collect()} == {(t, p): n for t, row in enumerate(matrix) for p, n in enumerate(row)}
    assert metrics.macro_scores(m).collect()[0].accuracy == pytest.approx(recall, abs=1e-5)
    assert all(r.share == pytest.approx(r.n / 100) for r in metrics.normalized(m).collect())


def test_auroc_with_ties_by_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(y), [float(s), float(1 - s)]) for y, s in zip(rng.integers(0, 2, 80), rng.integers(0, 6, 80) / 6, strict=True)]
    got = {r.class_id: r.auroc for r in metrics.auroc(metrics.one_vs_rest(spark.createDataFrame(rows, "target int, probabilities array<double>"))).collect()}
    for c in (0, 1):
        pos, neg = [s[c] for y, s in rows if y == c], [s[c] for y, s in rows if y != c]
        assert got[c] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))


def test_edge_text(spark):
    lines = spark.createDataFrame([("% 1 2 3",), ("1 2 -1 9 8",), ("4\t5\t1",), ("6 7",), ("",)], "value string")
    assert sorted(map(tuple, src.parse_edges(lines).collect())) == [(1, 2, -1), (4, 5, 1)]
    commas = spark.createDataFrame([("1,2,3,1.5",), ("1,2",)], "value string")
    assert list(map(tuple, src.parse_edges(commas, ",", None).collect())) == [(1, 2, 3)]
    with pytest.raises(ValueError):
        src.get_loader("nothing")


def test_toy_graph(spark):
    rows = src.toy_graph(spark).collect()
    assert len(rows) == 100 and {r.label for r in rows} <= {-1, 0, 1}
    path = sorted((r.place, r.u, r.v) for r in rows)[:29]
    assert [(u, v) for _, u, v in path] == [(i, i + 1) for i in range(1, 30)]
    later = [(r.u, r.v, r.label) for r in rows if r.place >= 30]
    assert len(set(later)) == len(later) == 71 and all(u != v for u, v, _ in later)


def test_combos(spark):
    got = {r.combo: (r.nhead, r.emb) for r in trials.decode_combos(spark.createDataFrame([(i,) for i in (19, 20, 21, 22, 27, -1)], "combo long")).collect()}
    assert got == {19: (8, 16), 20: (8, 32), 21: (8, 64), 22: (8, 128), 27: (None, None), -1: (None, None)}


def test_forward_ignores_hidden_positions():
    cfg = Config()
    enc = transformer.random_encoder(cfg, 3)
    x = np.random.default_rng(0).normal(size=(2, 7, cfg.model.embedding_dim))
    attn = np.ones((2, 7))
    attn[:, 5] = 0
    a = transformer.forward(enc, x, attn)
    x[:, 5] += 10
    b = transformer.forward(enc, x, attn)
    assert a.shape == (2, 7, 3)
    assert np.allclose(np.delete(a, 5, 1), np.delete(b, 5, 1))


def test_targets_are_masked_and_attended(spark, tiny):
    p = from_edges(src.copurchase(spark, tiny), Config().override("dataset.num_walks=50", "dataset.max_walk_length=4"))
    for r in profile.targets_attended(p.views()).collect():
        assert r.walks == r.all_attended == r.all_masked


def test_paths_with_splits_are_encoded_like_tokens(spark):
    """Copies of a triple in several splits, a sink, and both ways of walking; a task never gets all nodes for want of a key."""
    edges = edge_frame(spark, [(i % 5, (i * 3) % 7, i % 2) for i in range(60)])
    split = splits.split_edges(edges, Dataset())
    for limit in (10**6, 0):
        paths = checkpointed(walks.random_walks(split, 30, 6, 1, limit))
        tokens = walks.walk_tokens(paths)
        words = vocab.vocabulary(tokens, edges)
        classes = vocab.class_map(words)
        want = encode.encode_walks(tokens, words, splits.split_lookup(split))
        got = encode.encode_paths(paths, words, classes)
        cells = lambda rows: sorted(tuple(map(int, r)) for r in rows.select("walk_id", "pos", "token_id", "split_id").collect())
        assert cells(got) == cells(want)


def test_steps_along_plain_rows_equal_those_on_blocks(spark, monkeypatch):
    """Copies, a hub that most edges lead to, and sinks; walks read the plain rows, and no edge is shuffled for a step."""
    rows = [(i, 0, 1) for i in range(1, 400)] + [(0, i, 0) for i in range(1, 150)] + [(0, 3, 0)] * 3 + [(i, 1000 + i % 3, i % 2) for i in range(1, 60)]
    edges = edge_frame(spark, rows).select("u", "v", "label")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found, made = [], []
    for kind, step_of, block in ((walks.FiledEdges, walks.step_on, walks.BLOCK), (walks.EdgeRows, walks.step_along, 1)):
        nodes = walks.node_table(edges, block)
        filed = kind(edges, nodes)
        begun = spark.range(500).select(F.col("id").alias("walk_id"), (F.col("id") % 400).alias("node"))
        cur = checkpointed(begun.join(nodes, "node").select("walk_id", "node", "deg", "fan", walks.no_path(edges).alias("path")))
        for step in (1, 2, 3, 4):
            cur = step_of(cur, filed.rows(), step, 1)
        found.append(sorted((r.walk_id, r.node, r.deg, tuple(map(tuple, r.path))) for r in cur.collect()))
        copies = filed.rows().where("u = 0").agg(F.max("copy")).first()[0]
        if kind is walks.EdgeRows:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            plan = walks.step_along(checkpointed(cur), filed.rows(), 5, 1)._jdf.queryExecution().executedPlan().toString()
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
            assert plan.count("Exchange") == 1 and "array" not in dict(filed.rows().dtypes)["v"] and copies > 0
        filed.drop()
    assert found[0] == found[1]
    monkeypatch.setattr(walks, "FiledEdges", None)
    kind = walks.EdgeRows
    monkeypatch.setattr(walks, "EdgeRows", lambda *a: made.append(1) or kind(*a))
    walks.random_walks(edges, 30, 3, 1, 0).count()
    assert made


def test_nodes_are_counted_by_one_aggregation(spark):
    edges = edge_frame(spark, [(1, 2, 0), (1, 2, 0), (2, 3, 1), (3, 3, 1)]).select("u", "v", "label")
    nodes = walks.node_table(edges)
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan
    assert {r.node: r.deg for r in nodes.collect()} == {1: 2, 2: 1, 3: 1}


def test_a_step_reads_one_row_for_each_block(spark):
    edges = edge_frame(spark, [(1, i % 90, 0) for i in range(200)] + [(2, 1, 1)] * 3).select("u", "v", "label")
    filed = walks.FiledEdges(edges, walks.node_table(edges))
    rows = {(r.u, r.block): r.v for r in filed.rows().where("copy = 0").collect()}
    assert {k: len(v) for k, v in rows.items()} == {(1, 0): 64, (1, 1): 64, (1, 2): 64, (1, 3): 8, (2, 0): 3}
    assert sum((rows[1, i] for i in range(4)), []) == sorted(i % 90 for i in range(200))
    filed.drop()


@pytest.mark.parametrize("text, joins", [("N_1 E_0 N_2 E_1 N_3", 0), ("N_1 E_0 N_2", 2)])
def test_edges_are_not_shuffled_for_tokens_that_few_names_lack(spark, monkeypatch, text, joins):
    """Edges meet the unseen names by broadcasts, or not at all; ids stay in the order of first meeting."""
    held, rank = [], vocab.rank_by_range
    monkeypatch.setattr(vocab, "rank_by_range", lambda df, order: held.append(df) or rank(df, order))
    edges = edge_frame(spark, [(1, 2, 0), (2, 3, 1), (1, 3, 1)])
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    words = vocab.vocabulary(token_frame(spark, text), edges)
    plan = held[0]._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == joins
    want = ["<PAD>", "<MASK>", "<UNK>", *text.split(), *(["N_3", "E_1"] if joins else [])]
    assert [r.token for r in words.orderBy("token_id").collect()] == want


@pytest.mark.parametrize("least", [walks.BLOCK, 2])
def test_edges_are_shuffled_once_to_be_filed_by_node(spark, monkeypatch, least):
    """Copies in several splits, null ends, a hub, a sink that most edges lead to; with few or with most nodes held apart."""
    rows = [(i, 0, 1) for i in range(1, 300)] + [(0, i, 0) for i in range(1, 90)] + [(0, 3, 0)] * 3 + [(i, 1000, i % 2) for i in range(1, 200)] * 2 + [(7, None, 1), (None, 7, 1), (-5, -6, 0), (-6, -5, 1)]
    edges = edge_frame(spark, rows).select("u", "v", "label", (F.abs(F.hash("edge_key")) % 4).alias("split_id"))
    monkeypatch.setattr(walks, "BLOCK", least)
    wide = {r.node: (r.deg, r.fan) for r in walks.wide_nodes(edges, len(rows)).collect()}
    assert {0, 1000} <= set(wide) and wide[1000][0] == 0 and wide[0][0] == 92 and (least > 2) == (len(wide) == 2)
    filed = walks.NodeRows(edges.where("u <> 0"))
    held = {r.u: list(zip(r.v, r.label, r.split_id)) for r in filed.rows().collect()}
    want = {r.u: [tuple(x) for x in r.out] for r in walks.adjacency(edges.where("u <> 0")).collect()}
    filed.drop()
    assert held == want
    a, b = (sorted((r.walk_id, r.start, tuple(map(tuple, r.path))) for r in walks.random_walks(edges.where("u is not null and v is not null"), 0, 9, 3, n, 2).collect()) for n in (10**6, 0))
    assert a == b and len(a) == 2 * len(want) + 2


def test_splits_by_written_draws(spark):
    """Draws that are read from a column give the same splits, and the column isn't in the result."""
    edges = edge_frame(spark, [(i % 9, i % 7, i % 2) for i in range(200)])
    cells = lambda rows: sorted(map(tuple, rows.select(*edges.columns, "split_id").collect()))
    got = splits.split_edges(edges.withColumn("_drawn", splits.edge_draw(Dataset())), Dataset(), "_drawn")
    assert "_drawn" not in got.columns and cells(got) == cells(splits.split_edges(edges, Dataset()))


def test_tasks_are_counted_by_rows(spark, tiny, monkeypatch):
    """More rows make more tasks, not larger ones, for lines and steps; pads are dealt to all tasks."""
    from edgewalk import ranking

    monkeypatch.setattr(ranking, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{tiny}/lineitem.parquet").count()
    assert src.copurchase(spark, tiny).rdd.getNumPartitions() == -(-lines // 500)
    steps = spark.range(100).selectExpr("id as walk_id", "0 as pos", "'N_1' as token").crossJoin(spark.range(30).select("id")).drop("id")
    assert encode.with_context(steps).rdd.getNumPartitions() == 6
    walks_of = spark.range(50).selectExpr("id as walk_id", "0 as pos", "3L as token_id", "-1 as split_id")
    pads = encode.padded(walks_of, 5).where("pos > 0")
    assert pads.count() == 200 and pads.select(F.spark_partition_id()).distinct().count() == 4


def test_broadcast_walks_are_taken_in_one_pass(spark, monkeypatch):
    """More edges than were broadcast before, in some ranges; no join for a step; paths equal those that are joined step by step."""
    assert walks.BROADCAST_EDGES >= 27_000_000
    rows = [(i, 0, 1) for i in range(1, 300)] + [(0, i, 0) for i in range(1, 90)] + [(0, 3, 0)] * 3 + [(i, 1 << 40, i % 2) for i in range(1, 200)] * 2 + [(-5, -6, 0), (-6, -5, 1)]
    edges = edge_frame(spark, rows).select("u", "v", "label", (F.abs(F.hash("edge_key")) % 4).alias("split_id"))
    monkeypatch.setattr(walks, "STEPS_AT_ONCE", 90)
    paths = walks.random_walks(edges, 0, 9, 3, walks_per_node=2)
    assert "Join" not in paths._jdf.queryExecution().executedPlan().toString()
    cells = lambda some: sorted((r.walk_id, r.start, tuple(map(tuple, r.path))) for r in some.collect())
    joined = walks.random_walks(edges, 0, 9, 3, 0, 2)
    assert cells(paths) == cells(joined) and paths.dtypes == joined.dtypes
    nodes, begin, held = walks.coded_adjacency(edges, walks.Codes.of(edges))
    assert nodes.tolist() == sorted({u for u, _, _ in rows}) and begin[-1] == len(rows) and held["label"].dtype == np.uint8
    monkeypatch.setattr(walks, "BROADCAST_BYTES", 100)
    assert walks.Codes.of(edges) is None


def test_broadcast_walks_end_at_nulls(spark):
    """A null node ends a walk, and copies get their least split that isn't null."""
    kind = "u long, v long, label int, split_id int"
    edges = spark.createDataFrame([(1, 2, 0, None), (1, 2, 0, 3), (1, 2, 0, 2), (2, None, None, None), (None, 1, 1, 0)], kind)
    found = {(r.start, tuple(map(tuple, r.path))) for r in walks.random_walks(edges, 40, 5, 3).collect()}
    assert found == {(1, ((2, 0, 2), (None, None, None))), (2, ((None, None, None),)), (None, ())}


def test_draws_of_tasks_equal_those_of_columns(spark):
    from edgewalk import ranking

    numbers = [0, 7, 123456789012, -3]
    want = [[r[0] for r in spark.createDataFrame([(i,) for i in numbers], "n long").select(ranking.draw(42, F.col("n"), s)).collect()] for s in (1, 83)]
    assert [ranking.draws_of(42, np.array(numbers), s).tolist() for s in (1, 83)] == want


def test_steps_stay_where_their_walk_is(spark, monkeypatch):
    """Few nodes are broadcast and no step is shuffled; more nodes give the same rows by a shuffle."""
    split = splits.split_edges(edge_frame(spark, [(i % 5, (i * 3) % 7, i % 2) for i in range(60)]), Dataset())
    paths = checkpointed(walks.random_walks(split, 30, 6, 1))
    words = checkpointed(vocab.vocabulary(walks.walk_tokens(paths), split))
    classes = checkpointed(vocab.class_map(words))
    found = []
    for most, shuffles in ((1 << 21, 0), (3, 2)):
        monkeypatch.setattr(encode, "BROADCAST_NODES", most)
        rows = encode.encode_paths(paths, words, classes)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") >= shuffles and (shuffles > 0 or "Exchange hashpartitioning" not in plan)
        found.append(sorted(tuple(r) for r in rows.select("walk_id", "pos", "token_id", "split_id").collect()))
    assert found[0] == found[1]
