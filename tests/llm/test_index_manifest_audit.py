"""Nearest neighbours, the Merkle manifest and the filter audit against plain versions, brute force and SQL."""

import collections
import itertools
import math
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewalk.llm import audit, manifest, neighbours
from edgewalk.llm import queries as q


def duck(**frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    return con


def rows_of(frame):
    columns = sorted(frame.columns)
    clean = lambda v: None if v is None or v != v else v
    return sorted((tuple(map(clean, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


# Nearest neighbours.


def made_vectors(n=3000, d=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 3] = rng.normal(size=d) + 0.05 * rng.normal(size=(n // 3, d))  # a crowd
    x[n // 3 : n // 3 + 40] = x[0]  # equal vectors
    return x


def exact(x, ids, query, allowed=None):
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    near = unit @ unit[query]
    fit = (ids != ids[query]) & (np.ones(len(x), bool) if allowed is None else allowed)
    return sorted(((-round(s, 12), i) for s, i in zip(near[fit].tolist(), ids[fit].tolist(), strict=True)))[: neighbours.TOP]


def test_recall_against_brute_force_with_a_crowd_and_ties(spark):
    x = made_vectors()
    frame = spark.createDataFrame([(i, v.tolist(), 7) for i, v in enumerate(x)], "vec_id long, embedding array<double>, code int").repartition(7)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    ids, hits = np.arange(len(x)), 0
    assert set(got) == set(range(0, len(x), 50))
    for query, found in got.items():
        want = exact(x, ids, query)
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        assert [(-round(s, 12), i) for _, s, i in found] == sorted((-round(s, 12), i) for _, s, i in found)
        hits += len({i for _, i in want} & {i for _, _, i in found})
    assert hits / (5 * len(got)) >= 0.95
    assert [i for _, _, i in got[1000]] == [0, 1001, 1002, 1003, 1004]  # 1000 to 1039 equal row 0


@pytest.mark.parametrize("radius", [3, 14, 27])
def test_probing_meets_every_code_within_the_radius(spark, radius):
    x = made_vectors(1500, 16, 2)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows, n = neighbours.sound(frame)
    coder = neighbours.fit_coder(x)
    codes = coder.codes(x / np.sqrt((x * x).sum(1))[:, None])
    coded = neighbours.coded(rows, coder).cache()
    asked = coded.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("ask"), "vector", "code")
    got = {r.query_id: [(round(t.less, 12), t.vec_id) for t in r.top] for r in neighbours.search(coded, asked, n, radius).collect()}
    for query in range(0, len(x), 50):
        want = exact(x, np.arange(len(x)), query, np.bitwise_count(codes ^ codes[query]) <= radius)
        assert got.get(query, []) == want


def test_pigeonhole_bounds_cover_every_split_of_the_radius():
    for radius in range(64):
        bounds = neighbours.bounds_of(radius)
        assert sum(b + 1 for b in bounds) == radius + 1 or radius < neighbours.TABLES - 1
        assert sum(b + 1 for b in bounds if b >= 0) > radius


def test_unsound_vectors_take_no_part_and_few_candidates_are_all_returned(spark):
    rows = [(0, [1.0, 0.0], "a"), (50, [1.0, 0.0], "b"), (50, [1.0, 0.0], "b"), (1, [-1.0, 0.5], "c"), (2, None, "d"), (3, [0.0, 0.0], "e"), (4, [float("nan"), 1.0], "f"), (5, [float("inf"), 1.0], "g"), (6, [1.0], "h"), (7, [None, 1.0], "i"), (None, [1.0, 1.0], "j"), (100, [1e200, 1e200], "k")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, role string")
    got = [tuple(r) for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    half = math.sqrt(0.5)
    close = [(a, b, c, round(d, 9)) for a, b, c, d in got]
    low = round(-1 / math.sqrt(1.25), 9)
    assert close == [
        (0, 1, 50, 1.0), (0, 2, 50, 1.0), (0, 3, 100, round(half, 9)), (0, 4, 1, low),
        (50, 1, 0, 1.0), (50, 2, 100, round(half, 9)), (50, 3, 1, low),
        (100, 1, 0, round(half, 9)), (100, 2, 50, round(half, 9)), (100, 3, 50, round(half, 9)), (100, 4, 1, round(-0.5 * half / math.sqrt(1.25), 9)),
    ]
    assert neighbours.nearest(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 3 or vec_id = 2"), F.lit(True)).count() == 0


# The Merkle manifest.


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_paths(leaves):
    """The root and each leaf's path in the tree of runs of two."""
    paths, level, at = ["" for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            paths[i] += "-" if other >= len(level) else ("L" if k & 1 else "R") + level[other]
        level = [digest(*level[k : k + 2]) for k in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 5, 31, 32, 33, 64, 65, 100, 777, 1024])
def test_traversal_emits_the_paths_of_the_plain_tree(n):
    leaves = [digest(str(i)) for i in range(n)]
    root, paths = plain_paths(leaves)
    height = manifest.height_of(n)
    assert manifest.block_root(leaves, height) == root
    assert list(manifest.traversed(leaves, height)) == paths
    assert all(manifest.folded(x, p) == root for x, p in zip(leaves, paths, strict=True))


def test_traversal_holds_few_nodes(monkeypatch):
    most, made = [0], manifest.Subtree.grow

    def grow(self, leaves):
        made(self, leaves)
        most[0] = max(most[0], len(self.nodes) + len(self.open))

    monkeypatch.setattr(manifest.Subtree, "grow", grow)
    assert len(list(manifest.traversed([digest(str(i)) for i in range(1024)], 10))) == 1024
    assert most[0] <= 2 ** (manifest.STEP + 1) + 10


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda i, s, lang, n, t: digest(*map(plain_field, (i, s, lang, n, t)))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r, leaf(*r)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[lang] = plain_paths([h for _, h in groups[lang]])
    root, uppers = plain_paths([trees[lang][0] for lang in langs])
    out = []
    for lang, upper in zip(langs, uppers, strict=True):
        for (r, h), path in zip(groups[lang], trees[lang][1], strict=True):
            i, s, _, n, t = r
            tried = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
            fold = manifest.folded(leaf(i, s, lang, n + 1, t) if tried else h, path + upper)
            out.append((i, h, trees[lang][0], root, manifest.proof_digest(path + upper), fold, fold == root))
    return sorted(out, key=repr)


def test_manifest_of_several_blocks_nulls_and_repeats_against_a_plain_tree(spark):
    rows = [(i, f"s{i % 3}", "big", i % 9, f"text {i} é") for i in range(3000)]
    rows += [(1, None, None, None, None), (None, "s", None, 4, "a"), (None, "s", None, 4, "a"), (7, "s", "", 2**62, ""), (7, "s", "", 2**62, ""), (7, "s", "", 1, "other"), (8, "s", "Z", None, "x" * 200_000), (9, "s", "é", 3, "|-|"), (10, "s", "z", 5, "t")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place string").repartition(5)
    got = sorted((tuple(r) for r in manifest.manifest(frame).collect()), key=repr)
    want = plain_manifest(rows)
    assert got == want
    assert {v for *_, v in got} == {True, False}
    assert manifest.manifest(frame.where("false")).count() == 0


def test_manifest_equals_its_sql(spark, tiny):
    want = duckdb.connect().execute(f"create view documents as select * from '{tiny}/documents.parquet'").execute(q.MERKLE).df()
    assert rows_of(q.op12_merkle_manifest(spark, tiny).toPandas()) == rows_of(want)


# The filter audit.


def test_first_failures():
    table = audit.first_failure()
    assert table.shape == (32, 120) and len(set(audit.ORDERS)) == 120
    for mask, (o, order) in itertools.product(range(32), enumerate(audit.ORDERS)):
        steps = [k for k, f in enumerate(order) if mask >> audit.FILTERS.index(f) & 1]
        assert table[mask, o] == (steps[0] if steps else 5)


def audit_frames(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "a b c", long, long + " A" * 5, long + "#", ("same " * 300), "ABC " * 80, long.upper(), "x\x0by\x1cz q " * 120, "é" * 50 + " " + long, long]
    docs = [(i, t, ["s", None, "", "r"][i % 4], "m", 1) for i, t in enumerate(texts)]
    docs += [(11, long, "s", "m", 1), (None, long, "r", "m", 1), (None, "lone", None, "m", 1)] + [(100 + i, "hot copy " * 150, "s", "m", 1) for i in range(40)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 130, 3)] + [(None, 1, 1), (3, 1, 1), (3, 0, None), (6, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, mask string, n int").repartition(4)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_of_odd_rows_equals_its_sql(spark):
    docs, labels = audit_frames(spark)
    got = audit.audit_filters(docs, labels)
    want = duck(documents=docs.toPandas().astype({"doc_id": "Int64"}), labels=labels.toPandas().astype("Int64")).execute(q.FILTER_AUDIT).df()
    assert rows_of(got.toPandas()) == rows_of(want)
    assert got.count() == 3 * 600
    assert audit.audit_filters(docs.where("false"), labels).count() == 0
    assert audit.audit_filters(docs, labels.where("false")).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_audit_equals_its_sql(spark, tiny):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    assert rows_of(q.op13_filter_audit(spark, tiny).toPandas()) == rows_of(con.execute(q.FILTER_AUDIT).df())


def test_hot_and_rare_copies_are_found(spark):
    rows = [(i, b"hot" if i % 3 == 0 else str(i // 4).encode(), 0) for i in range(9000)] + [(None, b"hot", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, digest binary, mask int")
    got = {(r.doc_id, bytes(r.digest)): r.mask for r in audit.with_copies(frame).collect()}
    least = {}
    for i, h, _ in rows:
        if i is not None:
            least[h] = min(least.get(h, i), i)
    assert got == {(i, h): 16 * (i is not None and i > least[h]) for i, h, _ in rows}
