"""The preparation of a graph: edges, splits, walks, vocabulary, encoded walks, stage views."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..ids import IGNORED, PAD_ID
from ..operators import encode, splits, vocab, walks
from ..ranking import stored
from ..sources.edges import get_loader


#: The column of written edges that has their draws.
DRAWN = "_drawn"


@dataclass
class Prepared:
    """Lazy tables of one configuration."""

    edges: DataFrame
    split: DataFrame
    walks: DataFrame
    tokens: DataFrame
    vocab: DataFrame
    classes: DataFrame
    encoded: DataFrame

    @cached_property
    def written(self) -> DataFrame:
        """``encoded``, written once for the views, which read it several times."""
        return stored(self.encoded)

    def view(self, stage: str, pad: bool = True) -> DataFrame:
        return encode.stage_view(encode.padded(self.written) if pad else self.written, self.classes, stage)

    def views(self, pad: bool = True) -> DataFrame:
        return encode.stage_views(encode.padded(self.written) if pad else self.written, self.classes)

    def meta(self) -> dict[str, int]:
        return {"vocab_size": self.vocab.count(), "num_classes": self.classes.count(), "pad_id": PAD_ID, "ignore_index": IGNORED}

    def batches(self, stage: str, batch_size: int, seed: int = 42) -> DataFrame:
        """Train in drawn order, the others in the walks' order."""
        return encode.batches(self.view(stage), batch_size, seed if stage == "train" else None)


def prepare(spark: SparkSession, path: str, cfg: Config | None = None) -> Prepared:
    """Build all tables from the dataset's loader; nothing runs but what the chosen table needs."""
    d = (cfg or Config()).dataset
    return from_edges(get_loader(d.name)(spark, d.path or path), cfg)


def from_edges(edges: DataFrame, cfg: Config | None = None) -> Prepared:
    """All tables of an edge list; what is read several times is written once: edges with their draws, splits, walks.

    Paths carry the least split of each edge's triple, so encoding needs no join of walks with edges.
    """
    d = (cfg or Config()).dataset
    drawn = stored(edges.withColumn(DRAWN, splits.edge_draw(d)))
    edges = drawn.drop(DRAWN)
    split = splits.split_edges(drawn, d, DRAWN)
    narrow = splits.split_edges(drawn.select("edge_key", "major", "minor", *splits.TRIPLE, DRAWN), d, DRAWN).select(*splits.TRIPLE, "split_id")
    walked = stored(edges.select(*splits.TRIPLE).join(narrow, splits.TRIPLE, "left") if d.dedup else narrow)
    paths = stored(walks.random_walks(walked, d.num_walks, d.max_walk_length, d.seed, walks_per_node=d.walks_per_node))
    tokens = walks.walk_tokens(paths)
    words = stored(vocab.vocabulary(tokens, edges))
    classes = vocab.class_map(words)
    return Prepared(edges, split, paths, tokens, words, classes, encode.encode_paths(paths, words, classes))


TABLES = ("edges", "split", "walks", "vocab", "classes", "encoded")


def input_state(spark: SparkSession, path: str) -> list:
    """Path, size and modification time of every file below ``path`` (a file, folder or glob), by any file system."""
    jvm, out = spark._jvm, []
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(top) or []:
        files = fs.listFiles(found.getPath(), True)
        while files.hasNext():
            f = files.next()
            out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def save(prepared: Prepared, base: str) -> bool:
    """Write the tables below a fresh folder and publish them as ``base`` by one rename; True if these are the ones there.

    The manifest, written last, has the settings' sizes and the rows of every table. Of two writers the one that renames
    first wins, and the other's tables are deleted. A folder that ``load`` finds torn is moved away and replaced. The file
    system must rename folders in one step.
    """
    spark, attempt = prepared.edges.sparkSession, uuid.uuid4().hex
    parent, _, name = base.rstrip("/").rpartition("/")
    fresh = f"{parent}/_{name}-{attempt}"
    for table in TABLES:
        writer = getattr(prepared, table).write
        (writer.partitionBy("split_id") if table == "split" else writer).parquet(f"{fresh}/{table}")
    rows = {table: spark.read.parquet(f"{fresh}/{table}").count() for table in TABLES}
    manifest = json.dumps({"attempt": attempt, "meta": prepared.meta(), "rows": rows})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{fresh}/manifest")
    (source, fs), (target, _) = _path(spark, fresh), _path(spark, base)
    if fs.exists(target) and load(spark, base) is None:
        fs.rename(target, _path(spark, f"{parent}/_{name}-torn-{attempt}")[0])
    if not fs.exists(target):
        fs.rename(source, target)
    # A rename onto a folder that has come meanwhile moves into it.
    fs.delete(_path(spark, f"{base}/_{name}-{attempt}")[0], True)
    won = (found := read_manifest(spark, base)) is not None and found["attempt"] == attempt
    if not won:
        fs.delete(source, True)
    return won


def read_manifest(spark: SparkSession, base: str) -> dict | None:
    path, fs = _path(spark, f"{base}/manifest")
    if not fs.exists(path):
        return None
    rows = spark.read.text(f"{base}/manifest").take(1)
    return json.loads(rows[0].value) if rows else None


def load(spark: SparkSession, base: str) -> Prepared | None:
    """The tables published as ``base``; None if there are none, or if one has other rows than the manifest says."""
    manifest = read_manifest(spark, base)
    if manifest is None:
        return None
    tables = {}
    for name in TABLES:
        path, fs = _path(spark, f"{base}/{name}")
        if not fs.exists(path):
            return None
        try:
            tables[name] = spark.read.parquet(f"{base}/{name}")
            whole = tables[name].count() == manifest["rows"][name]
        except (AnalysisException, SparkRuntimeException):
            return None
        if not whole:
            return None
    return Prepared(tokens=walks.walk_tokens(tables["walks"]), **tables)


def prepare_cached(spark: SparkSession, path: str, cfg: Config) -> Prepared:
    """Saved tables of these settings and these input files, or fresh ones, which are saved if the settings say so.

    The folder's name is a hash of the settings and of path, size and modification time of the input, so tables of
    another dataset, or of one that has changed, are never reused. A saved dataset is loaded without building anything;
    one that was torn is built again.
    """
    p = cfg.preprocess
    if not p.folder:
        return prepare(spark, path, cfg)
    base = f"{p.folder}/{cfg.digest(input_state(spark, cfg.dataset.path or path))}"
    if p.use_cache and (found := load(spark, base)):
        return found
    fresh = prepare(spark, path, cfg)
    if not p.save:
        return fresh
    save(fresh, base)
    return load(spark, base) or fresh
