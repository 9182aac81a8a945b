"""Exact multiclass metrics over scored rows.

Scored rows have an id, target (class, or -1: ignored) and scores (an array, one for each class). Rows are reduced to
counts by class or by distinct score first. Scores of large tables are nearly all distinct, so sums along a class's scores
are taken by ranges of scores, many tasks to a class. Metrics may be grouped by further columns (``by``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ids import IGNORED
from ..ranking import running_sums


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """The first of the greatest."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def predictions(scored: DataFrame) -> DataFrame:
    """``scored`` with prediction and probabilities."""
    return scored.withColumn("probabilities", softmax(F.col("scores"))).withColumn("prediction", argmax(F.col("scores")))


def class_weights(counts: DataFrame) -> DataFrame:
    """n / (C * count), 1 for unseen classes; 1 for all if nothing is labelled. ``counts`` has class_id and n."""
    total = counts.agg(F.sum("n").alias("n_all"), F.count("*").alias("c"))
    return counts.crossJoin(F.broadcast(total)).select("class_id", "n", F.when(F.col("n") > 0, F.col("n_all") / (F.col("c") * F.col("n"))).otherwise(1.0).alias("weight"))


def present_class_weights(labels: DataFrame, ignored: int = -100, label: str = "label") -> DataFrame:
    """n / (classes that occur * count), for those classes only."""
    counts = labels.where(F.col(label) != ignored).groupBy(F.col(label).alias("class_id")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n_all"), F.count("*").alias("c"))
    return counts.crossJoin(F.broadcast(total)).select("class_id", "n", (F.col("n_all") / (F.col("c") * F.col("n"))).alias("weight"))


def cross_entropy(predicted: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Mean negative log probability of the target over labelled rows, weighted by the target's class if asked."""
    valid = predicted.where(F.col("target") != IGNORED)
    nll = -F.ln(F.get("probabilities", F.col("target").cast("int")))
    if weights is None:
        return valid.agg(F.avg(nll).alias("loss"), F.count("*").alias("n"))
    joined = valid.join(F.broadcast(weights.select(F.col("class_id").alias("target"), "weight")), "target")
    return joined.agg((F.sum(F.col("weight") * nll) / F.sum("weight")).alias("loss"), F.count("*").alias("n"))


def confusion(predicted: DataFrame, classes: int, true: str = "target", pred: str = "prediction") -> DataFrame:
    """(true, pred, n) for all pairs of classes."""
    spark = predicted.sparkSession
    counts = predicted.where(F.col(true) != IGNORED).groupBy(F.col(true).cast("bigint").alias("true"), F.col(pred).cast("bigint").alias("pred")).agg(F.count("*").alias("n"))
    cells = spark.range(classes * classes).select(F.floor(F.col("id") / classes).alias("true"), (F.col("id") % classes).alias("pred"))
    return F.broadcast(cells).join(counts, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def normalized(matrix: DataFrame) -> DataFrame:
    """Shares of each true class; null where it has no rows."""
    row = Window.partitionBy("true")
    return matrix.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(row)))


def class_scores(matrix: DataFrame) -> DataFrame:
    """tp, fp, fn, recall and f1 of every class that occurs as target or prediction."""
    hit = F.col("true") == F.col("pred")
    by_true = matrix.groupBy(F.col("true").alias("class_id")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fn"))
    by_pred = matrix.groupBy(F.col("pred").alias("class_id")).agg(F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return by_true.join(by_pred, "class_id").where(tp + fp + fn > 0).select("class_id", "tp", "fp", "fn", F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0)).alias("recall"), (2.0 * tp / (2 * tp + fp + fn)).alias("f1"))


def macro_scores(matrix: DataFrame) -> DataFrame:
    """Accuracy (mean recall) and F1 over classes that occur."""
    return class_scores(matrix).agg(F.avg("recall").alias("accuracy"), F.avg("f1").alias("f1"), F.count("*").alias("classes"))


def one_vs_rest(predicted: DataFrame, column: str = "probabilities", by: tuple[str, ...] = ()) -> DataFrame:
    """(class_id, score, pos, neg): counts of rows with that score of the class, by whether it is the target."""
    valid = predicted.where(F.col("target") != IGNORED)
    each = valid.select(*by, "target", F.posexplode(column).alias("class_id", "score"))
    own = (F.col("target") == F.col("class_id")).cast("int")
    return each.groupBy(*by, F.col("class_id").cast("bigint").alias("class_id"), "score").agg(F.sum(own).alias("pos"), F.sum(1 - own).alias("neg"))


def roc_points(counts: DataFrame) -> DataFrame:
    """(class_id, score, pos, neg, tp, fp, tpr, fpr), a point for each distinct score, descending."""
    summed = running_sums(counts, ["class_id"], [F.desc("score")], {"pos": "tp", "neg": "fp"})
    return summed.select("class_id", "score", "pos", "neg", "tp", "fp", F.try_divide(F.col("tp").cast("double"), "tp_all").alias("tpr"), F.try_divide(F.col("fp").cast("double"), "fp_all").alias("fpr"))


def trapezoid(points: DataFrame) -> DataFrame:
    """The area under each class's points, from (0, 0); a point's predecessor is its own counts less."""
    totals = points.groupBy("class_id").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("neg") * (2.0 * F.col("tp") - F.col("pos")) / 2).alias("a"))
    return totals.select("class_id", F.try_divide(F.col("a"), F.col("p").cast("double") * F.col("n")).alias("area"))


def auroc(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact area for each class by ranks with ties at their mean; null without positives or without negatives."""
    below = running_sums(counts, [*by, "class_id"], [F.col("score")], {"neg": "upto"})
    wins = below.withColumn("wins", F.col("pos") * (F.col("upto") - F.col("neg") / 2.0))
    sums = wins.groupBy(*by, "class_id").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("wins").alias("wins"))
    return sums.select(*by, "class_id", "positives", "negatives", F.try_divide(F.col("wins"), F.col("positives").cast("double") * F.col("negatives")).alias("auroc"))


def macro_auroc(counts: DataFrame) -> DataFrame:
    """Mean over classes that have an area."""
    return auroc(counts).agg(F.avg("auroc").alias("auroc"), F.count("auroc").alias("classes"))


#: Columns of a metric state beside its groups. ``kind`` tells what a row counts: "loss" rows have the number of labelled
#: rows in n1 and the summed loss in total, "class" rows a class's tp, fn and fp, "score" rows a class's score with the rows
#: that are of the class and those that aren't.
STATE = ("kind", "class_id", "score", "n1", "n2", "n3", "total")


def metric_state(predicted: DataFrame, by: tuple[str, ...] = ("stage", "epoch")) -> DataFrame:
    """What ``state_metrics`` needs of some rows: counts and sums that add up, so no row is scored again.

    It has the columns ``by`` and ``STATE``. Its size follows classes and distinct scores. Rows without a label add nothing.
    """
    valid = predicted.where(F.col("target") != IGNORED)
    nothing = {"class_id": "bigint", "score": "double", "n1": "bigint", "n2": "bigint", "n3": "bigint", "total": "double"}

    def part(kind: str, rows: DataFrame, **columns: Column) -> DataFrame:
        filled = [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in nothing.items()]
        return rows.select(*by, F.lit(kind).alias("kind"), *filled)

    nll = -F.ln(F.get("probabilities", F.col("target").cast("int")))
    loss = valid.groupBy(*by).agg(F.count("*").alias("n"), F.sum(nll).alias("nll"))
    hit = (F.col("target") == F.col("prediction")).cast("int")
    sides = F.array(F.struct(F.col("target").cast("bigint").alias("class_id"), hit.alias("tp"), (1 - hit).alias("fn"), F.lit(0).alias("fp")), F.struct(F.col("prediction").cast("bigint").alias("class_id"), F.lit(0).alias("tp"), F.lit(0).alias("fn"), (1 - hit).alias("fp")))
    counts = valid.select(*by, F.explode(sides).alias("s")).groupBy(*by, "s.class_id").agg(*(F.sum(f"s.{c}").alias(c) for c in ("tp", "fn", "fp"))).where("tp + fn + fp > 0")
    scores = one_vs_rest(valid, by=by)
    return (
        part("loss", loss, n1=F.col("n"), total=F.col("nll"))
        .unionByName(part("class", counts, class_id=F.col("class_id"), n1=F.col("tp"), n2=F.col("fn"), n3=F.col("fp")))
        .unionByName(part("score", scores, class_id=F.col("class_id"), score=F.col("score"), n1=F.col("pos"), n2=F.col("neg")))
    )


def merged(states: DataFrame, by: tuple[str, ...] = ("stage", "epoch")) -> DataFrame:
    """One state of the rows of many, in any order; columns that ``by`` leaves out, like a batch's number, are summed over."""
    return states.groupBy(*by, "kind", "class_id", "score").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "total"))).select(*by, *STATE)


def state_metrics(state: DataFrame, by: tuple[str, ...] = ("stage", "epoch")) -> DataFrame:
    """n, loss, accuracy (mean recall), f1 (both over classes that occur) and auroc of each group of one state."""
    loss = state.where("kind = 'loss'").select(*by, F.col("n1").alias("n"), (F.col("total") / F.col("n1")).alias("loss"))
    counts = state.where("kind = 'class'")
    tp, fn, fp = F.col("n1"), F.col("n2"), F.col("n3")
    recall = F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
    macro = counts.groupBy(*by).agg(F.avg(recall).alias("accuracy"), F.avg(2.0 * tp / (2 * tp + fp + fn)).alias("f1"))
    scores = state.where("kind = 'score'").select(*by, "class_id", "score", F.col("n1").alias("pos"), F.col("n2").alias("neg"))
    areas = auroc(scores, by).groupBy(*by).agg(F.avg("auroc").alias("auroc"))
    return loss.join(macro, [*by]).join(areas, [*by]).select(*by, "n", "loss", "accuracy", "f1", "auroc")


def stage_metrics(predicted: DataFrame, by: tuple[str, ...] = ("stage", "epoch")) -> DataFrame:
    """The metrics of each stage and epoch. A group without labelled rows is left out, as a batch without labels has no loss."""
    return state_metrics(metric_state(predicted, by), by)


def step_table(predicted: DataFrame, by: tuple[str, ...] = ("stage", "epoch", "batch_id")) -> DataFrame:
    """A row for each batch: rows, labelled, loss (null without labels) and whether it is skipped."""
    labelled = F.col("target") != IGNORED
    nll = F.when(labelled, -F.ln(F.get("probabilities", F.greatest(F.col("target"), F.lit(0)).cast("int"))))
    return predicted.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(labelled).alias("labelled"), F.avg(nll).alias("loss")).withColumn("skipped", F.col("labelled") == 0)


def positional_encoding(spark, length: int, dim: int) -> DataFrame:
    """(pos, i, value): sines in even, cosines in odd columns."""
    if dim % 2:
        raise ValueError("dim must be even")
    grid = spark.range(length).select(F.col("id").alias("pos")).crossJoin(F.broadcast(spark.range(dim).select(F.col("id").alias("i"))))
    angle = F.col("pos") * F.exp(-(F.col("i") - F.col("i") % 2) * (F.log(F.lit(10000.0)) / dim))
    return grid.select("pos", "i", F.when(F.col("i") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("value"))
