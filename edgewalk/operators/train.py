"""A baseline for masked edges: multinomial logistic regression on the visible neighbouring edges of the walk."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ids import IGNORED, MASK_ID, STAGE_TARGETS
from . import metrics


def context_rows(view: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Targets of a view with one-hot classes of the edges before and behind, and whether those are hidden."""
    order = Window.partitionBy("walk_id").orderBy("pos")
    shown = view.join(F.broadcast(classes.select(F.col("token_id").alias("x"), "class_id")), "x", "left")
    near = shown.withColumn("before", F.lag("class_id", 2).over(order)).withColumn("behind", F.lead("class_id", 2).over(order)).withColumn("masked", F.coalesce(F.lag("x", 2).over(order) == MASK_ID, F.lit(False)))
    hot = lambda c: [(F.coalesce(F.col(c), F.lit(-1)) == k).cast("double") for k in range(n)]
    return near.where(F.col("label") != IGNORED).select("walk_id", "pos", F.col("label").alias("target"), array_to_vector(F.array(*hot("before"), *hot("behind"), F.col("masked").cast("double"))).alias("features"))


def context_baseline(prepared, iterations: int = 20, weighted: bool = False) -> DataFrame:
    """Fit on the train view; accuracy, F1, AUROC and loss of each stage, a row for each."""
    classes = prepared.classes
    n = classes.count()
    rows = {s: context_rows(prepared.view(s, pad=False), classes, n) for s in STAGE_TARGETS}
    fit = rows["train"]
    if weighted:
        from .profile import dense_counts

        fit = fit.join(F.broadcast(metrics.class_weights(dense_counts(fit, n, "target")).select(F.col("class_id").alias("target"), "weight")), "target")
    model = LogisticRegression(labelCol="target", featuresCol="features", maxIter=iterations, regParam=1e-4, family="multinomial", **({"weightCol": "weight"} if weighted else {})).fit(fit)
    out = None
    for stage, data in rows.items():
        scored = model.transform(data).select("target", vector_to_array("probability").alias("probabilities"), F.col("prediction").cast("int").alias("prediction"))
        one = metrics.macro_scores(metrics.confusion(scored, n)).crossJoin(metrics.macro_auroc(metrics.one_vs_rest(scored)).select("auroc")).crossJoin(metrics.cross_entropy(scored).select("loss")).withColumn("stage", F.lit(stage))
        out = one if out is None else out.unionByName(one)
    return out
