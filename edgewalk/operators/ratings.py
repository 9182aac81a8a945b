"""Ratings: profiles and binary labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def positive_labels(ratings: DataFrame, rating: str = "rating") -> DataFrame:
    return ratings.withColumn("binary_rating", (F.col(rating) > 0).cast("int"))


def dominant_rating(ratings: DataFrame, rating: str = "rating") -> DataFrame:
    """One row: the most frequent rating (the smallest among equals), its count, and the count of all."""
    counts = ratings.groupBy(rating).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(rating, F.struct(F.col("n"), -F.col(rating))).alias("dominant"), F.max("n").alias("n_dominant"), F.sum("n").alias("n_all"))


def dominant_labels(ratings: DataFrame, rating: str = "rating") -> DataFrame:
    """1 for rows with the most frequent rating, else 0; the rating is one broadcast row."""
    top = dominant_rating(ratings, rating).select("dominant")
    return ratings.crossJoin(F.broadcast(top)).withColumn("binary_rating", (F.col(rating) == F.col("dominant")).cast("int")).drop("dominant")


def rating_profile(ratings: DataFrame, rating: str = "rating") -> DataFrame:
    r = F.col(rating)
    return ratings.agg(F.count("*").alias("n"), F.min(r).alias("least"), F.max(r).alias("most"), F.count_if(r > 0).alias("n_positive"), F.count_if(r <= 0).alias("n_other"))


def dominant_profile(ratings: DataFrame, rating: str = "rating") -> DataFrame:
    """Every rating's count, its share of all in percent, and whether it is the dominant one."""
    counts = ratings.groupBy(rating).agg(F.count("*").alias("n"))
    top = dominant_rating(ratings, rating)
    return counts.crossJoin(F.broadcast(top)).select(F.col(rating).alias("rating"), "n", (100.0 * F.col("n") / F.col("n_all")).alias("percent"), (F.col(rating) == F.col("dominant")).alias("is_dominant"))
