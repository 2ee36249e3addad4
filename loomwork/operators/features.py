"""Feature assembly for the rating models, and the boosted-tree model itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.scalars import category_flag, flag, list_length, noise_level, price_range
from loomwork.operators.relational import enriched, with_means

USER_FEATURES = ["review_count", "average_stars", "fans", "useful"]
BUSINESS_FEATURES = ["business_stars", "business_review_count"]
#: Attribute keys and the category of the extended features.
FLAGS = {"reservations": "RestaurantsReservations", "credit_card": "BusinessAcceptsCreditCards", "kids": "GoodForKids", "bike_parking": "BikeParking", "caters": "Caters"}
USER_COUNTS = ["funny", "cool", "n_friends", "compliment_hot", "compliment_note", "compliment_photos"]
PLACE = ["is_open", "reservations", "credit_card", "longitude", "latitude", "price", "restaurant", "kids", "noise"]
#: The 23 features of the extended model: ten of the user, eleven of the business, likes of the pair's tips, photos.
EXTENDED = [*USER_FEATURES, *USER_COUNTS, *BUSINESS_FEATURES, *PLACE, "tip_likes", "n_photos"]
CATEGORIES = {"restaurant": "Restaurants", "hotel": "Hotels & Travel", "shopping": "Shopping"}


def basic_features(pairs: DataFrame, users: DataFrame, businesses: DataFrame) -> DataFrame:
    """pairs (user_id, business_id, ...) with six features; what is missing is the column's mean."""
    business = businesses.select("business_id", F.col("stars").alias("business_stars"), F.col("review_count").alias("business_review_count"))
    return with_means(with_means(pairs, users, "user_id", USER_FEATURES), business, "business_id", BUSINESS_FEATURES)


def user_features(users: DataFrame) -> DataFrame:
    return users.withColumn("n_friends", list_length(F.col("friends"))).drop("friends")


def business_features(businesses: DataFrame) -> DataFrame:
    attributes = F.col("attributes")
    flags = {name: flag(attributes, key) for name, key in FLAGS.items()}
    groups = {name: category_flag(F.col("categories"), value) for name, value in CATEGORIES.items()}
    return businesses.withColumns(flags | groups | {"noise": noise_level(attributes), "price": price_range(attributes)}).drop("attributes", "categories")


def extended_features(pairs: DataFrame, users: DataFrame, businesses: DataFrame, tips: DataFrame, photos: DataFrame) -> DataFrame:
    """basic columns, friends, attribute and category flags, tips of the pair and photos of the business (0 if none)."""
    business = business_features(businesses).withColumnRenamed("stars", "business_stars").withColumnRenamed("review_count", "business_review_count")
    numeric = [c for c, t in business.dtypes if t in ("bigint", "int", "double") and c != "business_id"]
    out = with_means(with_means(pairs, user_features(users), "user_id", [c for c in user_features(users).columns if c != "user_id"]), business, "business_id", numeric)
    out = out.join(tips.groupBy("user_id", "business_id").agg(F.count("*").alias("n_tips"), F.sum("likes").alias("tip_likes")), ["user_id", "business_id"], "left")
    return enriched(out, photos.groupBy("business_id").agg(F.count("*").alias("n_photos")), "business_id", {"n_tips": 0, "tip_likes": 0, "n_photos": 0})


def rating_model(train: DataFrame, features: list[str], label: str = "stars", trees: int = 500, depth: int = 5, rate: float = 0.1, seed: int = 7):
    """A fitted pipeline (assembler, gradient-boosted trees); rows keep their keys through transform(). Each tree is a pass
    over the data; the extended model takes EXTENDED, trees=3500, depth=6, rate=0.05."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), gbt]).fit(train)
