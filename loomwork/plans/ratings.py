"""Queries of collaborative filtering, feature assembly and the rating model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import features, recommend, relational
from loomwork.sources.readers import parquet


def rated(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers rate parts from 1 to 5."""
    return recommend.ratings(parquet(spark, sf, "lineitem"), "l_suppkey", "l_partkey", F.ceil(F.col("l_quantity") / 10))


def split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): test pairs by id arithmetic; some users and items are in no training row at all."""
    every = rated(spark, sf)
    test = F.pmod(F.col("user") * 31 + F.col("item"), F.lit(997)) == 0
    cold = (F.pmod("user", F.lit(50)) == 7) | (F.pmod("item", F.lit(40)) == 3)
    return every.where(~test & ~cold), every.where(test)


def average_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """CF1, A5, A6: item means, with the global mean beside each."""
    _, items, everything = recommend.averages(rated(spark, sf))
    return items.crossJoin(F.broadcast(everything)).select("item", F.round("item_mean", 6).alias("item_mean"), F.round("global_mean", 6).alias("global_mean"))  # one row


def item_weights(spark: SparkSession, sf: str) -> DataFrame:
    """CF2, CF3: of all pairs of parts."""
    return recommend.item_weights(None, rated(spark, sf)).select("item", "other", F.round("weight", 6).alias("weight"), "common")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split(spark, sf)
    return recommend.predicted(test, train).join(test, ["user", "item"])


def predicted_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """CF4, CF5, CF7, SNK4."""
    return _scored(spark, sf).select("user", "item", F.round("prediction", 5).alias("prediction"), "neighbours")


def prediction_error(spark: SparkSession, sf: str) -> DataFrame:
    """Root mean squared error."""
    return relational.error_measures(_scored(spark, sf), "stars", "prediction").select(F.round("rmse", 5).alias("rmse"), "n")


def error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute errors by whole stars."""
    return relational.error_histogram(_scored(spark, sf).withColumn("prediction", F.round("prediction", 6)), "stars", "prediction")


def blended_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """CF6: a quarter of the item mean (as the model), three quarters of the collaborative prediction."""
    scored = _scored(spark, sf)
    _, items, everything = recommend.averages(split(spark, sf)[0])
    model = scored.join(items, "item", "left").crossJoin(F.broadcast(everything))  # one row
    return model.select("user", "item", F.round(recommend.blended(F.coalesce("item_mean", "global_mean"), F.col("prediction"), 0.25), 5).alias("prediction"))


def businesses(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in the form of businesses with attributes and categories; some have none."""
    part = parquet(spark, sf, "part")
    words = F.element_at(F.array(F.lit("quiet"), F.lit("average"), F.lit("loud")), (F.col("p_size") % 3 + 1).cast("int"))
    attributes = F.create_map(F.lit("GoodForKids"), F.when(F.col("p_size") % 2 == 0, "True").otherwise("False"), F.lit("NoiseLevel"), words, F.lit("RestaurantsPriceRange2"), (F.col("p_size") % 4 + 1).cast("string"))
    categories = F.concat(F.col("p_type"), F.when(F.col("p_size") % 4 == 1, ", Restaurants").when(F.col("p_size") % 4 == 2, ", Shopping").otherwise(""))
    return part.select(
        F.col("p_partkey").cast("string").alias("business_id"), F.round(F.col("p_retailprice") / 500, 4).alias("stars"), F.col("p_size").cast("long").alias("review_count"),
        (F.col("p_size") % 2).cast("long").alias("is_open"), F.round(F.col("p_retailprice") / 10 - 150, 4).alias("longitude"), (F.col("p_size") / 2.0).alias("latitude"),
        F.when(F.col("p_partkey") % 7 > 0, attributes).alias("attributes"), F.when(F.col("p_partkey") % 5 > 0, categories).alias("categories"))


#: What stands for a user's other counts: the key modulo these.
COUNTS = {"funny": 7, "cool": 11, "compliment_hot": 3, "compliment_note": 4, "compliment_photos": 2}


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in the form of users; every ninth is missing."""
    supplier = parquet(spark, sf, "supplier").where("s_suppkey % 9 <> 4")
    friends = F.when(F.col("s_suppkey") % 3 == 0, "None").otherwise(F.regexp_replace("s_name", "[^0-9]", ","))
    return supplier.select(F.col("s_suppkey").cast("string").alias("user_id"), (F.col("s_suppkey") % 17).alias("review_count"), F.round(F.col("s_acctbal") / 2000, 4).alias("average_stars"), (F.col("s_suppkey") % 5).alias("fans"), F.col("s_nationkey").cast("long").alias("useful"),
        *[(F.col("s_suppkey") % m).alias(c) for c, m in COUNTS.items()], friends.alias("friends"))


def attribute_features(spark: SparkSession, sf: str) -> DataFrame:
    """F12 to F15."""
    return features.business_features(businesses(spark, sf)).select("business_id", *[F.col(c).cast("long").alias(c) for c in ("kids", "reservations", "restaurant", "shopping", "hotel", "noise", "price")])


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rated(spark, sf).select(F.col("user").cast("string").alias("user_id"), F.col("item").cast("string").alias("business_id"), F.col("stars").alias("given"))


def basic_features(spark: SparkSession, sf: str) -> DataFrame:
    """ML1, J2, F16."""
    out = features.basic_features(pairs(spark, sf), users(spark, sf), businesses(spark, sf))
    return out.select("user_id", "business_id", *[F.round(c, 4).alias(c) for c in features.USER_FEATURES + features.BUSINESS_FEATURES])


def extended_features(spark: SparkSession, sf: str) -> DataFrame:
    """ML2, F11, A9: all 23 features, and the number of tips."""
    return _extended(spark, sf).select("user_id", "business_id", "n_tips", *[F.round(c, 4).alias(c) for c in features.EXTENDED])


def _extended(spark: SparkSession, sf: str) -> DataFrame:
    """Tips from returned lines, with a day as likes, photos from large ones."""
    lines = parquet(spark, sf, "lineitem")
    tips = lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("business_id"), F.dayofmonth("l_shipdate").cast("long").alias("likes"))
    photos = lines.where("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("business_id"))
    return features.extended_features(pairs(spark, sf), users(spark, sf), businesses(spark, sf), tips, photos)


def tip_likes(spark: SparkSession, sf: str) -> DataFrame:
    """The sum of likes of each pair that has tips."""
    return _extended(spark, sf).where("n_tips > 0").select("user_id", "business_id", "tip_likes")


#: Trees in the registered queries; each is a pass over the data, and the operators' defaults are 500 and more.
TREES = 20


def _modelled(data: DataFrame, names: list[str], depth: int) -> DataFrame:
    test = F.pmod(F.xxhash64("user_id", "business_id"), F.lit(20)) == 0
    return features.rating_model(data.where(~test), names, "given", trees=TREES, depth=depth).transform(data.where(test)).select("user_id", "business_id", "given", "prediction")


def rating_model(spark: SparkSession, sf: str) -> DataFrame:
    """ML3, ML5: gradient-boosted trees over the basic features; keys stay in the rows."""
    return _modelled(features.basic_features(pairs(spark, sf), users(spark, sf), businesses(spark, sf)), features.USER_FEATURES + features.BUSINESS_FEATURES, 5)


def extended_rating_model(spark: SparkSession, sf: str) -> DataFrame:
    """ML4: the same over all 23 features, with deeper trees."""
    return _modelled(_extended(spark, sf), features.EXTENDED, 6)


QUERIES = {f.__name__: f for f in (average_ratings, item_weights, predicted_ratings, prediction_error, error_histogram, blended_ratings, attribute_features, basic_features, extended_features, tip_likes, rating_model, extended_rating_model)}

RATED = "rated AS (SELECT l_suppkey AS user, l_partkey AS item, avg(ceil(l_quantity / 10)::DOUBLE) AS stars FROM lineitem GROUP BY 1, 2)"
LADDER = "CASE WHEN abs(m1 - m2) <= 0.85 THEN 1.0 WHEN abs(m1 - m2) <= 2 THEN 0.85 WHEN abs(m1 - m2) <= 3 THEN 0.5 WHEN abs(m1 - m2) <= 4 THEN 0.25 ELSE 0.0 END::DOUBLE"


def _weights(source: str, wanted: str) -> str:
    return f"""
means AS (SELECT item, avg(stars) AS mean FROM {source} GROUP BY 1),
x AS (SELECT r.user, r.item, stars - mean AS x FROM {source} r JOIN means USING (item)),
wanted AS ({wanted}),
sums AS (SELECT p.item, p.other, sum(a.x * b.x) AS xy, sum(a.x * a.x) AS xx, sum(b.x * b.x) AS yy, count(*) AS common FROM wanted p JOIN x a ON a.item = p.item JOIN x b ON b.item = p.other AND a.user = b.user GROUP BY 1, 2),
weights AS (SELECT p.item, p.other, CASE WHEN common IS NULL THEN {LADDER} WHEN sqrt(xx) * sqrt(yy) > 1e-12 AND abs(xy) > {recommend.ROUNDING!r}::DOUBLE * sqrt(xx) * sqrt(yy) THEN xy / (sqrt(xx) * sqrt(yy)) ELSE 0 END AS weight, coalesce(common, 0) AS common
  FROM wanted p LEFT JOIN sums s ON p.item = s.item AND p.other = s.other JOIN (SELECT item, mean AS m1 FROM means) a ON a.item = p.item JOIN (SELECT item, mean AS m2 FROM means) b ON b.item = p.other)"""


SCORED = f"""
WITH {RATED}, train AS (SELECT * FROM rated WHERE (user * 31 + item) % 997 <> 0 AND user % 50 <> 7 AND item % 40 <> 3), test AS (SELECT * FROM rated WHERE (user * 31 + item) % 997 = 0),
near AS (SELECT t.user, t.item, r.item AS other, r.stars FROM test t JOIN train r ON t.user = r.user WHERE t.item IN (SELECT item FROM train)),
{_weights("train", "SELECT DISTINCT item, other FROM near")},
score AS (SELECT user, n.item, sum(weight * stars) / sum(weight) AS score, count(*) AS neighbours FROM near n JOIN weights w ON n.item = w.item AND n.other = w.other WHERE weight > 0 GROUP BY 1, 2),
um AS (SELECT user, avg(stars) AS u FROM train GROUP BY 1), im AS (SELECT item, avg(stars) AS i FROM train GROUP BY 1), gm AS (SELECT avg(stars) AS g FROM train),
scored AS (SELECT t.user, t.item, t.stars, coalesce(score, (i + u) / 2, i, u, g) AS prediction, coalesce(neighbours, 0) AS neighbours, coalesce(i, g) AS model
  FROM test t LEFT JOIN um ON t.user = um.user LEFT JOIN im ON t.item = im.item LEFT JOIN score s ON s.user = t.user AND s.item = t.item, gm)"""

BUSINESS = """
business AS (SELECT CAST(p_partkey AS VARCHAR) AS business_id, round(p_retailprice / 500, 4) AS stars, p_size::BIGINT AS review_count, p_size % 2 AS is_open, round(p_retailprice / 10 - 150, 4) AS longitude, p_size / 2.0::DOUBLE AS latitude, p_size, p_partkey % 7 > 0 AS has, p_partkey % 5 > 0 AS named, p_type FROM part)"""
USERS = f"users AS (SELECT CAST(s_suppkey AS VARCHAR) AS user_id, s_suppkey % 17 AS review_count, round(s_acctbal / 2000, 4) AS average_stars, s_suppkey % 5 AS fans, s_nationkey AS useful, {', '.join(f's_suppkey % {m} AS {c}' for c, m in COUNTS.items())}, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE len(string_split(regexp_replace(s_name, '[^0-9]', ',', 'g'), ',')) END AS n_friends FROM supplier WHERE s_suppkey % 9 <> 4)"

EXTENDED_SQL = f"""
WITH {RATED}, {BUSINESS}, {USERS},
b AS (SELECT business_id, stars, review_count, is_open, longitude, latitude, 0 AS reservations, 0 AS credit_card, CASE WHEN NOT has THEN 0 ELSE p_size % 4 + 1 END AS price,
  CASE WHEN NOT named THEN 0 WHEN p_size % 4 = 1 THEN 2 ELSE 1 END AS restaurant, CASE WHEN NOT has THEN 0 WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS kids,
  CASE WHEN NOT has THEN 0 WHEN p_size % 3 = 0 THEN 3 WHEN p_size % 3 = 1 THEN 2 ELSE 1 END AS noise FROM business),
t AS (SELECT l_suppkey, l_partkey, count(*) AS n, CAST(sum(day(l_shipdate)) AS BIGINT) AS likes FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
h AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1)"""

ORACLES = {
    "average_ratings": f"WITH {RATED} SELECT item, round(avg(stars), 6) AS item_mean, round((SELECT avg(stars) FROM rated), 6) AS global_mean FROM rated GROUP BY 1",
    "item_weights": f"WITH {RATED}, i AS (SELECT DISTINCT item FROM rated), {_weights('rated', 'SELECT a.item, b.item AS other FROM i a JOIN i b ON a.item < b.item')} SELECT item, other, round(weight, 6) AS weight, common FROM weights",
    "predicted_ratings": f"{SCORED} SELECT user, item, round(prediction, 5) AS prediction, neighbours FROM scored",
    "prediction_error": f"{SCORED} SELECT round(sqrt(avg(pow(stars - prediction, 2))), 5) AS rmse, count(*) AS n FROM scored",
    "error_histogram": f"{SCORED} SELECT CAST(least(floor(abs(stars - round(prediction, 6))), 4) AS BIGINT) AS bin, count(*) AS n FROM scored GROUP BY 1",
    "blended_ratings": f"{SCORED} SELECT user, item, round(0.25::DOUBLE * model + 0.75::DOUBLE * prediction, 5) AS prediction FROM scored",
    "attribute_features": f"""
WITH {BUSINESS} SELECT business_id, CASE WHEN NOT has THEN 0 WHEN p_size % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS kids, 0::BIGINT AS reservations,
  CASE WHEN NOT named THEN 0 WHEN p_size % 4 = 1 THEN 2 ELSE 1 END::BIGINT AS restaurant, CASE WHEN NOT named THEN 0 WHEN p_size % 4 = 2 THEN 2 ELSE 1 END::BIGINT AS shopping, CASE WHEN NOT named THEN 0 ELSE 1 END::BIGINT AS hotel,
  CASE WHEN NOT has THEN 0 WHEN p_size % 3 = 0 THEN 3 WHEN p_size % 3 = 1 THEN 2 ELSE 1 END::BIGINT AS noise, CASE WHEN NOT has THEN 0 ELSE p_size % 4 + 1 END::BIGINT AS price FROM business""",
    "basic_features": f"""
WITH {RATED}, {BUSINESS}, {USERS}
SELECT CAST(r.user AS VARCHAR) AS user_id, CAST(r.item AS VARCHAR) AS business_id, {", ".join(f"round(coalesce(u.{c}, (SELECT avg({c}) FROM users))::DOUBLE, 4) AS {c}" for c in features.USER_FEATURES)},
  round(coalesce(b.stars, (SELECT avg(stars) FROM business))::DOUBLE, 4) AS business_stars, round(coalesce(b.review_count, (SELECT avg(review_count) FROM business))::DOUBLE, 4) AS business_review_count
FROM rated r LEFT JOIN users u ON CAST(r.user AS VARCHAR) = u.user_id LEFT JOIN business b ON CAST(r.item AS VARCHAR) = b.business_id""",
    "extended_features": f"""
{EXTENDED_SQL}, j AS (SELECT CAST(r.user AS VARCHAR) AS user_id, CAST(r.item AS VARCHAR) AS business_id, coalesce(t.n, 0) AS n_tips, coalesce(t.likes, 0) AS tip_likes, coalesce(h.n, 0) AS n_photos
  FROM rated r LEFT JOIN t ON t.l_suppkey = r.user AND t.l_partkey = r.item LEFT JOIN h ON h.l_partkey = r.item)
SELECT j.user_id, j.business_id, n_tips, tip_likes, n_photos, {", ".join(f"round(coalesce(u.{c}, (SELECT avg({c}) FROM users))::DOUBLE, 4) AS {c}" for c in features.USER_FEATURES + features.USER_COUNTS)},
  round(b.stars::DOUBLE, 4) AS business_stars, round(b.review_count::DOUBLE, 4) AS business_review_count, {", ".join(f"round(b.{c}::DOUBLE, 4) AS {c}" for c in features.PLACE)}
FROM j LEFT JOIN users u USING (user_id) JOIN b USING (business_id)""",
    "tip_likes": f"{EXTENDED_SQL} SELECT CAST(l_suppkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS business_id, likes AS tip_likes FROM t",
}
