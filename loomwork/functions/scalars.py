"""Scalar expressions that the engine's operators are built from; each is a Column of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def affine(x: Column, a: Column | int, b: Column | int, modulus: int) -> Column:
    """(a * x + b) mod modulus over longs; keep a * x below 2^63."""
    wide = lambda v: v if isinstance(v, Column) else F.lit(v).cast("long")
    return F.pmod(wide(a) * x + wide(b), F.lit(modulus).cast("long"))


def utf8_mod(x: Column, modulus: int) -> Column:
    """A string's UTF-8 bytes as one big-endian integer, mod modulus (below 2^55), by Horner's rule."""
    code = F.hex(F.encode(x, "UTF-8"))
    digits = F.transform(F.sequence(F.lit(1), F.octet_length(x)), lambda i: F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.octet_length(x) > 0, F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: F.pmod(a * 256 + d, F.lit(modulus).cast("long")))).when(x.isNotNull(), F.lit(0).cast("long"))


def trailing_zeros(v: Column, of_zero: int = 1) -> Column:
    """Trailing zero bits of a long; ``of_zero`` for 0 (its one binary digit is a zero)."""
    return F.when(v == 0, F.lit(of_zero)).otherwise(F.bit_count(v.bitwiseAND(-v) - 1))


#: (difference of means, weight) of two items without common raters; beyond the last the weight is 0.
BANDS = ((0.85, 1.0), (2.0, 0.85), (3.0, 0.5), (4.0, 0.25))


def band_of_difference(x: Column) -> Column:
    """The weight of two items without common raters, from the difference of their means."""
    return F.coalesce(*[F.when(F.abs(x) <= most, weight) for most, weight in BANDS], F.lit(0.0))


def list_length(x: Column, nothing: str = "None") -> Column:
    """Members of a comma list; 0 for the word ``nothing``, null or the empty string."""
    return F.when(x.isNull() | (x == nothing) | (x == ""), 0).otherwise(F.size(F.split(x, ",")))


def flag(attributes: Column, key: str) -> Column:
    """0 without the map or the key, 2 if the value is true, else 1."""
    value = F.try_element_at(attributes, F.lit(key))
    return F.when(value.isNull(), 0).when(F.lower(value) == "true", 2).otherwise(1)


def noise_level(attributes: Column, key: str = "NoiseLevel") -> Column:
    value = F.try_element_at(attributes, F.lit(key))
    return F.when(value.isNull(), 0).when(value == "quiet", 3).when(value == "average", 2).otherwise(1)


def price_range(attributes: Column, key: str = "RestaurantsPriceRange2") -> Column:
    return F.coalesce(F.try_element_at(attributes, F.lit(key)).try_cast("int"), F.lit(0))


def category_flag(categories: Column, name: str, trim: bool = True) -> Column:
    """0 without categories, 2 if ``name`` is among them, else 1. Without trim, a name after ', ' does not match."""
    names = F.split(categories, ",")
    names = F.transform(names, lambda x: F.trim(x)) if trim else names
    return F.when(categories.isNull(), 0).when(F.array_contains(names, name), 2).otherwise(1)


def moments(n: Column, total: Column, squares: Column) -> Column:
    """(m, v) of each dimension: the mean, and the variance (1 without spread) by which squared differences are divided."""
    spread = lambda s, q: F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))
    return F.zip_with(total, squares, lambda s, q: F.struct((s / n).alias("m"), F.when(spread(s, q) > 1e-12, spread(s, q)).otherwise(1.0).alias("v")))


def standardized_distance(point: Column, n: Column, total: Column, squares: Column) -> Column:
    """Distance of a vector from a summary (n, sum, sum of squares per dimension) in standard deviations.

    A dimension without spread counts as its plain squared difference."""
    return distance_from(point, moments(n, total, squares))


def distance_from(point: Column, centre: Column) -> Column:
    """Distance of a vector from moments, in standard deviations."""
    parts = F.zip_with(point, centre, lambda x, c: F.pow(x - c["m"], F.lit(2.0)) / c["v"])
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda a, d: a + d))
