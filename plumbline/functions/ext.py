"""Functions that extensions usually bring: digests, label paths, maps, distances, SQL/JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def digest(x: Column, method: str) -> Column:
    bits = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}
    return F.md5(x.cast("binary")) if method == "md5" else F.sha1(x.cast("binary")) if method == "sha1" else F.sha2(x.cast("binary"), bits[method])


def unaccent(x: Column) -> Column:
    return F.translate(x, *_ACCENTS)


def nlevel(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, r"\.")))


def subpath(path: Column, start: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(path, r"\."), start + 1, n), ".")


def is_descendant(path: Column, ancestor: Column) -> Column:
    """``path <@ ancestor``; a path is its own descendant."""
    return (path == ancestor) | F.startswith(path, F.concat(ancestor, F.lit(".")))


def map_has(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key)


def map_concat(a: Column, b: Column) -> Column:
    """``a || b``: the right side's value wins."""
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(kept, b)


def map_delete(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def earth_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    """Metres along a great circle."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def json_exists(j: Column, path: str) -> Column:
    return F.get_json_object(j, path).isNotNull()


def json_value(j: Column, path: str, kind: str = "string", on_empty=None) -> Column:
    """``JSON_VALUE(j, path RETURNING kind DEFAULT on_empty ON EMPTY)``; a value that does not fit is NULL."""
    got = F.get_json_object(j, path)
    value = got.try_cast(kind)
    return value if on_empty is None else F.when(got.isNull(), F.lit(on_empty).cast(kind)).otherwise(value)


def crosstab(df, row: str, column: str, values: list, agg: Column):
    """Rows by category with one column for each listed value."""
    return df.groupBy(row).pivot(column, values).agg(agg)
