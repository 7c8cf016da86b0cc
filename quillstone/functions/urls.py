"""URL components, their classes and path templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, "^([a-z]+)://", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, "#(.*)$", 1)


def component_class(c: Column) -> Column:
    """The shape of a component; the first that fits."""
    alpha, digit, hyphen = c.rlike("[A-Za-z]"), c.rlike("[0-9]"), c.contains("-")
    hexes, other = ~c.rlike("[G-Zg-z]"), c.rlike(r"[^A-Za-z0-9.%~+-]")
    return (
        F.when(c.contains("%"), "percent_encoded")
        .when(digit & ~alpha & hyphen & ~other, "date_like")
        .when(digit & alpha & hexes & hyphen & ~other & (F.length(c) >= 9), "uuid_like")
        .when(digit & ~alpha & ~hyphen & ~other, "numeric")
        .when(alpha & ~digit & ~hyphen & ~other, "alphabetic")
        .when(digit & alpha & hexes & ~hyphen & ~other, "hex")
        .when(hyphen & ~other, "slug")
        .when(alpha & digit & ~other & (F.length(c) >= 12), "base64_like")
        .otherwise("mixed")
    )


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def template(p: Column) -> Column:
    return F.array_join(F.transform(segments(p), component_class), "/")


CLASS_SQL = """CASE WHEN contains({c}, '%') THEN 'percent_encoded'
 WHEN {d} AND NOT {a} AND {h} AND NOT {o} THEN 'date_like'
 WHEN {d} AND {a} AND NOT {n} AND {h} AND NOT {o} AND length({c}) >= 9 THEN 'uuid_like'
 WHEN {d} AND NOT {a} AND NOT {h} AND NOT {o} THEN 'numeric'
 WHEN {a} AND NOT {d} AND NOT {h} AND NOT {o} THEN 'alphabetic'
 WHEN {d} AND {a} AND NOT {n} AND NOT {h} AND NOT {o} THEN 'hex'
 WHEN {h} AND NOT {o} THEN 'slug'
 WHEN {a} AND {d} AND NOT {o} AND length({c}) >= 12 THEN 'base64_like' ELSE 'mixed' END"""


def class_sql(c: str) -> str:
    """component_class() in SQL."""
    has = lambda p: f"regexp_matches({c}, '{p}')"
    return CLASS_SQL.format(c=c, d=has("[0-9]"), a=has("[A-Za-z]"), n=has("[G-Zg-z]"), h=f"contains({c}, '-')", o=has("[^A-Za-z0-9.%~+-]"))
