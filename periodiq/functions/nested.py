"""Arrays, maps and JSON (FA-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(c: Column, schema: str) -> Column:
    """JSON of a schema; null where it cannot be read (FA-01, FA-09)."""
    return F.from_json(c, schema)


def encode(c: Column) -> Column:
    """JSON text of an array or map; empty ones null (FA-02)."""
    return F.when(F.size(c) > 0, F.to_json(c))


def int_keys(c: Column) -> Column:
    """A JSON object of counts as map<int, bigint>; keys that are no numbers are dropped (FA-03)."""
    m = F.from_json(c, "map<string,bigint>")
    return F.transform_keys(F.map_filter(m, lambda k, v: k.try_cast("int").isNotNull()), lambda k, v: k.cast("int"))


def polymorphic_count(c: Column, names: tuple[str, ...] = ("count", "citation_count", "reference_count")) -> Column:
    """A count given as an object or as a list of one, under any of the names (FA-04)."""
    paths = [f"{p}.{n}" for p in ("$", "$[0]") for n in names]
    return F.coalesce(*[F.get_json_object(c, p).try_cast("bigint") for p in paths])


def pairs_to_map(c: Column) -> Column:
    """[[key, value], ...] as a map; short pairs are dropped, the last of equal keys wins (FA-05)."""
    good = F.filter(c, lambda p: F.size(p) >= 2)
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: F.get(q, F.lit(0)) == F.get(p, F.lit(0))))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))


def tagged(c: Column, tag: str) -> Column:
    """Every text with `tag: ` in front (FA-07)."""
    return F.transform(c, lambda f: F.concat(F.lit(f"{tag}: "), f))


def joined_reasons(*parts: Column) -> Column:
    """One list out of lists and texts, nulls left out (FA-10)."""
    return F.array_compact(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))


def first_identifiers(preferred: Column, others: Column, n: int = 2) -> Column:
    """The preferred identifier and the others, once each, at most n (FA-06)."""
    return F.slice(F.array_distinct(F.array_compact(F.concat(F.array(preferred), F.coalesce(others, F.array().cast("array<string>"))))), 1, n)
