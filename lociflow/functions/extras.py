"""The open ``extra`` column: ``key=value;...`` texts, nested dict literals and copy-number entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lociflow.functions.model import c


def parse_extra(extra: Column | str, strict: bool = False, pair: str = ";") -> Column:
    """A map of texts. A bare key has the value ``true``; a later entry for a key wins.

    ``strict``: each entry must have exactly one ``=``; otherwise a bare key may stand, two ``=`` may not.
    Raises on what may not be. Keys keep their case; null and empty texts give an empty map.
    """
    entries = F.filter(F.split(F.coalesce(c(extra), F.lit("")), pair), lambda x: F.length(F.trim(x)) > 0)
    signs = lambda x: F.length(x) - F.length(F.replace(x, F.lit("="), F.lit("")))
    bad = F.filter(entries, lambda x: (signs(x) != 1) if strict else (signs(x) > 1))
    pairs = F.transform(entries, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.when(signs(x) == 0, F.lit("true")).otherwise(F.substring_index(x, "=", -1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("malformed extra: "), c(extra)))).otherwise(F.map_from_entries(last))


def nested(text: Column | str, kind: str) -> Column:
    """A dict literal with single or double quotes; null where it cannot be read."""
    return F.from_json(c(text), kind, {"allowSingleQuotes": "true"})


def segment_cn(text: Column | str) -> Column:
    """``{'clone':{'A':1,'B':2}}``"""
    return nested(text, "map<string,map<string,int>>")


def segment_bounds(text: Column | str) -> Column:
    """``{'clone':{'A':{'l':0,'u':3}}}``"""
    return nested(text, "map<string,map<string,map<string,int>>>")


def adjacency_cn(text: Column | str) -> Column:
    return nested(text, "map<string,map<string,int>>")


def legacy_cn(text: Column | str, keys: tuple[str, ...]) -> Column:
    """``(clone,1,2);...`` with one number for each key, as clone -> key -> number."""
    entries = F.filter(F.split(c(text), ";"), lambda x: F.length(F.trim(x)) > 0)
    parts = lambda x: F.split(F.regexp_replace(x, r"[()\s]", ""), ",")
    numbers = lambda x: F.create_map(*(y for n, k in enumerate(keys) for y in (F.lit(k), F.get(parts(x), F.lit(n + 1)).try_cast("int"))))
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(F.get(parts(x), F.lit(0)).alias("k"), numbers(x).alias("v"))))


def legacy_bounds(text: Column | str) -> Column:
    """``(clone,lA-uA,lB-uB);...`` as clone -> haplotype -> l / u -> number."""
    entries = F.filter(F.split(c(text), ";"), lambda x: F.length(F.trim(x)) > 0)
    parts = lambda x: F.split(F.regexp_replace(x, r"[()\s]", ""), ",")
    one = lambda p: F.create_map(F.lit("l"), F.get(F.split(p, "-"), F.lit(0)).cast("int"), F.lit("u"), F.get(F.split(p, "-"), F.lit(1)).cast("int"))
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(F.get(parts(x), F.lit(0)).alias("k"), F.create_map(F.lit("A"), one(F.get(parts(x), F.lit(1))), F.lit("B"), one(F.get(parts(x), F.lit(2)))).alias("v"))))


def literal(value: Column | str) -> Column:
    """A nested map as a dict literal with single quotes."""
    return F.replace(F.to_json(c(value)), F.lit('"'), F.lit("'"))


def stringify_extra(extra: Column | str, fields: list[str] | None = None, fill: str = "") -> Column:
    """``key=value`` entries in order of the keys, which are lower-cased; all of them, or just ``fields``, with ``fill`` for those missing."""
    low = F.transform_keys(F.coalesce(c(extra), F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    if fields is None:
        entries = F.array_sort(F.map_entries(low))
        return F.concat_ws(";", F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(fill)))))
    return F.concat_ws(";", *(F.concat(F.lit(f.lower() + "="), F.coalesce(F.try_element_at(low, F.lit(f.lower())), F.lit(fill))) for f in sorted(fields)))
