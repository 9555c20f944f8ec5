"""Tag, priority and money expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from spendpace.config import PRIORITY_ORDER, SIZE_LADDER

MONEY = "decimal(18,4)"


def money(c) -> Column:
    """Lenient money parse: bad text or NULL becomes 0 (exact decimal)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast(MONEY), F.lit(0).cast(MONEY))


#: Money and prices of single fact rows: far below a cent, summed exactly.
#: Published columns are rounded to ``MONEY``.
FACT_MONEY = "decimal(38,12)"


def fact_money(c: Column) -> Column:
    """Like ``money``, at the width of single fact rows."""
    return F.coalesce(c.try_cast(FACT_MONEY), F.lit(0).cast(FACT_MONEY))


#: Metered usage. A row's quantity times its list price is exact at 21 places
#: and sums stay exact up to 10^17 dollars. Beyond a field's width a job stops
#: (``exact_amount``, and ANSI overflow of a sum); no amount is cut or dropped.
QUANTITY, UNIT_PRICE, USAGE_MONEY = "decimal(22,12)", "decimal(15,9)", "decimal(38,21)"
#: What usage dollars are published at and taken to floating point from.
USAGE_PUBLISHED = "decimal(28,9)"


def exact_amount(c: Column, kind: str) -> Column:
    """A number as the decimal ``kind``: NULL, text that is no number and NaN
    become 0; a finite number too large for the type raises."""
    whole = 10 ** (int(kind[8:].split(",")[0]) - int(kind[:-1].split(",")[1]))
    narrow, wide = c.try_cast(kind), c.try_cast("double")
    fits = F.isnan(wide) | (F.abs(wide) == float("inf")) | (F.abs(wide) < whole)
    return (F.when(narrow.isNotNull(), narrow).when(F.coalesce(fits, F.lit(True)), F.lit(0).cast(kind))
            .otherwise(F.raise_error(F.concat(F.lit(f"usage amount beyond {kind}: "), c.cast("string"))).cast(kind)))


def usage_double(c: Column) -> Column:
    """Summed usage dollars for a ratio or a forecast."""
    return c.cast(USAGE_PUBLISHED).cast("double")


def tag_entries_expr(c: Column, dtype: DataType) -> Column:
    """A resource-tag cell -> array<struct<key,value>>, keys as given.

    Native maps pass through, as do arrays of two-field structs and of pairs;
    another type raises. Text is parsed as a JSON object, else as a JSON
    list of pairs (entries not exactly two long are skipped). Unparsable or
    NULL cells give an empty array. Entries are kept as an array, never
    rebuilt into a map, because duplicate keys would raise.
    """
    empty = F.array().cast("array<struct<key:string,value:string>>")
    if isinstance(dtype, MapType):
        return F.coalesce(F.map_entries(c.cast("map<string,string>")), empty)
    if isinstance(dtype, ArrayType) and isinstance(dtype.elementType, StructType) and len(dtype.elementType.fields) == 2:
        key, value = dtype.elementType.fieldNames()
        whole = F.filter(c, lambda e: e.isNotNull())
        return F.coalesce(F.transform(whole, lambda e: F.struct(e[key].cast("string").alias("key"), e[value].cast("string").alias("value"))), empty)
    if isinstance(dtype, ArrayType) and isinstance(dtype.elementType, ArrayType):
        pairs = F.filter(c.cast("array<array<string>>"), lambda e: F.size(e) == 2)
        return F.coalesce(F.transform(pairs, lambda e: F.struct(e[0].alias("key"), e[1].alias("value"))), empty)
    if not isinstance(dtype, StringType):
        raise TypeError(f"resource tags of type {dtype.simpleString()} are not supported")
    obj = F.from_json(c, "map<string,string>")
    pairs = F.filter(F.from_json(c, "array<array<string>>"), lambda p: F.size(p) == 2)
    pair_entries = F.transform(pairs, lambda p: F.struct(p[0].alias("key"), p[1].alias("value")))
    return F.coalesce(F.map_entries(obj), pair_entries, empty)


def tag_value(entries: Column, key: str) -> Column:
    """Value of ``key`` (matched lower-case) among tag entries; the last
    duplicate wins; absent -> NULL."""
    hits = F.filter(entries, lambda e: F.lower(e["key"]) == F.lit(key.lower()))
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["value"])


def priority_from_tags(tags: Column, tag_key: str) -> Column:
    """Priority from the exact-case tag key: trimmed, lower-cased value if it
    names a known priority, else ``normal``."""
    v = F.lower(F.trim(F.coalesce(F.try_element_at(tags, F.lit(tag_key)), F.lit(""))))
    return F.when(v.isin(*PRIORITY_ORDER), v).otherwise(F.lit("normal"))


def throttle_order(priority: Column) -> Column:
    expr = F.lit(None).cast("int")
    for name, rank in PRIORITY_ORDER.items():
        expr = F.when(priority == name, F.lit(rank)).otherwise(expr)
    return expr


def size_index(size: Column) -> Column:
    """Position of a warehouse size on the ladder (trim, lower); unknown -> 0."""
    ladder = F.array(*[F.lit(s.lower()) for s in SIZE_LADDER])
    return F.greatest(F.array_position(ladder, F.lower(F.trim(size))).cast("int") - 1, F.lit(0))


def size_at(index: Column) -> Column:
    ladder = F.array(*[F.lit(s) for s in SIZE_LADDER])
    return F.element_at(ladder, F.greatest(index, F.lit(0)) + 1)
