"""Map and reduce with plain Python functions, in Arrow batches.

A reduce is one exchange by the key and one sort by key and values, over which Python walks group by group; a group is a
one-pass iterator and its output is passed on as it comes, so neither has to fit in memory.
"""

from __future__ import annotations

import itertools
import json
import math
import operator
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DateType, IntegralType, LongType, MapType, StringType, StructType, VariantType

from ..functions.registry import add
from ..functions.shipping import ship

#: Items and characters of a batch that a function puts out.
ROWS, CHARS = 10_000, 8 << 20
#: Characters of the lines that a function of some lines gets at once, beyond which no further line is added.
SOME = 1 << 20
PLAIN = (StringType, IntegralType, BooleanType, DateType, BinaryType)


def _tuples(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch.num_columns else iter(())


def _weight(value: Any) -> int:
    if isinstance(value, (str, bytes)):
        return len(value)
    return sum(map(_weight, value.values() if isinstance(value, dict) else value)) if isinstance(value, (list, tuple, dict)) else 8


def _batches(items: Iterator[Sequence], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    long = [i for i, f in enumerate(schema) if not pa.types.is_primitive(f.type)]

    def cut() -> Iterator[list]:
        some, chars = [], 0
        for item in items:
            some.append(item)
            for i in long:
                chars += _weight(item[i])
            if len(some) >= ROWS or chars >= CHARS:
                yield some
                some, chars = [], 0
        if some:
            yield some

    for some in cut():
        columns = zip(*some, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema), prefers_large_types=False)


def flat_map(df: DataFrame, function: Callable[[Any, Any], Sequence], schema: str, aux: Any = None, keys: Sequence[str] = (), merge: Callable[[tuple, tuple], tuple] | None = None, most: int = 100_000) -> DataFrame:
    """function(line, aux) to any number of items. A one-column df gives lines, any other gives rows as tuples.

    With ``merge`` a task merges its items of equal keys before they leave it, as ``combine`` does.
    """
    ship(df.sparkSession)
    shared, out, single = df.sparkSession.sparkContext.broadcast(aux), _arrow(schema), len(df.columns) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (row[0] if single else row for b in batches for row in _tuples(b))
        items = (item for line in lines for item in function(line, shared.value))
        yield from _batches(items if merge is None else _merged(items, key, merge, most), out)

    key = _key_of(StructType.fromDDL(schema), keys)
    return df.mapInArrow(run, schema)


def _some(lines: Iterator) -> Iterator[list]:
    some, chars = [], 0
    for line in lines:
        some.append(line)
        chars += _weight(line)
        if len(some) >= ROWS or chars >= SOME:
            yield some
            some, chars = [], 0
    if some:
        yield some


def _counted(held: Counter, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    keys, counts = list(held), list(held.values())
    for i in range(0, len(keys), ROWS):
        columns = keys[i : i + ROWS], counts[i : i + ROWS]
        if sum(map(_weight, columns[0])) >= CHARS:
            yield from _batches(zip(*columns, strict=True), schema)
        else:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def count_keys(df: DataFrame, function: Callable[[list, Any], Iterable], schema: str, aux: Any = None, most: int = 100_000) -> DataFrame:
    """function(some lines, aux) to any number of keys, each of which counts one; schema: key and count. Lines are as in ``flat_map``.

    A task counts its keys before they leave it, and lets go of what it has after the lines with which it holds ``most`` of them.
    """
    ship(df.sparkSession)
    shared, out, single, kinds = df.sparkSession.sparkContext.broadcast(aux), _arrow(schema), len(df.columns) == 1, StructType.fromDDL(schema)
    if len(kinds) != 2 or not isinstance(kinds[0].dataType, PLAIN) or not isinstance(kinds[1].dataType, LongType):
        raise ValueError(f"not a key of a plain type and a long: {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for some in _some(row[0] if single else row for b in batches for row in _tuples(b)):
            held.update(iter(function(some, shared.value)))
            if len(held) >= most:
                yield from _counted(held, out)
                held = Counter()
        yield from _counted(held, out)

    return df.mapInArrow(run, schema)


def _same(key: tuple) -> tuple:
    """A key that is equal where Spark holds keys equal: NaN is NaN, 0.0 is -0.0, and types stay apart."""
    return tuple(("nan",) if isinstance(k, float) and math.isnan(k) else (type(k).__name__, k) if not isinstance(k, (list, dict)) else json.dumps(k, sort_keys=True, default=str) for k in key)


def _key_of(schema: StructType, keys: Sequence[str]) -> Callable[[Sequence], Any]:
    """What tells keys apart in a row. Values of plain types do so as they are."""
    at = [schema.names.index(k) for k in keys]
    if at and all(isinstance(schema[i].dataType, PLAIN) for i in at):
        return operator.itemgetter(*at)
    return lambda row: _same(tuple(row[i] for i in at))


def _merged(rows: Iterator[Sequence], key: Callable[[Sequence], Any], function: Callable[[tuple, tuple], tuple], most: int) -> Iterator[Sequence]:
    held: dict[Any, Sequence] = {}
    for row in rows:
        k = key(row)
        held[k] = function(held[k], row) if k in held else row
        if len(held) >= most:
            yield from held.values()
            held = {}
    yield from held.values()


def sortable(df: DataFrame, names: Sequence[str]) -> list:
    """Sort expressions for any type; maps by their sorted entries, variants by their JSON."""
    kinds = {f.name: f.dataType for f in df.schema}

    def one(n):
        c = F.col(f"`{n}`")
        if isinstance(kinds[n], MapType):
            return F.array_sort(F.map_entries(c))
        return F.to_json(c) if isinstance(kinds[n], VariantType) else c

    return [one(n) for n in names]


def adds(schema: StructType, keys: Sequence[str], merge: Callable | None) -> bool:
    """Whether Spark's sums are what ``merge`` makes of the items: whole numbers by keys of plain types."""
    return merge is add and len(schema) > len(keys) and all(isinstance(f.dataType, PLAIN if f.name in keys else LongType) for f in schema)


def sum_up(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All other columns' sums by the keys, the columns in their order."""
    column = {c: F.col(f"`{c}`") for c in df.columns}
    sums = df.groupBy(*[column[k] for k in keys]).agg(*[F.sum(column[c]).alias(c) for c in df.columns if c not in keys])
    return sums.select(*column.values())


def reduce_groups(df: DataFrame, keys: Sequence[str], function: Callable[[Iterator[tuple], Any], Sequence], schema: str, aux: Any = None, order_by: Sequence[str] | None = None, partitions: int | None = None, merge: Callable[[tuple, tuple], tuple] | None = None) -> DataFrame:
    """function(items of a key, aux) to any number of items. Items come as whole tuples, ordered by order_by (all other columns if not given).

    merge: how a key's items make one. Items that add up are added up by Spark, in a task and after the exchange, and a group is one item.
    """
    ship(df.sparkSession)
    summed = adds(df.schema, keys, merge)
    if summed:
        df = sum_up(df, keys)
    values = [c for c in df.columns if c not in keys] if order_by is None else list(order_by)
    shared, out = df.sparkSession.sparkContext.broadcast(aux), _arrow(schema)
    key = _key_of(df.schema, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in _tuples(b))
        groups = itertools.groupby(rows, key=key)
        yield from _batches((item for _, group in groups for item in function(group, shared.value)), out)

    # without a number of partitions Spark may join small ones; sums are dealt by key as they are
    dealt = df if summed and not partitions else df.repartition(*([partitions] if partitions else []), *[F.col(f"`{k}`") for k in keys])
    return dealt.sortWithinPartitions(*sortable(df, [*keys, *values])).mapInArrow(run, schema)


def sub_groups(items: Iterator[tuple], at: int = 0) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """Runs of equal values at one place, in the order the items come."""
    return itertools.groupby(items, key=lambda r: r[at])


def combine(df: DataFrame, keys: Sequence[str], function: Callable[[tuple, tuple], tuple], most: int = 100_000) -> DataFrame:
    """Merge items of equal keys within a task before the exchange, with at most ``most`` keys held: eases hot keys of mergeable reducers."""
    ship(df.sparkSession)
    out = to_arrow_schema(df.schema, prefers_large_types=False)
    key = _key_of(df.schema, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_merged((row for b in batches for row in _tuples(b)), key, function, most), out)

    return df.mapInArrow(run, df.schema)
