"""Windows over the last rows of a key, dealt in ranges: one key may hold any share of the rows.

Rows are dealt to ranges of (keys, order) and sorted, so a large key is cut into several ranges. Each range passes as a
stream with the last rows of its key as only state. The rows at the beginning of a range's first key do not see their whole
window there; they and the last rows of each range are marked. A second, short pass over the marked rows alone, in order,
sees what the first one could not: before the beginning of a range stand the last rows of the range before. It reads at
most twice the window's rows from each range, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegralType, LongType, StructField, StructType

from flowlens.operators.runs import key_changes
from flowlens.scratch import cut

_SUM, _MEAN, _DISTINCT = "sum", "mean", "distinct"


def window_sums(values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sums of values[low[i]:i]: by running totals where those are exact, else term by term."""
    whole = values.dtype.kind == "i" or bool(np.all(values == np.floor(values)) and np.abs(values).sum() < 2**53)
    at = np.arange(len(values))
    if whole:
        total = np.concatenate(([0], np.cumsum(values)))
        return total[at] - total[low]
    ends = np.column_stack((low, at)).ravel()
    return np.where(low < at, np.add.reduceat(values, ends)[::2], 0.0)


def window_distinct(values: np.ndarray, there: np.ndarray, run: np.ndarray, run_end: np.ndarray, rows: int) -> np.ndarray:
    """How many different values stand among the ``rows`` rows before each one, within its run.

    A value counts for the rows after it until it comes again (then the later one counts) or leaves the window.
    """
    n = len(values)
    order = np.lexsort((np.arange(n), values, run))
    order = order[there[order]]
    following = np.full(n, n, dtype=np.int64)
    same = (values[order[1:]] == values[order[:-1]]) & (run[order[1:]] == run[order[:-1]])
    following[order[:-1][same]] = order[1:][same]
    at = np.flatnonzero(there)
    step = np.zeros(n + 2, dtype=np.int64)
    np.add.at(step, at + 1, 1)
    np.add.at(step, np.minimum(np.minimum(following[at], at + rows), run_end[at] - 1) + 1, -1)
    return np.cumsum(step)[:n]


def _stream(kept: list[str], keys: list[str], fields: list[tuple[str, str, str]], rows: int, flags: bool):
    """kept columns and results of a sorted stream; with flags, which rows lack a part of their window and which are last.

    fields are (kind, helper column, result type). State: the last rows of the open key, and as many rows held back until
    it is known whether they are the last ones.
    """

    def results(batch: pa.RecordBatch, before: pa.RecordBatch | None) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        old = 0 if before is None else before.num_rows
        whole = batch if not old else pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
        turns = np.concatenate(([True], key_changes(whole.select(keys))))
        starts = np.flatnonzero(turns)
        run = np.cumsum(turns) - 1
        run_end = np.append(starts[1:], whole.num_rows)[run]
        at = np.arange(whole.num_rows)
        low = np.maximum(at - rows, starts[run])
        out = []
        for kind, name, _ in fields:
            column = whole.column(name)
            there = ~column.is_null().to_numpy(zero_copy_only=False)
            values = column.fill_null(0).to_numpy(zero_copy_only=False)
            if kind == _DISTINCT:
                found = window_distinct(values, there, run, run_end, rows)
            else:
                found = window_sums(values, low)
                if kind == _MEAN:
                    count = window_sums(there.astype(np.int64), low)
                    found = np.divide(found, count, out=np.zeros(len(values)), where=count > 0)
            out.append(pa.array(found[old:]))
        return out, run[old:], at[old:] - starts[run[old:]]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = held = None
        first, seen = True, 0  # whether the first key is still open, and its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            found, run, place = results(batch, before)
            columns = [batch.column(c) for c in kept] + [f.cast(t) for f, t in zip(found, types, strict=True)]
            if flags:
                goes_on = before is None or place[0] > 0  # else the first key ended with the batch before
                same = (run == run[0]) & goes_on
                lacking = same & first & (seen + np.arange(len(run)) < rows)
                columns += [pa.array(lacking), pa.array(np.zeros(len(run), bool))]
                first = bool(first and same[-1])
                seen += int(same.sum())
            context = batch if before is None else pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
            changes = np.flatnonzero(key_changes(context.select(keys)))
            last = int(changes[-1]) + 1 if len(changes) else 0
            before = context.slice(max(last, context.num_rows - rows))
            done = pa.RecordBatch.from_arrays(columns, names)
            if not flags:
                yield done
                continue
            held = done if held is None else pa.Table.from_batches([held, done]).combine_chunks().to_batches()[0]
            if held.num_rows > rows:
                yield held.slice(0, held.num_rows - rows)
                held = held.slice(held.num_rows - rows)
        if held is not None:
            tail = np.arange(held.num_rows) >= held.num_rows - before.num_rows
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(tail)], names)

    types = [pa.int64() if t == "bigint" else pa.float64() for *_, t in fields]
    names = [*kept, *[f"_r{i}" for i in range(len(fields))], *(["_lacks", "_last"] if flags else [])]
    return go


def trailing_features(
    df: DataFrame, keys: list[str], order: list[str], rows: int, sums: dict[str, Column], means: dict[str, Column], distinct: dict[str, Column],
    columns: list[str] | None = None, ranges: int | None = None,
) -> DataFrame:
    """df, or the columns named, with sums, means and distinct counts over the ``rows`` rows of the same keys before each one; 0 where there are none.

    Sums of whole-number columns are bigint, others double; nulls do not count, and a distinct value counts by its 64-bit
    hash. Null keys are one key. order must tell rows apart: rows equal in keys and order stay in one range, in any order.
    Results replace columns of their names; an empty table stays empty. ranges is how many ranges there are (default: the
    session's shuffle partitions).
    """
    made = [*sums, *means, *distinct]
    back = [c for c in columns or df.columns if c not in made]
    carried = list(dict.fromkeys([*back, *keys, *order]))
    fields, helpers = [], {}
    for kind, group in ((_SUM, sums), (_MEAN, means), (_DISTINCT, distinct)):
        for column in group.values():
            name = f"_h{len(fields)}"
            if kind == _DISTINCT:
                helpers[name], result = F.when(column.isNotNull(), F.xxhash64(column)), "bigint"
            elif kind == _SUM and isinstance(df.select(column).schema[0].dataType, IntegralType):
                helpers[name], result = column.cast("bigint"), "bigint"
            else:
                helpers[name], result = column.cast("double"), "double"
            fields.append((kind, name, result))
    ready = df.withColumns(helpers).select(*carried, *helpers)
    by = [*keys, *order]
    dealt = ready.repartitionByRange(ranges, *by) if ranges else ready.repartitionByRange(*by)
    results = [StructField(f"_r{i}", LongType() if t == "bigint" else DoubleType()) for i, (*_, t) in enumerate(fields)]
    kept, marks = list(ready.schema), [StructField("_lacks", BooleanType()), StructField("_last", BooleanType())]
    first = dealt.sortWithinPartitions(*by).mapInArrow(_stream(ready.columns, keys, fields, rows, True), StructType([*kept, *results, *marks]))
    written = cut(first, "ranges")
    final = [*[F.col(c) for c in back], *[F.col(f"_r{i}").alias(name) for i, name in enumerate(made)]]
    edge = written.filter("_lacks or _last").select(*ready.columns, "_lacks").repartition(*keys).sortWithinPartitions(*by)
    linked = edge.mapInArrow(_stream([*ready.columns, "_lacks"], keys, fields, rows, False), StructType([*kept, marks[0], *results]))
    return written.filter("not _lacks").select(*final).unionByName(linked.filter("_lacks").select(*final))
