"""Arrow batches inside tasks: columns as lists, and differences of token lists, row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that are worked on at once.
ROWS = 512


def values(column: pa.Array) -> list:
    """A column's values; by way of numpy, which is quick, where no null turns numbers into others."""
    if column.null_count and not pa.types.is_string(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def starts(keys: list[pa.Array]) -> np.ndarray:
    """Where a row's keys differ from those of the row before it; nulls are equal, as are NaN."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for key in keys:
        codes = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Batches anew, so that rows that stand together and are equal in the first ``n_keys`` columns are in one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(starts(batch.columns[:n_keys])[-1])
        if held and not last and starts(pa.Table.from_batches([held[0].slice(0, 1), batch.slice(0, 1)]).combine_chunks().to_batches()[0].columns[:n_keys]).size == 1:
            held.append(batch)
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        last += rows.num_rows - batch.num_rows
        if last:
            yield rows.slice(0, last)
        held = [rows.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column as doubles, and where it is null."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def extent(own: np.ndarray, null: np.ndarray, first: np.ndarray, least: bool) -> pa.Array:
    """The least or largest number of each group that starts at ``first``. NaN is the largest; nulls don't count."""
    edge = np.fmin.reduceat(np.where(null, np.nan, own), first) if least else np.maximum.reduceat(np.where(null, -np.inf, own), first)
    return pa.array(edge, mask=np.logical_and.reduceat(null, first))


def in_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows (doc_id, page_no, line, x, idx, ..) of pages that stand together, sorted by line, x and idx within the page,
    and where a line starts."""
    for rows in whole_groups(batches, 2):
        page = np.zeros(rows.num_rows, dtype=np.int64)
        page[starts(rows.columns[:2])] = 1
        line, x, idx = (np.where(null, -np.inf, own) for own, null in map(numbers, rows.columns[2:5]))
        rows = rows.take(pa.array(np.lexsort((idx, x, line, np.cumsum(page)))))
        yield rows, starts(rows.columns[:3])


def _rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """By element of the lists its row, and its place there. Nulls are empty lists."""
    sizes = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _keyed(a: pa.ListArray, b: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(rows, places, keys) of both sides: elements have one key where row and value are equal."""
    flat_a, flat_b = a.flatten(), b.flatten()
    codes = pa.concat_arrays([flat_a, flat_b]).dictionary_encode().indices.to_numpy().astype(np.int64)
    (rows_a, at_a), (rows_b, at_b) = _rows(a), _rows(b)
    codes = codes * len(a) + np.concatenate([rows_a, rows_b])
    return rows_a, at_a, codes[: len(rows_a)], rows_b, at_b, codes[len(rows_a) :]


def only_in_one(a: pa.ListArray, b: pa.ListArray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(rows, places) of the elements of ``a`` that ``b`` doesn't have in its row, and those of ``b`` likewise."""
    rows_a, at_a, keys_a, rows_b, at_b, keys_b = _keyed(a, b)
    in_a, in_b = ~np.isin(keys_a, keys_b), ~np.isin(keys_b, keys_a)
    return (rows_a[in_a], at_a[in_a]), (rows_b[in_b], at_b[in_b])


def surplus(a: pa.ListArray, b: pa.ListArray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(rows, first places, how often) of the different elements of ``a`` that stand there more often than in the
    row's list of ``b``, by row and place, and those of ``b`` likewise."""
    rows_a, at_a, keys_a, rows_b, at_b, keys_b = _keyed(a, b)
    (one, first_a, n_a), (two, first_b, n_b) = (np.unique(k, return_index=True, return_counts=True) for k in (keys_a, keys_b))

    def more(keys, first, n, rows, at, other, n_other):
        if len(other):
            place = np.minimum(np.searchsorted(other, keys), len(other) - 1)
            n = n - np.where(other[place] == keys, n_other[place], 0)
        kept = n > 0
        order = np.argsort(first[kept], kind="stable")  # elements are in order of rows and places
        first, n = first[kept][order], n[kept][order]
        return rows[first], at[first], n

    return more(one, first_a, n_a, rows_a, at_a, two, n_b), more(two, first_b, n_b, rows_b, at_b, one, n_a)


def first_words(spelled: pa.ListArray, rows: np.ndarray, at: np.ndarray, n: np.ndarray, most: int) -> list[str]:
    """By row the first ``most`` of its surplus elements, each as often as it is in surplus, joined by a space."""
    start = spelled.offsets.to_numpy()[:-1] - spelled.offsets[0].as_py()
    n = np.minimum(n, most)
    total = np.cumsum(n) - n
    head = np.searchsorted(rows, np.arange(len(spelled)))
    before = total - (total[head[rows]] if len(rows) else 0)
    kept = before < most
    rows, at, n = rows[kept], at[kept], np.minimum(n[kept], most - before[kept])
    words = values(spelled.flatten().take(pa.array(np.repeat(start[rows] + at, n))))
    ends = np.cumsum(np.bincount(rows, weights=n, minlength=len(spelled)).astype(np.int64)).tolist()
    return [" ".join(words[low:high]) for low, high in zip([0, *ends[:-1]], ends)]
