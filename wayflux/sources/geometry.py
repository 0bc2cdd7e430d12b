"""WKB geometries as arrays of points, decoded once at ingest, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LINE, POLYGON, MULTILINE = 2, 3, 5
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


class _Bytes:
    """The values of a binary column as one run of bytes, read at many places at once."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_binary())
        _, bounds, data = column.buffers()
        at = np.frombuffer(bounds, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.start, self.end = at[:-1], at[1:]
        self.good = ~column.is_null().to_numpy(zero_copy_only=False)

    def values(self, at: np.ndarray, big: np.ndarray, kind: str) -> np.ndarray:
        """Numbers of a NumPy kind that start at ``at``, of which those marked ``big`` are big-endian."""
        width = np.dtype(kind).itemsize
        raw = self.data[at[:, None] + np.arange(width)]
        raw[big] = raw[big][:, ::-1]
        return np.ascontiguousarray(raw).view(f"<{kind}")[:, 0]

    def fits(self, rows: np.ndarray, at: np.ndarray, need: np.ndarray | int) -> np.ndarray:
        """Which of ``rows`` hold ``need`` more bytes from ``at``; the others are spoilt."""
        good = at + need <= self.end[rows]
        self.good[rows[~good]] = False
        return good

    def header(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """rows, place behind the header, big-endian, geometry type, bytes of a point: rows whose header can be read."""
        good = self.fits(rows, at, 5)
        rows, at = rows[good], at[good]
        order = self.data[at]
        big = order == 0
        code = self.values(at + 1, big, "u4").astype(np.int64)
        flat = code & 0x0FFFFFFF  # the upper bits mark Z, M and a reference system in one dialect, thousands Z and M in the other
        z, m = ((code >> 31) & 1) | np.isin(flat // 1000, (1, 3)), ((code >> 30) & 1) | np.isin(flat // 1000, (2, 3))
        known = (order <= 1) & (flat // 1000 <= 3)
        self.good[rows[~known]] = False
        at = at + 5 + 4 * ((code >> 29) & 1)
        return rows[known], at[known], big[known], flat[known] % 1000, 8 * (2 + z + m)[known]


def _parts(column: pa.Array, wanted: tuple[int, ...]) -> tuple[_Bytes, tuple[np.ndarray, ...]]:
    """Of the column's geometries the runs of points: row, first byte, points, bytes of a point, big-endian; in order."""
    raw = _Bytes(column)
    rows, at, big, kind, wide = raw.header(np.flatnonzero(raw.good), raw.start[raw.good])
    keep = np.isin(kind, wanted)
    raw.good[rows[~keep]] = False
    rows, at, big, kind, wide = (v[keep] for v in (rows, at, big, kind, wide))
    good = raw.fits(rows, at, 4)
    rows, at, big, kind, wide = (v[good] for v in (rows, at, big, kind, wide))
    n = np.where(kind == LINE, 1, raw.values(at, big, "u4").astype(np.int64))
    at = at + np.where(kind == LINE, 0, 4)
    found, j = [], 0
    while len(rows):  # the j-th part of every geometry that has one
        more = (j < n) & raw.good[rows]
        rows, at, big, kind, wide, n = (v[more] for v in (rows, at, big, kind, wide, n))
        nested = kind == MULTILINE
        if nested.any():  # a part of a multi-line is a line string with a header of its own
            held, behind, part_big, part_kind, part_wide = raw.header(rows[nested], at[nested])
            raw.good[held[part_kind != LINE]] = False
            lines = raw.good[rows]
            place = np.searchsorted(held, rows[nested & lines])
            rows, at, big, kind, wide, n, nested = (v[lines] for v in (rows, at, big, kind, wide, n, nested))
            at[nested], big[nested], wide[nested] = behind[place], part_big[place], part_wide[place]
        good = raw.fits(rows, at, 4)
        rows, at, big, kind, wide, n = (v[good] for v in (rows, at, big, kind, wide, n))
        points = raw.values(at, big, "u4").astype(np.int64)
        good = raw.fits(rows, at + 4, points * wide)
        rows, at, big, kind, wide, n, points = (v[good] for v in (rows, at, big, kind, wide, n, points))
        found.append((rows, at + 4, points, wide, big))
        at, j = at + 4 + points * wide, j + 1
    row, first, points, wide, big = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
    order = np.argsort(row, kind="stable")
    order = order[raw.good[row[order]]]
    return raw, (row[order], first[order], points[order], wide[order], big[order].astype(bool))


def _lists(sizes: np.ndarray, values: pa.Array, mask: np.ndarray | None = None) -> pa.Array:
    bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(bounds, values, mask=None if mask is None else pa.array(mask))


def _decoded(column: pa.Array, wanted: tuple[int, ...], nested: bool) -> pa.Array:
    raw, (row, first, points, wide, big) = _parts(column, wanted)
    place = np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)
    at, big = np.repeat(first, points) + place * np.repeat(wide, points), np.repeat(big, points)
    flat = pa.StructArray.from_arrays([pa.array(raw.values(at + shift, big, "f8")) for shift in (0, 8)], fields=list(POINT))
    count = np.bincount(row, minlength=len(column))
    if nested:
        return _lists(count, _lists(points, flat), ~raw.good)
    return _lists(np.bincount(row, weights=points, minlength=len(column)).astype(np.int64), flat, ~raw.good)


def _with(frame: DataFrame, column: str, kind: T.DataType, wanted: tuple[int, ...], nested: bool) -> DataFrame:
    at = frame.columns.index(column)
    schema = T.StructType([T.StructField(f.name, kind if f.name == column else f.dataType) for f in frame.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_decoded(c, wanted, nested) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return frame.mapInArrow(run, schema)


def decode_lines(frame: DataFrame, column: str = "geometry") -> DataFrame:
    """WKB line strings as arrays of points; further dimensions are dropped, either byte order is read.

    A null, another kind of geometry, and bytes that end before their points do are null; a line without points is an
    empty array; bytes behind the geometry are not read; an empty table gives an empty one.
    """
    return _with(frame, column, POINTS, (LINE,), False)


def decode_parts(frame: DataFrame, column: str = "geometry") -> DataFrame:
    """WKB line strings, multi-lines and polygons as arrays of their lines or rings, each an array of points.

    A line string is one part, a polygon's first part its outer ring. Null and damaged values as in ``decode_lines``.
    """
    return _with(frame, column, T.ArrayType(POINTS), (LINE, POLYGON, MULTILINE), True)
