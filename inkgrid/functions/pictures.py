"""Pictures as arrays: the pixel rows of one image become NumPy arrays in one task, and rows again.

Spark deals the images out and one image is the unit of memory. A null value counts as 0. A picture
with a missing or repeated pixel is an error, as everything after the gap would shift.

A picture row (image_id, height, width, n_channels, data) holds a whole picture as bytes. Steps that stay within a
picture are fused on such rows by ``map_rows``: nothing is shuffled, and a pixel is as many bytes as it has channels.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

KEY = ("image_id", "y", "x")


def layout(table: pa.Table) -> tuple[np.ndarray, int, int]:
    """Where each pixel row lies in row-major order, height and width."""
    y, x = table["y"].to_numpy().astype(np.int64), table["x"].to_numpy().astype(np.int64)
    height, width = int(y.max()) + 1, int(x.max()) + 1
    place = y * width + x
    if len(place) != height * width or y.min() < 0 or x.min() < 0 or (np.bincount(place, minlength=height * width) != 1).any():
        raise ValueError(f"image {table['image_id'][0].as_py()} has missing or repeated pixels")
    return place, height, width


def plane(table: pa.Table, column: str, place: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.empty(height * width, np.int32)
    out[place] = pc.fill_null(table[column], 0).to_numpy()
    return out.reshape(height, width)


def map_pictures(pixels: DataFrame, change: Callable[..., np.ndarray | tuple[np.ndarray, ...]], columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """The same rows with ``columns`` changed picture by picture; other columns stay.

    Rows that are dealt out by image already are not shuffled again.
    """
    schema = pixels.schema
    out = StructType([StructField(f.name, IntegerType()) if f.name in columns else f for f in schema.fields])

    def run(table: pa.Table) -> pa.Table:
        place, height, width = layout(table)
        found = change(*[plane(table, c, place, height, width) for c in columns])
        for column, array in zip(columns, found if isinstance(found, tuple) else (found,), strict=True):
            table = table.set_column(table.schema.get_field_index(column), column, pa.array(array.reshape(-1)[place].astype(np.int32)))
        return table

    return pixels.groupBy("image_id").applyInArrow(run, out)


def rows_of(image_id: pa.Scalar, planes: dict[str, np.ndarray]) -> pa.Table:
    """Pixel rows of arrays of one shape."""
    height, width = next(iter(planes.values())).shape
    y, x = np.divmod(np.arange(height * width, dtype=np.int32), np.int32(max(width, 1)))
    return pa.table({"image_id": pa.repeat(image_id, height * width), "y": pa.array(y), "x": pa.array(x), **{n: pa.array(a.reshape(-1).astype(np.int32)) for n, a in planes.items()}})


PICTURE = "height int, width int, n_channels int, data binary"
_PLANE = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("n_channels", pa.int32()), ("data", pa.binary())])
ARROW = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
#: Bytes of pictures that one Arrow batch returns, or one picture.
RETURNED = 1 << 24


def array_of(height: int, width: int, n_channels: int, data: bytes) -> np.ndarray:
    """Bytes as an array: two axes for one channel, else a third of channels."""
    a = np.frombuffer(data, np.uint8)
    return a.reshape(height, width) if n_channels == 1 else a.reshape(height, width, n_channels)


def row_of(a: np.ndarray) -> dict[str, object]:
    return {"height": a.shape[0], "width": a.shape[1], "n_channels": 1 if a.ndim == 2 else a.shape[2], "data": a.astype(np.uint8).tobytes()}


def packed(pixels: DataFrame) -> DataFrame:
    """Pixel rows to picture rows, of b, g, r or of v: one exchange by image, none if they are dealt out so."""

    def run(table: pa.Table) -> pa.Table:
        place, height, width = layout(table)
        planes = [plane(table, c, place, height, width) for c in columns]
        row = {"image_id": table["image_id"][0], **row_of(np.stack(planes, axis=-1) if len(planes) > 1 else planes[0])}
        return pa.Table.from_pylist([row], pa.schema([("image_id", table.schema.field("image_id").type), *_PLANE]))

    columns = ["v"] if "v" in pixels.columns else ["b", "g", "r"]
    kind = pixels.schema["image_id"].dataType.simpleString()
    return pixels.select(*KEY, *columns).groupBy("image_id").applyInArrow(run, f"image_id {kind}, {PICTURE}")


#: Values of pictures of one shape that are worked on as one stack, or one picture.
STACKED = 1 << 18
#: Pixel rows of an Arrow batch, unless a picture's last ones are fewer.
ROWS = 100_000


def by_shape(pictures: Sequence[np.ndarray], change: Callable[[np.ndarray], Iterable], least: int = 1) -> list:
    """What ``change`` makes of each picture; it gets pictures of one shape as a stack, along a first axis. A picture counts as ``least`` values at least."""
    groups, out = defaultdict(list), [None] * len(pictures)
    for i, p in enumerate(pictures):
        groups[p.shape].append(i)
    for at in groups.values():
        n = max(1, STACKED // max(least, pictures[at[0]].size))
        for low in range(0, len(at), n):
            part = at[low : low + n]
            for i, found in zip(part, change(np.stack([pictures[i] for i in part])), strict=True):
                out[i] = found
    return out


@lru_cache(maxsize=32)
def _places(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(a.astype(np.int32) for a in np.divmod(np.arange(height * width), max(width, 1)))


def pixel_batches(found: Iterable[tuple[object, tuple[np.ndarray, ...]]], kind: pa.DataType, columns: tuple[str, ...], tops: Sequence[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Pixel rows of pictures, told by image_id and planes: small pictures share a batch, large ones are cut. ``tops`` are the first scanlines, 0 unless given."""

    def batch(held: list[tuple[object, tuple[np.ndarray, ...]]], places: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = pa.array([i for i, _ in held], kind).take(pa.array(np.repeat(np.arange(len(held)), [len(y) for y, _ in places])))
        joined = [np.concatenate(a).astype(np.int32, copy=False) for a in (*zip(*places, strict=True), *zip(*[planes for _, planes in held], strict=True))]
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, joined)], ["image_id", "y", "x", *columns])

    held, places, n = [], [], 0
    for k, (image_id, planes) in enumerate(found):
        top = tops[k] if tops else 0
        height, width = planes[0].shape
        flat = tuple(p.reshape(-1) for p in planes)
        if height * width > ROWS:
            for low in range(0, height * width, ROWS):
                y, x = np.divmod(np.arange(low, min(low + ROWS, height * width)), width)
                yield batch([(image_id, tuple(f[low : low + ROWS] for f in flat))], [(y + top, x)])
            continue
        held.append((image_id, flat))
        y, x = _places(height, width)
        places.append((y + np.int32(top), x) if top else (y, x))
        n += height * width
        if n >= ROWS:
            yield batch(held, places)
            held, places, n = [], [], 0
    if n:
        yield batch(held, places)


def _pictures(batch: pa.RecordBatch) -> Iterator[tuple[list[object], list[np.ndarray]]]:
    """Ids and arrays of a batch's pictures, some ``RETURNED`` bytes at a time. Those without bytes or a size are left out; bytes that do not fit the size are an error that names the image."""
    ids, arrays, held = [], [], 0
    for image_id, h, w, c, data in zip(*(batch.column(n).to_pylist() for n in ("image_id", "height", "width", "n_channels")), batch.column("data"), strict=True):
        if h is None or w is None or c is None or not data.is_valid:
            continue
        a = np.frombuffer(data.as_buffer(), np.uint8)
        if h < 0 or w < 0 or c < 1 or len(a) != h * w * c:
            raise ValueError(f"image {image_id} has {len(a)} bytes, which its size does not ask for")
        ids.append(image_id)
        arrays.append(a.reshape(h, w) if c == 1 else a.reshape(h, w, c))
        held += len(a)
        if held >= RETURNED:
            yield ids, arrays
            ids, arrays, held = [], [], 0
    if ids:
        yield ids, arrays


def pixels_of(rows: DataFrame, change: Callable[[np.ndarray], np.ndarray | tuple[np.ndarray, ...]], columns: tuple[str, ...] = ("v",), least: int = 1) -> DataFrame:
    """Pixel rows of what ``change`` makes of picture rows; nothing is shuffled.

    ``change`` gets pictures of one shape as a stack and gives a plane for each of ``columns``, stacked alike.
    """

    def planes(stack: np.ndarray) -> Iterable[tuple[np.ndarray, ...]]:
        found = change(stack)
        return zip(*found, strict=True) if isinstance(found, tuple) else ((p,) for p in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = ((i, p) for ids, arrays in _pictures(batch) for i, p in zip(ids, by_shape(arrays, planes, least), strict=True))
            yield from pixel_batches(each, batch.schema.field("image_id").type, columns)

    schema = f"image_id {rows.schema['image_id'].dataType.simpleString()}, y int, x int, " + ", ".join(f"{c} int" for c in columns)
    return rows.select("image_id", "height", "width", "n_channels", "data").mapInArrow(run, schema)


def unpacked(rows: DataFrame, picture: str | None = None) -> DataFrame:
    """Picture rows, or their column ``picture``, to pixel rows of b, g, r (equal for one channel); nothing is shuffled.

    A picture without bytes or without a size has no pixels; bytes that do not fit the size are an error that names the image.
    """
    channels = lambda a: (a,) * 3 if a.ndim == 3 else tuple(a[..., k if a.shape[-1] >= 3 else 0] for k in range(3))
    return pixels_of(rows.select("image_id", f"{picture}.*") if picture else rows, channels, ("b", "g", "r"))


def _column(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow values, of an array with two axes as lists."""
    if a.ndim == 1:
        return pa.array(a, kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.reshape(-1), kind.value_type))


def rows_of_pictures(rows: DataFrame, change: Callable[[np.ndarray], Iterable[tuple]], columns: str, least: int = 1) -> DataFrame:
    """Rows of any number for each picture row: image_id and ``columns`` (their SQL schema). ``change`` gets stacks, and gives for each picture an array for each column; nothing is shuffled."""
    names, types = zip(*[(n, ARROW[t]) for n, t in (c.split() for c in columns.split(", "))], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, arrays in _pictures(batch):
                found = by_shape(arrays, change, least)
                n, size = [len(f[0]) for f in found], np.cumsum([max(a.size for a in f) for f in found])
                low = 0
                while low < len(n):
                    # As many pictures as give some ``STACKED`` values, or one.
                    high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + STACKED, "right")))
                    which = np.repeat(np.arange(low, high), n[low:high])
                    values = [_column(np.concatenate([f[k] for f in found[low:high]]), t) for k, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("image_id").type).take(pa.array(which)), *values], ["image_id", *names])
                    low = high

    return rows.select("image_id", "height", "width", "n_channels", "data").mapInArrow(run, f"image_id {rows.schema['image_id'].dataType.simpleString()}, {columns}")


def map_rows(rows: DataFrame, change: Callable[[list[np.ndarray]], list[dict[str, object]]], pictures: tuple[str, ...], scalars: str = "", keep: tuple[str, ...] = ("image_id",), tolerant: bool = False) -> DataFrame:
    """What ``change`` makes of each picture: the columns ``keep``, those of ``pictures`` (as structs), and ``scalars`` (their SQL schema).

    ``change`` gets some pictures at a time, of any shapes. With ``tolerant`` a picture that it cannot do keeps its row, with
    nulls and the message in a column ``failure``, null for the others.
    """
    kept = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    plain = [(n, ARROW[t]) for n, t in (x.split() for x in scalars.split(",") if x)]
    struct = f"struct<{PICTURE.replace(' int', ': int').replace(' binary', ': binary')}>"
    schema = ", ".join([*kept, *[f"{p} {struct}" for p in pictures], *([scalars] if scalars else []), *(["failure string"] if tolerant else [])])

    def made(sized: list[tuple], alone: bool) -> list[dict[str, object]]:
        try:
            return change([array_of(*x) for x in sized])
        except Exception as e:
            if not tolerant:
                raise
            return [{"failure": f"{type(e).__name__}: {e}"}] if alone else [f for x in sized for f in made([x], True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = pa.schema([*[(c, batch.schema.field(c).type) for c in keep], *[(p, _PLANE) for p in pictures], *plain, *([("failure", pa.string())] if tolerant else [])])
            length = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("data")])
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(length, (length[low - 1] if low else 0) + RETURNED, "right")))
                part = batch.slice(low, high - low)
                found = made(list(zip(*(part.column(n).to_pylist() for n in ("height", "width", "n_channels", "data")), strict=True)), high - low == 1)
                columns = {c: part.column(c).to_pylist() for c in keep}
                yield pa.RecordBatch.from_pylist([{**{c: columns[c][i] for c in keep}, **{n: row_of(a) if n in pictures else a for n, a in f.items()}} for i, f in enumerate(found)], fields)
                low = high

    return rows.select(*dict.fromkeys([*keep, "height", "width", "n_channels", "data"])).mapInArrow(run, schema)


def packed_rows(rows: DataFrame, picture: str) -> DataFrame:
    """The column ``picture`` as picture rows."""
    return rows.select("image_id", f"{picture}.*")


def pictures_of(rows: DataFrame, change: Callable[[np.ndarray], Iterable[np.ndarray]]) -> DataFrame:
    """Picture rows of what ``change`` makes of picture rows, which it gets as stacks; nothing is shuffled."""
    return packed_rows(map_rows(rows, lambda p: [{"picture": a} for a in by_shape(p, change)], ("picture",)), "picture")


def reflected(places: np.ndarray, n: int) -> np.ndarray:
    """Indices reflected into ``0..n-1`` without repeating the edge."""
    period = max(2 * (n - 1), 1)
    k = places % period
    return np.where(k < n, k, period - k) if n > 1 else np.zeros_like(places)


def slide(a: np.ndarray, before: int, after: int, axis: int, highest: bool) -> np.ndarray:
    """Largest (or smallest) value from ``before`` places back to ``after`` ahead; what lies outside does not count."""
    pick, least = (np.maximum, np.iinfo(a.dtype).min) if highest else (np.minimum, np.iinfo(a.dtype).max)
    a = np.moveaxis(a, axis, -1)
    sides = [(0, 0)] * (a.ndim - 1) + [(before, after)]
    out, seen, width = np.pad(a, sides, constant_values=least), 1, before + after + 1
    while 2 * seen <= width:
        out, seen = pick(out[..., :-seen], out[..., seen:]), 2 * seen
    if seen < width:
        out = pick(out[..., : out.shape[-1] - (width - seen)], out[..., width - seen :])
    return np.moveaxis(out, -1, axis)
