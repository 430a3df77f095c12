"""Pictures in bands of scanlines, for pictures larger than a task.

A band row holds some scanlines of one channel: image_id, height and width of the whole picture, step
(scanlines of a full band), band, top (its first scanline), data (one byte a value, or four). Every
operator on bands takes the scanlines it needs from neighbouring bands, its halo, in one exchange of
bytes; a task holds a band and its halo, never a picture.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.pictures import STACKED, layout, pixel_batches, plane
from inkgrid.functions.tables import beside, written

COLUMNS = ("height", "width", "step", "band", "top", "data")
SCHEMA = "image_id {0}, height int, width int, step int, band int, top int, data binary"


@dataclass
class Band:
    """Scanlines ``low`` and on of pictures of one size, stacked, of which ``top`` to ``top + rows`` are the bands' own."""

    image_id: pa.Array
    height: int
    width: int
    step: int
    band: int
    low: int
    data: np.ndarray

    @property
    def top(self) -> int:
        return self.band * self.step

    @property
    def rows(self) -> int:
        return min(self.step, self.height - self.top)

    def own(self, a: np.ndarray | None = None) -> np.ndarray:
        return (self.data if a is None else a)[:, self.top - self.low : self.top - self.low + self.rows]

    def table(self, a: np.ndarray) -> pa.Table:
        """The bands' own scanlines as rows, in bytes where they fit."""
        a = a.astype(np.uint8 if a.size and 0 <= a.min() and a.max() < 256 else "<i4")
        same = [pa.repeat(pa.scalar(x, pa.int32()), len(a)) for x in (self.height, self.width, self.step, self.band, self.top)]
        return pa.Table.from_arrays([self.image_id, *same, pa.array([x.tobytes() for x in a], pa.binary())], ["image_id", *COLUMNS])


def _array(data: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == width * rows else "<i4").reshape(rows, width).astype(np.int32)


def _kind(df: DataFrame) -> str:
    return df.schema["image_id"].dataType.simpleString()


def bands_of_pixels(pixels: DataFrame, step: int) -> DataFrame:
    """Bands of pixel rows (v): one exchange by band; each band gets its picture's size from a narrow join. A band with a missing or repeated pixel is an error."""

    def run(table: pa.Table) -> pa.Table:
        top = table["y"][0].as_py() // step * step
        table = table.set_column(table.schema.get_field_index("y"), "y", pa.array(table["y"].to_numpy() - top))
        place, rows, width = layout(table)
        return Band(table["image_id"].combine_chunks()[:1], top + rows, width, step, top // step, top, np.zeros(0)).table(plane(table, "v", place, rows, width)[None])

    parts = pixels.select("image_id", "y", "x", "v").groupBy("image_id", F.expr(f"y div {int(step)}").alias("part")).applyInArrow(run, SCHEMA.format(_kind(pixels)))
    parts = written(parts, "bands")
    # Until now a band's height is where it ends.
    sizes = parts.groupBy("image_id").agg(F.max("height").alias("height"), F.max("width").alias("width"), F.min("width").alias("least"), F.count("*").alias("n"))
    whole = (F.col("least") == F.col("width")) & (F.col("n") == F.ceil(F.col("height") / F.col("step")))
    joined = beside(parts.drop("height", "width"), sizes)
    message = F.concat(F.lit("image "), F.col("image_id").cast("string"), F.lit(" has missing or repeated pixels"))
    return joined.select("image_id", F.when(whole, F.col("height")).otherwise(F.raise_error(message).cast("int")).alias("height"), "width", "step", "band", "top", "data")


#: Bytes of bands that one Arrow batch returns, or one band.
SENT = 1 << 23


def _rows(batch: pa.RecordBatch, which: list[int], columns: list[list]) -> pa.RecordBatch:
    """Rows of bands, with the image ids of rows ``which`` of a batch."""
    return pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(which, pa.int64())), *[pa.array(c, pa.binary() if n == "data" else pa.int32()) for c, n in zip(columns, COLUMNS, strict=True)]], ["image_id", *COLUMNS])


def bands_of_pictures(rows: DataFrame, step: int) -> DataFrame:
    """Bands of picture rows of one channel; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in COLUMNS]
            which, size = [], 0
            for i, (height, width, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("height", "width")), batch.column("data"), strict=True)):
                held = data.as_buffer()
                for top in range(0, height, step):
                    which.append(i)
                    row = (height, width, step, top // step, top, held[top * width : min(top + step, height) * width].to_pybytes())
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
                    size += len(row[-1])
                    if size >= SENT:
                        yield _rows(batch, which, out)
                        out, which, size = [[] for _ in COLUMNS], [], 0
            if which:
                yield _rows(batch, which, out)

    return rows.select("image_id", "height", "width", "data").mapInArrow(run, SCHEMA.format(_kind(rows)))


def pixels_of_bands(bands: DataFrame) -> DataFrame:
    """Pixel rows (v) of bands; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tops = batch.column("image_id").to_pylist(), batch.column("top").to_pylist()
            sizes = zip(*(batch.column(c).to_pylist() for c in ("height", "width", "step", "top")), batch.column("data"), strict=True)
            planes = ((i, (_array(data.as_buffer(), width, min(step, height - top)),)) for i, (height, width, step, top, data) in zip(ids, sizes, strict=True))
            yield from pixel_batches(planes, batch.schema.field("image_id").type, ("v",), tops)

    return bands.select("image_id", *COLUMNS).mapInArrow(run, f"image_id {_kind(bands)}, y int, x int, v int")


Halo = Callable[[int, int], tuple[int, int]]


def with_halo(bands: DataFrame, halo: Halo | tuple[int, int], change: Callable[[Band], pa.Table], schema: str) -> DataFrame:
    """``change`` of every band with scanlines before and after it, as many as ``halo`` says (of a picture's height and width).

    Each band sends every band that asks for some of its scanlines just these: one exchange, and a
    halo may reach over many bands. At the picture's border the halo ends with the picture.
    """
    sizes = halo if callable(halo) else lambda height, width: halo
    kind = _kind(bands)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in COLUMNS]
            which, size = [], 0
            for i, (height, width, step, top, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("height", "width", "step", "top")), batch.column("data"), strict=True)):
                rows, (before, after) = min(step, height - top), sizes(height, width)
                data = data.as_buffer()
                wide = len(data) // rows
                first, last = max(0, (top - step - after) // step + 1), min((height - 1) // step, -(-(top + rows + before) // step) - 1)
                for to in range(first, last + 1):
                    a, b = max(top, to * step - before), min(top + rows, to * step + step + after)
                    if a < b:
                        which.append(i)
                        for c, x in zip(out, (height, width, step, to, a, data[(a - top) * wide : (b - top) * wide].to_pybytes()), strict=True):
                            c.append(x)
                        size += len(out[-1][-1])
                        if size >= SENT:
                            yield _rows(batch, which, out)
                            out, which, size = [[] for _ in COLUMNS], [], 0
            if which:
                yield _rows(batch, which, out)

    def stacked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole bands of a table, sorted by band and scanline: those of one geometry together."""
        ids, height, width, step, band, top = (table[c].to_pylist() for c in ("image_id", *COLUMNS[:-1]))
        data, groups = table["data"].combine_chunks(), defaultdict(list)
        for a, b in _runs(ids, band):
            tops = [*top[a:b], min(height[a], (band[a] + 1) * step[a] + sizes(height[a], width[a])[1])]
            parts = [_array(data[a + k].as_buffer(), width[a], tops[k + 1] - tops[k]) for k in range(b - a)]
            groups[height[a], width[a], step[a], band[a], tops[0]].append((a, parts[0] if len(parts) == 1 else np.concatenate(parts)))
        for key, held in groups.items():
            n = max(1, STACKED // max(1, held[0][1].size))
            for low in range(0, len(held), n):
                part = held[low : low + n]
                own = table["image_id"].take(pa.array([a for a, _ in part])).combine_chunks()
                yield from change(Band(own, *key, np.stack([x for _, x in part]))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last band of what was read waits for its next rows."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                held.append(batch.slice(low, 1000))
                table = pa.Table.from_batches(held)
                cut = _runs(table["image_id"].to_pylist(), table["band"].to_pylist())[-1][0]
                yield from stacked(table.slice(0, cut)) if cut else ()
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from stacked(pa.Table.from_batches(held))

    return dealt(bands.select("image_id", *COLUMNS).mapInArrow(send, SCHEMA.format(kind))).mapInArrow(run, schema)


def _runs(ids: list[object], band: list[int]) -> list[tuple[int, int]]:
    """First and last row (exclusive) of each band."""
    cuts = [0, *[i for i in range(1, len(ids)) if band[i] != band[i - 1] or ids[i] != ids[i - 1]], len(ids)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if ids else []


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a band together, by scanline: one exchange, many small bands in one Python call."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "image_id", "band").sortWithinPartitions("image_id", "band", "top")


def map_halo(bands: DataFrame, halo: Halo | tuple[int, int], kernel: Callable[[Band], np.ndarray]) -> DataFrame:
    """Bands of what ``kernel`` makes of a band with its halo: the band's own scanlines."""
    return with_halo(bands, halo, lambda b: b.table(kernel(b)), SCHEMA.format(_kind(bands)))


def whole_pictures(batches: Iterator[pa.RecordBatch], change: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """``change`` of rows sorted by image_id, the rows of a picture never apart, many small pictures at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column("image_id").to_pylist()
        cut = next((i for i in range(len(ids) - 1, 0, -1) if ids[i] != ids[i - 1]), 0)
        if held and (cut or ids[0] != held[-1].column("image_id")[0].as_py()):
            own = 0 if ids[0] != held[-1].column("image_id")[0].as_py() else next((i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids))
            yield from change(pa.Table.from_batches([*held, batch.slice(0, own)])).combine_chunks().to_batches()
            held, batch, cut = [], batch.slice(own), cut - own
        if cut > 0:
            yield from change(pa.Table.from_batches([batch.slice(0, cut)])).combine_chunks().to_batches()
            batch = batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield from change(pa.Table.from_batches(held)).combine_chunks().to_batches()
