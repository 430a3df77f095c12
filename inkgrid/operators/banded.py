"""Operators on pictures in bands: the same results as on whole pictures, in tasks of one band and its halo."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions.bands import COLUMNS, SCHEMA, SENT, Band, map_halo, whole_pictures, with_halo
from inkgrid.functions.pictures import ARROW, reflected
from inkgrid.functions.tables import beside, written
from inkgrid.operators import geometry, lines, neighborhood, regions, stats

#: Pixels of a picture whose bands are fewer bytes than the votes of its lines.
MAX_WHOLE = 1 << 20
#: Pictures whose contrast tables (up to 16 KB each) or peaks may be broadcast.
MAX_BROADCAST_PICTURES = 1000


def _kind(df: DataFrame) -> str:
    return df.schema["image_id"].dataType.simpleString()


# Neighbourhoods.


def gaussian_blur(bands: DataFrame, k: int = 51) -> DataFrame:
    """Scanlines are blurred where they lie; the blur down the columns takes ``k // 2`` scanlines of either side, reflected at the picture's border."""

    def kernel(b: Band) -> np.ndarray:
        place = reflected(np.arange(b.top - k // 2, b.top + b.rows + k - 1 - k // 2), b.height) - b.low
        return neighborhood.along_columns(neighborhood.along_rows(b.data, k)[:, place], k)

    return map_halo(bands, (k // 2, k // 2), kernel)


def _reach(k: int, times: int) -> tuple[int, int]:
    return times * (k // 2), times * (k - 1 - k // 2)


def dilate(bands: DataFrame, kw: int, kh: int) -> DataFrame:
    return map_halo(bands, _reach(kh, 1), lambda b: b.own(neighborhood.rect_plane(b.data, kw, kh, True)))


def erode(bands: DataFrame, kw: int, kh: int) -> DataFrame:
    return map_halo(bands, _reach(kh, 1), lambda b: b.own(neighborhood.rect_plane(b.data, kw, kh, False)))


def morph_close(bands: DataFrame, kw: int = 35, kh: int = 35) -> DataFrame:
    """Both steps in one exchange: the halo is as wide as they reach together."""
    return map_halo(bands, _reach(kh, 2), lambda b: b.own(neighborhood.rect_plane(neighborhood.rect_plane(b.data, kw, kh, True), kw, kh, False)))


def morph_open(bands: DataFrame, kw: int = 20, kh: int = 20) -> DataFrame:
    return map_halo(bands, _reach(kh, 2), lambda b: b.own(neighborhood.rect_plane(neighborhood.rect_plane(b.data, kw, kh, False), kw, kh, True)))


def morph_close_ellipse(bands: DataFrame, k: int | None = 51) -> DataFrame:
    """Without ``k`` each picture's kernel follows its size, and so does the halo."""
    own = lambda height, width: k or neighborhood.background_kernel(height, width)
    return map_halo(bands, lambda h, w: _reach(own(h, w), 2), lambda b: b.own(neighborhood.background_plane(b.data, own(b.height, b.width))))


def thin_edges(bands: DataFrame) -> DataFrame:
    """Sobel and thinning: two scanlines of either side."""

    def kernel(b: Band) -> np.ndarray:
        row = np.arange(max(0, b.top - 1), min(b.height, b.top + b.rows + 1))
        up, here, down = (b.data[:, reflected(row + d, b.height) - b.low] for d in (-1, 0, 1))
        return neighborhood.thinned(up, here, down)[:, b.top - row[0] :][:, : b.rows]

    return map_halo(bands, (2, 2), kernel)


# Statistics: partial results of a band are merged by picture.


def otsu_threshold(bands: DataFrame) -> DataFrame:
    """Threshold of each picture from the bands' histograms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = np.bincount(np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8), minlength=256)
                v = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("image_id")[i], len(v)), pa.array(v, pa.int32()), pa.array(n[v], pa.int64())], ["image_id", "v", "n"])

    counts = bands.select("image_id", "data").mapInArrow(count, f"image_id {_kind(bands)}, v int, n long").groupBy("image_id", "v").agg(F.sum("n").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        n = np.zeros(256, np.int64)
        n[table["v"].to_numpy()] = table["n"].to_numpy()
        return pa.table({"image_id": table["image_id"].slice(0, 1), "t": pa.array([stats.threshold_of(n)], pa.int32())})

    return counts.groupBy("image_id").applyInArrow(run, f"image_id {_kind(bands)}, t int")


def blur_score(bands: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Sums of the Laplacian by band, exact; whole numbers of any size in the end."""

    def sums(b: Band) -> pa.Table:
        row = np.arange(b.top, b.top + b.rows)
        up, here, down = (b.data[:, reflected(row + d, b.height) - b.low].astype(np.int64) for d in (-1, 0, 1))
        g = up + down + neighborhood.around(here, 0, -1) + neighborhood.around(here, 0, 1) - 4 * here
        return pa.table({"image_id": b.image_id, "n": [g[0].size] * len(g), "s": g.sum((1, 2)), "q": (g * g).sum((1, 2))})

    kind = _kind(bands)
    found = with_halo(bands, (1, 1), sums, f"image_id {kind}, n long, s long, q long").groupBy("image_id").agg(*[F.sum(c).alias(c) for c in "nsq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [stats.sharpness_of(*x, threshold) for x in zip(*(batch.column(c).to_pylist() for c in "nsq"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array([s for s, _ in scores], pa.float64()), pa.array([b for _, b in scores], pa.bool_())], ["image_id", "blur_score", "is_blurry"])

    return found.mapInArrow(run, f"image_id {kind}, blur_score double, is_blurry boolean")


def clahe_apply(bands: DataFrame, clip: float = 1.5, tiles: int = 8) -> DataFrame:
    """Contrast by tiles: the bands' tile histograms are merged, and the tables come back to the bands of their picture."""
    kind = _kind(bands)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i in range(batch.num_rows):
                height, width, top = (batch.column(c)[i].as_py() for c in ("height", "width", "top"))
                v = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(-1, width)
                high, wide = -(-height // tiles), -(-width // tiles)
                # Scanlines of the picture, padded by reflection, that come from this band.
                down = reflected(np.arange(high * tiles), height) - top
                mine = np.flatnonzero((down >= 0) & (down < len(v)))
                across = reflected(np.arange(wide * tiles), width)
                for ty in np.unique(mine // high):
                    lines = v[down[mine[mine // high == ty]]][:, across]
                    n = np.bincount(((np.arange(wide * tiles) // wide)[None, :] * 256 + lines).ravel(), minlength=tiles * 256)
                    bins = np.flatnonzero(n)
                    for c, x in zip(out, (i, int(ty), high * wide, bins.astype("<i4").tobytes(), n[bins].astype("<i8").tobytes()), strict=True):
                        c.append(x)
            which, *rest = out
            if which:
                yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(which)), *[pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)]], ["image_id", "ty", "area", "bins", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = []
            for i in range(batch.num_rows):
                parts = batch.column("parts")[i].values
                counts = np.zeros(tiles * tiles * 256, np.int64)
                for ty, bins, n in zip(parts.field("ty").to_pylist(), parts.field("bins"), parts.field("n"), strict=True):
                    counts[ty * tiles * 256 + np.frombuffer(bins.as_buffer(), "<i4")] += np.frombuffer(n.as_buffer(), "<i8")
                tables.append(stats.tables_of(counts.reshape(-1, 256), clip, batch.column("area")[i].as_py()).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(tables, pa.binary())], ["image_id", "luts"])

    # Only the values that a band has are sent; those of all bands of a picture meet as one row.
    parts = bands.select("image_id", "height", "width", "top", "data").mapInArrow(count, f"image_id {kind}, ty int, area int, bins binary, n binary")
    met = parts.groupBy("image_id").agg(F.max("area").alias("area"), F.collect_list(F.struct("ty", "bins", "n")).alias("parts"))
    luts = met.mapInArrow(merged, f"image_id {kind}, luts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                height, width, step, band = (batch.column(c)[i].as_py() for c in ("height", "width", "step", "band"))
                lut = np.frombuffer(batch.column("luts")[i].as_buffer(), np.uint8).reshape(-1, 256).astype(np.int32)
                v = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(-1, width)
                out = stats.mixed_tables(v, lut, (height, width), tiles, band * step)
                yield from Band(batch.column("image_id").slice(i, 1), height, width, step, band, band * step, v).table(out[None]).to_batches()

    return beside(bands, luts, MAX_BROADCAST_PICTURES).select("image_id", *COLUMNS, "luts").mapInArrow(run, SCHEMA.format(kind))


# Regions.


def _labelled(bands: DataFrame, low: int) -> DataFrame:
    """Written runs of values above ``low`` with the first run of their component within the band, and links to the next band.

    A band is labelled with the first scanline of the next one. A run there that belongs to a component
    of this band is a link: the next band knows the same run by its own component.
    """

    def run(b: Band) -> pa.Table:
        # Below each picture a scanline that does not exceed ``low``: runs of one picture never touch another's.
        high = b.data.shape[1] + 1
        tall = np.pad(b.data, ((0, 0), (0, 1), (0, 0)), constant_values=low).reshape(-1, b.width)
        y, x1, x2 = regions.plane_runs(tall > low)
        label = regions.labels(y, x1, x2) if len(y) else y
        ends = np.stack([y * b.width + x1, y * b.width + x2 + 1], axis=1).ravel()
        most = np.maximum.reduceat(np.append(tall.ravel(), 0), ends)[::2] if len(y) else y
        which, y = y // high, y % high + b.low
        linked = (y >= b.top + b.rows) & (y[label] < b.top + b.rows)
        used = (y < b.top + b.rows) | linked
        ints = {"band": np.full(len(y), b.band), "first": np.full(len(y), b.top), "y": y, "x1": x1, "x2": x2, "key_y": y[label], "key_x": x1[label], "most": most}
        columns = {c: pa.array(a[used], pa.int32()) for c, a in ints.items()}
        return pa.table({"image_id": b.image_id.take(pa.array(which[used])), **columns, "link": pa.array(linked[used])})

    schema = f"image_id {_kind(bands)}, band int, first int, y int, x1 int, x2 int, key_y int, key_x int, most int, link boolean"
    return written(with_halo(bands, (0, 1), run, schema), "banded-runs")


def _joined(found: DataFrame) -> DataFrame:
    """Runs with the first run of their component in the whole picture: key becomes comp (comp_y, comp_x).

    Links meet the runs that they name at the top of the next band, all of a picture in one task, which holds no run but
    those of such scanlines; many small pictures are joined in one go.
    """
    runs = found.where("not link")
    heads = found.where(F.col("link") | (F.col("y") == F.col("first")))
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.select("image_id", "y", "x1", "link", "key_y", "key_x").repartition(n, "image_id").sortWithinPartitions("image_id")

    def joined(table: pa.Table) -> pa.Table:
        ids = table["image_id"].combine_chunks()
        picture = pc.dictionary_encode(ids).indices.to_numpy().astype(np.int64)
        y, x1, ky, kx = (table[c].to_numpy().astype(np.int64) for c in ("y", "x1", "key_y", "key_x"))
        link = table["link"].combine_chunks().to_numpy(zero_copy_only=False)
        # Keys in order of picture and place, so the least number of a component is its first run.
        keys, number = np.unique(np.stack([picture, ky, kx], axis=1), axis=0, return_inverse=True)
        number, (_, place) = number.ravel(), np.unique(np.stack([picture, y, x1], axis=1), axis=0, return_inverse=True)
        at = np.full(len(link), -1)
        place = place.ravel()
        at[place[~link]] = number[~link]
        label = regions.hooked(np.arange(len(keys)), number[link], at[place[link]])
        moved = np.flatnonzero(label != np.arange(len(keys)))
        first = np.zeros(len(keys), np.int64)
        first[number] = np.arange(len(number))
        columns = {"moved_y": keys[moved, 1], "moved_x": keys[moved, 2], "to_y": keys[label[moved], 1], "to_x": keys[label[moved], 2]}
        return pa.table({"of": ids.take(pa.array(first[moved])), **{c: pa.array(v, pa.int32()) for c, v in columns.items()}})

    moves = dealt.mapInArrow(lambda batches: whole_pictures(batches, joined), f"of {_kind(found)}, moved_y int, moved_x int, to_y int, to_x int")
    on = (F.col("image_id") == F.col("of")) & (F.col("key_y") == F.col("moved_y")) & (F.col("key_x") == F.col("moved_x"))
    every = runs.join(moves, on, "left").withColumn("comp_y", F.coalesce("to_y", "key_y")).withColumn("comp_x", F.coalesce("to_x", "key_x"))
    return every.drop("of", "moved_y", "moved_x", "to_y", "to_x")


def connected_runs(bands: DataFrame) -> DataFrame:
    """Runs of non-zero pixels with the first run of their 8-connected component: image_id, y, x1, x2, comp_y, comp_x."""
    return _joined(_labelled(bands, 0)).select("image_id", "y", "x1", "x2", "comp_y", "comp_x")


def connected_components(bands: DataFrame) -> DataFrame:
    """One row per component, as for whole pictures."""
    return regions.components_of_runs(connected_runs(bands))


def keep_strong(bands: DataFrame, low: int, high: int) -> DataFrame:
    """Hysteresis: connected values above ``low`` become 255 where one of them exceeds ``high``, all else 0."""
    runs = _joined(_labelled(bands, low))
    comp = ["image_id", "comp_y", "comp_x"]
    strong = runs.groupBy(*comp).agg(F.max("most").alias("m")).where(F.col("m") > high).select(*comp)
    kept = runs.join(strong, comp, "left_semi").groupBy("image_id", "band").agg(*[F.collect_list(F.struct("y", "x1", "x2")).alias("lit")])

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sizes = zip(*(batch.column(c).to_pylist() for c in ("height", "width", "step", "top")), strict=True)
            for i, (height, width, step, top) in enumerate(sizes):
                edge = np.zeros((min(step, height - top), width + 1), np.int32)
                lit = batch.column("lit")[i].values
                if lit is not None and len(lit):
                    y, x1, x2 = (lit.field(k).to_numpy() for k in range(3))
                    edge[y - top, x1] = 255
                    edge[y - top, x2 + 1] -= 255
                out.append(np.cumsum(edge, axis=1)[:, :-1].astype(np.uint8).tobytes())
            yield batch.select(["image_id", *COLUMNS[:-1]]).append_column("data", pa.array(out, pa.binary()))

    every = bands.select("image_id", *COLUMNS[:-1]).join(kept, ["image_id", "band"], "left")
    return every.select("image_id", *COLUMNS[:-1], "lit").mapInArrow(paint, SCHEMA.format(_kind(bands)))


def canny_edges(bands: DataFrame, low: int = 50, high: int = 150) -> DataFrame:
    """Sobel, thinning, hysteresis over all bands of a picture."""
    return keep_strong(written(thin_edges(bands), "thinned"), low, high)


# Lines and rotation.


def _lit(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """``cast_votes`` of one band, at places of the whole picture."""
    width, top = (batch.column(c)[i].as_py() for c in ("width", "top"))
    v = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(-1, width)
    return lines.cast_votes(v, top)


def hough_votes(bands: DataFrame, threshold: int = 100) -> DataFrame:
    """Local maxima of a picture's accumulator: bands vote by angle, votes of an angle are added up, and the 180 sums meet in one task.

    Pictures of up to ``MAX_WHOLE`` pixels are smaller than their votes: their bands meet as they are.
    """
    kind = _kind(bands)
    pixels = F.col("height").cast("long") * F.col("width")
    return _whole_votes(bands.where(pixels <= MAX_WHOLE), threshold).unionByName(_summed_votes(bands.where(pixels > MAX_WHOLE), threshold))


def _of_wholes(bands: DataFrame, find: Callable[[np.ndarray], np.ndarray], columns: str) -> DataFrame:
    """Rows of int ``columns`` that ``find`` makes of each whole mask, whose bands meet; one exchange."""
    names, types = zip(*[(n, ARROW[t]) for n, t in (c.split() for c in columns.split(", "))], strict=True)

    def run(table: pa.Table) -> pa.Table:
        ids, width = table["image_id"].to_pylist(), table["width"].to_pylist()
        cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
        data = table["data"].combine_chunks()
        found = [find(np.concatenate([np.frombuffer(data[i].as_buffer(), np.uint8) for i in range(a, b)]).reshape(-1, width[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        every = np.concatenate(found)
        own = table["image_id"].take(pa.array(np.repeat(cuts[:-1], [len(f) for f in found])))
        return pa.table({"image_id": own, **{n: pa.array(every[:, k].astype(np.int64), pa.int64()).cast(t) for k, (n, t) in enumerate(zip(names, types, strict=True))}})

    n = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = bands.select("image_id", "width", "top", "data").repartition(n, "image_id").sortWithinPartitions("image_id", "top")
    return dealt.mapInArrow(lambda batches: whole_pictures(batches, run), f"image_id {_kind(bands)}, {columns}")


def _whole_votes(bands: DataFrame, threshold: int) -> DataFrame:
    return _of_wholes(bands, lambda m: lines.plane_votes(m, threshold), "theta int, rho int, n long")


def _summed_votes(bands: DataFrame, threshold: int) -> DataFrame:
    kind = _kind(bands)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rho = _lit(batch, i)[2]
                if rho.size:
                    votes, low = lines.accumulated(rho)
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("image_id")[i], len(votes)), pa.array(np.arange(len(votes)), pa.int32()), pa.array([low] * len(votes), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in votes], pa.binary())], ["image_id", "theta", "low", "votes"])

    def aligned(rows: list[tuple[int, bytes]]) -> tuple[int, list[np.ndarray]]:
        low, high = min(a for a, _ in rows), max(a + len(v) // 8 for a, v in rows)
        return low, [np.pad(np.frombuffer(v, "<i8"), (a - low, high - a - len(v) // 8)) for a, v in rows]

    def added(table: pa.Table) -> pa.Table:
        low, votes = aligned(list(zip(table["low"].to_pylist(), table["votes"].to_pylist(), strict=True)))
        return pa.table({"image_id": table["image_id"].slice(0, 1), "theta": table["theta"].slice(0, 1), "low": pa.array([low], pa.int32()), "votes": pa.array([sum(votes).tobytes()], pa.binary())})

    def peaks(table: pa.Table) -> pa.Table:
        table = table.sort_by("theta")
        low, votes = aligned(list(zip(table["low"].to_pylist(), table["votes"].to_pylist(), strict=True)))
        found = lines.peaks_of(np.stack(votes), low, threshold)
        return pa.table({"image_id": pa.repeat(table["image_id"][0], len(found)), "theta": found[:, 0].astype(np.int32), "rho": found[:, 1].astype(np.int32), "n": found[:, 2]})

    schema = f"image_id {kind}, theta int, low int, votes binary"
    sums = bands.select("image_id", "width", "top", "data").mapInArrow(vote, schema).groupBy("image_id", "theta").applyInArrow(added, schema)
    return sums.groupBy("image_id").applyInArrow(peaks, f"image_id {kind}, theta int, rho int, n long")


def line_segments(bands: DataFrame, threshold: int = 100, min_length: int = 100, max_gap: int = 10) -> DataFrame:
    """Segments on the peaks: each band cuts its pixels of a line into stretches, and stretches of one line join where less than a gap parts them.

    Bands of pictures of up to ``MAX_WHOLE`` pixels meet as for their votes, and their segments are found there.
    """
    pixels = F.col("height").cast("long") * F.col("width")
    small = _of_wholes(bands.where(pixels <= MAX_WHOLE), lambda m: lines.plane_segments(m, threshold, min_length, max_gap), "x1 int, y1 int, x2 int, y2 int")
    return small.unionByName(_joined_segments(bands.where(pixels > MAX_WHOLE), threshold, min_length, max_gap))


def _joined_segments(bands: DataFrame, threshold: int, min_length: int, max_gap: int) -> DataFrame:
    kind = _kind(bands)
    peaks = _summed_votes(bands, threshold).groupBy("image_id").agg(F.collect_list(F.struct("theta", "rho")).alias("peaks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                y, x, rho = _lit(batch, i)
                out = []
                for peak in batch.column("peaks")[i].as_py():
                    on = np.flatnonzero(rho[peak["theta"]] == peak["rho"])
                    pos = lines.along(peak["theta"], y[on], x[on])
                    order = np.argsort(pos, kind="stable")
                    on, pos = on[order], pos[order]
                    cuts = np.flatnonzero(np.diff(pos) > max_gap) + 1
                    for part, p in zip(np.split(on, cuts), np.split(pos, cuts), strict=True) if len(on) else ():
                        ends = sorted(zip(x[part].tolist(), y[part].tolist(), strict=True))
                        out.append({"image_id": batch.column("image_id")[i], **peak, "first": int(p[0]), "last": int(p[-1]), "x1": ends[0][0], "y1": ends[0][1], "x2": ends[-1][0], "y2": ends[-1][1]})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("image_id", batch.schema.field("image_id").type), *[(c, pa.int32()) for c in ("theta", "rho", "first", "last", "x1", "y1", "x2", "y2")]]))

    parts = beside(bands, peaks, MAX_BROADCAST_PICTURES).select("image_id", "width", "top", "data", "peaks").mapInArrow(run, f"image_id {kind}, theta int, rho int, first int, last int, x1 int, y1 int, x2 int, y2 int")
    line = Window.partitionBy("image_id", "theta", "rho").orderBy("first", "last")
    reach = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("new", F.when(F.col("first") - reach <= max_gap, 0).otherwise(1)).withColumn("part", F.sum("new").over(line))
    least, most = F.min(F.struct("x1", "y1")), F.max(F.struct("x2", "y2"))
    whole = parts.groupBy("image_id", "theta", "rho", "part").agg(least.alias("a"), most.alias("b"), (F.max("last") - F.min("first")).alias("length"))
    return whole.where(F.col("length") >= min_length).select("image_id", "a.x1", "a.y1", "b.x2", "b.y2")


@lru_cache(maxsize=32)
def _boxes(h: int, w: int, step: int, c: int, s: int, nh: int, nw: int, tile: int) -> list[tuple[int, ...]]:
    """Each target tile: its band, its place there, first and last scanline and column of its box."""
    t, k = (a.ravel() for a in np.meshgrid(np.arange(-(-nh // step)), np.arange(-(-nw // tile)), indexing="ij"))
    row, column = np.stack([t * step, np.minimum(t * step + step, nh) - 1]), np.stack([k * tile, np.minimum(k * tile + tile, nw) - 1])
    x, y = geometry.source_places(row[:, None], column[None, :], h, w, c, s, nh, nw)
    edge = lambda a, n: (np.clip(a.min((0, 1)) // 32 - 1, 0, n - 1), np.clip(a.max((0, 1)) // 32 + 2, 0, n - 1))
    return list(zip(*(a.tolist() for a in (t, k, *edge(y, h), *edge(x, w))), strict=True))


def rotate_gather(bands: DataFrame, geometry_rows: DataFrame, tile: int = 1024) -> DataFrame:
    """Rotation by target tiles, of a band's scanlines and ``tile`` columns: each is sent the box of source pixels that its inverse map meets.

    One exchange, by target band: tiles come one after the other, and a task holds a tile's box and the tiles of one band, which
    are laid side by side. Many small bands are one Python call.
    """
    kind = _kind(bands)
    names = ("height", "width", "step", "band", "tile", "top", "left", "columns", "nh", "nw", "c", "s", "data")
    types = {n: pa.binary() if n == "data" else pa.int64() if n in "cs" else pa.int32() for n in names}
    schema = f"image_id {kind}, " + ", ".join(f"{n} {'binary' if n == 'data' else 'long' if n in 'cs' else 'int'}" for n in names)
    turned = beside(bands, geometry_rows.select("image_id", "c", "s", F.col("new_h").alias("nh"), F.col("new_w").alias("nw")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types.values(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(which, pa.int64())), *columns], ["image_id", *names])

        for batch in batches:
            out, which, size = [], [], 0
            sizes = zip(*(batch.column(n).to_pylist() for n in ("height", "width", "step", "top", "c", "s", "nh", "nw")), batch.column("data"), strict=True)
            for i, (h, w, step, top, c, s, nh, nw, data) in enumerate(sizes):
                v = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, w)
                for t, k, y1, y2, x1, x2 in _boxes(h, w, step, c, s, nh, nw, tile):
                    a, b = max(y1, top), min(y2 + 1, top + len(v))
                    if a < b:
                        which.append(i)
                        out.append((h, w, step, t, k, a, x1, x2 + 1 - x1, nh, nw, c, s, v[a - top : b - top, x1 : x2 + 1].tobytes()))
                        size += len(out[-1][-1])
                        if size >= SENT:
                            yield rows()
                            out, which, size = [], [], 0
            if out:
                yield rows()

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
        """Each tile's first row and the bytes of its box."""
        first, parts = None, []
        for batch in batches:
            for *row, data in zip(*(batch.column(n).to_pylist() for n in ("image_id", *names[:-1])), batch.column("data"), strict=True):
                if first is None or (row[0], row[4], row[5]) != (first[0], first[4], first[5]):
                    if parts:
                        yield first, b"".join(parts)
                    first, parts = row, []
                parts.append(data.as_buffer().to_pybytes())
        if parts:
            yield first, b"".join(parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), fields.values(), strict=True)]
            return pa.RecordBatch.from_arrays(columns, list(fields))

        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        fields = {"image_id": head.schema.field("image_id").type, **{n: pa.binary() if n == "data" else pa.int32() for n in COLUMNS}}
        beside, out, size = [], [], 0
        for (image_id, h, w, step, t, k, top, left, columns, nh, nw, c, s), data in boxes(chain([head], batches)):
            row, column = np.arange(t * step, min(t * step + step, nh)), np.arange(k * tile, min(k * tile + tile, nw))
            x, y = geometry.source_places(row[:, None], column[None, :], h, w, c, s, nh, nw)
            beside.append(geometry.gathered(np.frombuffer(data, np.uint8).reshape(-1, columns), x, y, h, w, top, left).astype(np.uint8))
            if (k + 1) * tile >= nw:
                out.append((image_id, nh, nw, step, t, t * step, np.concatenate(beside, axis=1).tobytes()))
                beside, size = [], size + len(out[-1][-1])
                if size >= SENT:
                    yield rows()
                    out, size = [], 0
        if out:
            yield rows()

    n = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = turned.mapInArrow(send, schema).repartition(n, "image_id", "band").sortWithinPartitions("image_id", "band", "tile", "top")
    return sent.mapInArrow(gather, SCHEMA.format(kind))


def sizes(bands: DataFrame) -> DataFrame:
    """image_id, height, width of each picture."""
    return bands.where("band = 0").select("image_id", "height", "width")


def correct_rotation(bands: DataFrame, votes: int = 100, min_length: int = 100, max_gap: int = 10) -> DataFrame:
    """Gray pictures turned by their skew on a grown canvas."""
    thick = written(dilate(canny_edges(bands), 15, 3), "thick")
    every = sizes(bands)
    skew = lines.skew_angle(line_segments(thick, votes, min_length, max_gap), every)
    return rotate_gather(bands, geometry.rotation_geometry(skew, every))
