"""GeoParquet: WKB in and out, footers, scans by row group, and a sink that writes the `geo` footer."""

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from terrasheaf.functions.text import crs_text

from .files import listed, open_file, renamed, rows_of_files, running_totals, scratch, with_content

RINGS = ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))


def _exterior(wkb: bytes, at: int) -> tuple[list[np.ndarray], int]:
    """(exterior rings, end) of the geometry at a byte offset; Z and M values are passed over."""
    order = "<" if wkb[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", wkb, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4  # an SRID
    width = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x1FFFFFFF
    width += (0, 1, 1, 2)[code // 1000 if code < 4000 else 0]
    kind = code % 1000
    (n,) = struct.unpack_from(order + "I", wkb, at) if kind in (3, 6) else (0,)
    if kind == 3:
        at, rings = at + 4, []
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", wkb, at)
            rings.append(np.frombuffer(wkb, order + "f8", m * width, at + 4).reshape(m, width)[:, :2])
            at += 4 + 8 * m * width
        if not rings:
            raise ValueError("empty polygon")
        if len(rings[0]) < 4:
            raise ValueError("a WKB ring needs 4 positions")
        return rings[:1], at
    if kind == 6:
        at, out = at + 4, []
        for _ in range(n):
            part, at = _exterior(wkb, at)
            out += part
        if not out:
            raise ValueError("empty multipolygon")
        return out, at
    raise ValueError(f"geometry type {kind} has no rings")


@F.arrow_udf(RINGS)
def rings_of_wkb(values: pa.Array) -> pa.Array:
    found = [None if b is None else _exterior(b, 0)[0] for b in values.to_pylist()]
    rings = [r for f in found if f for r in f]
    xy = np.concatenate([np.zeros((0, 2)), *rings])
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
    inner = pa.ListArray.from_arrays(_offsets([len(r) for r in rings]), points)
    return pa.ListArray.from_arrays(_offsets([len(f or ()) for f in found]), inner, mask=pa.array([f is None for f in found], pa.bool_())).cast(to_arrow_type(RINGS))


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32))


def _polygon(xy: np.ndarray) -> bytes:
    return struct.pack("<BIII", 1, 3, 1, len(xy)) + xy.tobytes()


@F.arrow_udf(BinaryType())
def wkb_of_rings(values: pa.Array) -> pa.Array:
    inner = values.values
    points, at = inner.values, inner.offsets.to_numpy()
    xy = np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1).astype("<f8")
    out = []
    for known, a, b in zip(values.is_valid().to_pylist(), values.offsets[:-1].to_pylist(), values.offsets[1:].to_pylist(), strict=True):
        parts = [_polygon(xy[at[k] : at[k + 1]]) for k in range(a, b)] if known else []
        out.append(None if not known else parts[0] if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(parts))
    return pa.array(out, pa.binary())


def footer_of(path: str, file: pa.NativeFile) -> dict:
    """Row groups, fields, CRS and geometry column of an open file, from its footer alone; no `geo` key: an error."""
    meta = pq.read_metadata(file)
    raw = (meta.metadata or {}).get(b"geo")
    if raw is None:
        raise ValueError(f"{path}: no geo metadata")
    geo = json.loads(raw)
    primary = geo.get("primary_column") or ""
    if not primary:
        raise ValueError(f"{path}: no primary geometry column")
    return {"path": path, "row_group_count": meta.num_row_groups, "schema_fields": [c.name for c in meta.schema.to_arrow_schema()], "geometry_column": primary, "geo": json.dumps(geo.get("columns", {}).get(primary, {}))}


def geoparquet_footer(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, row_group_count, schema_fields, geometry_column, crs) a file; only footers are read, in tasks."""
    rows = lambda name, file: [tuple(footer_of(name, file).values())]
    df = rows_of_files(with_content(_files(spark, path)), "path string, row_group_count int, schema_fields array<string>, geometry_column string, geo string", rows)
    return df.withColumn("crs", crs_text(F.col("geo"))).drop("geo")


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return listed(spark, path).filter(F.col("length") > 0)


_STATS = "path string, group int, groups int, rows long, kept long, before long, min_x double, min_y double, max_x double, max_y double, bytes_before long"
#: Bytes of neighbouring row groups that are read in one go, with one look into the footer.
READ_BYTES = 8 << 20


def row_group_stats(spark: SparkSession, path: str | list[str], groups: list[int] | None = None) -> DataFrame:
    """(path, group, groups, rows, kept, before, min_x .. max_y, bytes_before) for row groups of each file, from footers, in tasks.

    kept: rows with a geometry, before: those of the file's earlier groups; the geometry column is read for this only
    where the footer does not count its nulls. The box comes from the statistics of flat columns min_x .. max_y; null
    where there are none. groups: only these, of which every file must have each."""

    def edge(meta: pq.FileMetaData, group: int, at: dict[str, int], name: str) -> float | None:
        stats = meta.row_group(group).column(at[name]).statistics if name in at else None
        if stats is None or not stats.has_min_max:
            return None
        return float(stats.min if name.startswith("min") else stats.max)

    def rows(name: str, raw: pa.NativeFile) -> list[tuple]:
        geometry = footer_of(name, raw)["geometry_column"]
        file = pq.ParquetFile(raw)
        meta, out, before, size = file.metadata, [], 0, 0
        if groups and max(groups) >= meta.num_row_groups:
            raise ValueError(f"{name} has no row group {max(groups)}")
        at = {meta.schema.column(k).path: k for k in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            n = meta.row_group(g).num_rows
            stats = meta.row_group(g).column(at[geometry]).statistics if geometry in at else None
            nulls = stats.null_count if stats is not None and stats.has_null_count else file.read_row_group(g, [geometry])[geometry].null_count
            if groups is None or g in groups:
                out.append((name, g, meta.num_row_groups, n, n - nulls, before, *(edge(meta, g, at, c) for c in BOX), size))
            before += n - nulls
            size += meta.row_group(g).total_byte_size
        return out

    return rows_of_files(with_content(_files(spark, path)), _STATS, rows)


BOX = ("min_x", "min_y", "max_x", "max_y")


def _meeting(stats: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Row groups whose statistics do not rule a box out."""
    if box is None:
        return stats
    outside = (F.col("min_x") > box[2]) | (F.col("max_x") < box[0]) | (F.col("min_y") > box[3]) | (F.col("max_y") < box[1])
    return stats.filter(~F.coalesce(outside, F.lit(False)))


def _row_groups(spark: SparkSession, path: str | list[str], stats: DataFrame, schema: StructType, geometry: str, first_id: str | None) -> DataFrame:
    """Rows with a geometry of row groups (path, group, bytes_before[, first_id]), of which only the schema's columns are
    read: a task for each file and READ_BYTES of its groups, which open the file once. first_id: the id of a group's first
    row; the others follow."""
    full = StructType([*schema.fields, *([StructField("id", LongType())] if first_id else [])])
    target = to_arrow_schema(schema)
    each = F.struct("group", F.col(first_id).alias("first") if first_id else F.lit(0).cast("long").alias("first"))
    spans = stats.groupBy("path", F.expr(f"bytes_before div {READ_BYTES}").alias("span")).agg(F.sort_array(F.collect_list(each)).alias("wanted")).drop("span")
    parts = max(1, min(10_000, spans.count()))
    spans = with_content(_files(spark, path)).join(spans.select("path", F.col("wanted.group").alias("numbers"), F.col("wanted.first").alias("firsts")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, groups, firsts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                with open_file(name, content) as raw:
                    file = pq.ParquetFile(raw)
                    for group, number in zip(groups, firsts, strict=True):
                        for part in file.iter_batches(4096, row_groups=[group], columns=target.names):
                            table = pa.Table.from_batches([part]).select(target.names).cast(target).combine_chunks()
                            table = table.filter(table[geometry].is_valid())
                            if first_id:
                                table = table.append_column("id", pa.array(np.arange(number, number + len(table)), pa.int64()))
                                number += len(table)
                            yield from table.combine_chunks().to_batches()

    return spans.repartition(parts).mapInArrow(run, full)


def read_geoparquet(
    spark: SparkSession, path: str | list[str], row_groups: list[int] | None = None, geometry_col: str | None = None, ids: bool = False,
    columns: list[str] | None = None, box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Attributes and rings; rows without geometry are skipped. row_groups: only those of each file ([]: none).

    columns: only these attributes are read. box (min_x, min_y, max_x, max_y): only rows whose own box meets it, by the
    flat columns that write_geoparquet() adds; row groups that their statistics rule out are not read.
    Whole reads go through Spark's vectorised reader, which prunes columns and row groups itself; geometry_col spares the
    look into a footer. Reads by row group, and with ids, are tasks a span of row groups. ids: a column `id`, 0 to n - 1 over all
    rows with a geometry, in the order of files and rows, from the counts in footers."""
    column = geometry_col or geoparquet_footer(spark, path).first()["geometry_column"]
    df = spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    kept = [c for c in df.columns if columns is None or c in columns or c == column or (box is not None and c in BOX)]
    df = df.select(*(f"`{c}`" for c in kept))
    if row_groups == []:
        df = spark.createDataFrame([], df.schema.add("id", "long") if ids else df.schema)
    elif row_groups is not None or ids:
        kept_stats = scratch(spark, "groups")
        row_group_stats(spark, path, row_groups).write.parquet(kept_stats)  # footers are looked into once
        stats = spark.read.parquet(kept_stats)
        if ids:
            stats = _numbered(stats if row_groups is None else _counted(stats))
        df = _row_groups(spark, path, _meeting(stats, box), df.schema, column, "first_id" if ids else None)
    df = df.filter(F.col(f"`{column}`").isNotNull())
    if box is not None:
        df = df.filter((F.col("min_x") <= box[2]) & (F.col("max_x") >= box[0]) & (F.col("min_y") <= box[3]) & (F.col("max_y") >= box[1]))
    df = df.withColumn("rings", rings_of_wkb(F.col(f"`{column}`"))).drop(column)
    return df if columns is None else df.select(*(c for c in df.columns if c in columns or c in ("rings", "id")))


def _counted(stats: DataFrame) -> DataFrame:
    """stats of some row groups with `before` over these alone; a file's chosen groups are few."""
    earlier = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn("before", F.coalesce(F.sum("kept").over(earlier), F.lit(0)))


def _numbered(stats: DataFrame) -> DataFrame:
    """stats with first_id: rows kept in all files before, by path, and in the file's groups before."""
    totals = running_totals(stats.groupBy("path").agg(F.sum("kept").alias("n")), "path", "n", "files_before")
    return stats.join(totals.select("path", "files_before"), "path").withColumn("first_id", F.col("files_before") + F.col("before"))


def properties_json(df: DataFrame, geometry_col: str = "rings") -> Column:
    """All other columns as a JSON object; nulls stay, numbers that are not finite become null."""
    cols = []
    for f in df.schema:
        if f.name != geometry_col:
            c = F.col(f"`{f.name}`")
            if f.dataType.typeName() in ("double", "float"):
                c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
            cols.append(c.alias(f.name))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def write_geoparquet(df: DataFrame, path: str, row_group_rows: int = 10_000, rings: str = "rings", crs: str = "EPSG:4326") -> None:
    """Attributes, WKB `geometry` and flat min_x .. max_y columns (for pruning by box), with the `geo` footer key.

    Files of about FILE_BYTES are made in tasks and written by Spark's sink and committer, on any store it can write."""
    authority, _, code = crs.partition(":")
    geo = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Polygon", "MultiPolygon"], "crs": {"id": {"authority": authority, "code": int(code) if code.isdigit() else code}}}}}
    xs, ys = _axis(rings, "x"), _axis(rings, "y")
    out = df.withColumns({"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}).withColumn("geometry", wkb_of_rings(F.col(rings))).drop(rings)
    files = out.mapInArrow(_encoder(row_group_rows, json.dumps(geo)), "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.mode("append").option("lineSep", _LAST).option("maxRecordsPerFile", 1).text(path)
    renamed(df.sparkSession, path, ".txt", ".parquet")


#: A Parquet file ends in PAR1. Its last byte is left to the text sink, whose separator it is: so files of our own making
#: go through Spark's committer, to any store that Spark can write.
_LAST = "1"
#: Bytes and row groups of a file at which a task begins another; footers, which are read whole, grow with the groups.
FILE_BYTES, FILE_GROUPS = 64 << 20, 1000


def _encoder(row_group_rows: int, geo: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = writer = held = None
        groups = 0

        def closed() -> pa.RecordBatch:
            writer.close()
            raw = sink.getvalue().to_pybytes()
            assert raw.endswith(_LAST.encode())
            return pa.RecordBatch.from_arrays([pa.array([raw[:-1]], pa.binary())], names=["file"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch.replace_schema_metadata({b"geo": geo.encode()})])
            held = table if held is None else pa.concat_tables([held, table])
            while len(held) >= row_group_rows:
                if writer is None:
                    sink = pa.BufferOutputStream()
                    writer, groups = pq.ParquetWriter(sink, held.schema), 0
                writer.write_table(held.slice(0, row_group_rows), row_group_size=row_group_rows)
                held, groups = held.slice(row_group_rows), groups + 1
                if sink.tell() >= FILE_BYTES or groups >= FILE_GROUPS:
                    yield closed()
                    writer = None
        if held is not None and (len(held) or writer is not None):
            if writer is None:
                sink = pa.BufferOutputStream()
                writer = pq.ParquetWriter(sink, held.schema)
            if len(held):
                writer.write_table(held, row_group_size=row_group_rows)
            yield closed()

    return run


def _axis(rings: str, name: str) -> Column:
    return F.transform(F.flatten(rings), lambda p: p[name])
