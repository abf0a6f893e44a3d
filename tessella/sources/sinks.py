"""Writers: PNG tiles, nested JSON documents, GeoJSON, CSV."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.raster import map_images
from ..runtime import cut_lineage


def png(samples: np.ndarray, level: int = 6) -> np.ndarray:
    """A grey (H, W) or RGB (H, W, 3) uint8 image as the bytes of a PNG file."""
    h, w = samples.shape[:2]
    rows = np.zeros((h, 1 + samples[0].size), np.uint8)
    rows[:, 1:] = samples.reshape(h, -1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if samples.ndim == 2 else 2, 0, 0, 0)
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), level)) + part(b"IEND", b"")
    return np.frombuffer(data, np.uint8)


def with_png(df: DataFrame, data: str, height: str, width: str, channels: int = 3, level: int = 6) -> DataFrame:
    """df with binary column png of its raw samples."""
    shape = (lambda h, w: (h, w)) if channels == 1 else (lambda h, w: (h, w, channels))
    return map_images(df, lambda raw, h, w: png(raw.reshape(shape(h, w)), level), [data, height, width], "png")


def write_blobs(df: DataFrame, folder: str, name: str, blob: str) -> DataFrame:
    """Write each row's blob as folder/name on any file system that Arrow opens (a path, file:, s3:, gs: or hdfs:), which all
    executors share; returns a report.

    Names may hold folders. Writing is repeatable: a task that runs again replaces its files, each whole or not at all.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    from ..runtime import ship

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            names, blobs = batch.column("name").to_pylist(), batch.column("blob").to_pylist()
            for n, b in zip(names, blobs, strict=True):
                path = f"{base}/{n}"
                parent = path.rpartition("/")[0]
                if parent not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{parent}/.{uuid4().hex}.part"
                with files.open_output_stream(part) as f:
                    f.write(b)
                files.move(part, path)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([len(b) for b in blobs], pa.int64())], names=["name", "bytes"])

    return df.select(F.col(name).alias("name"), F.col(blob).cast("binary").alias("blob")).mapInArrow(run, "name string, bytes bigint")


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed ring of a box in GeoJSON order."""
    return F.array(F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0)))


def feature(ring: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))


#: Features of one document at most, about: larger groups are written as several documents.
PER_DOCUMENT = 100_000


def feature_collections(features: DataFrame, by: str, order: str, column: str = "feature", per_document: int = PER_DOCUMENT) -> DataFrame:
    """(by, part, json): FeatureCollections of each group, features in order; a group of over per_document features is
    dealt over several parts by a hash, so that no document grows with the data."""
    sizes = features.groupBy(F.col(by).alias("__g")).agg(F.ceil(F.count("*") / per_document).alias("__parts"))
    dealt = features.join(sizes, F.col(by).eqNullSafe(F.col("__g"))).withColumn("part", F.pmod(F.xxhash64(order), F.col("__parts")).cast("int"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("f")))), lambda r: r["f"])
    return dealt.groupBy(by, "part").agg(listed.alias("features")).select(by, "part", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("json"))


def annotations_documents(heads: DataFrame, tiles: DataFrame, coverage: DataFrame, by: str = "slide", per_document: int = PER_DOCUMENT, parts: DataFrame | None = None) -> DataFrame:
    """(by, part, json): the record of each row of heads (its columns lead the document), with the entries of its tiles (columns by,
    o, entry, in order of o) as a list and those of its objects (columns by, gid, entry) as a map.

    Groups of over per_document entries are dealt over several parts by a hash, so that no document grows with the data. Entries may
    hold lists that grow with it too, and parts of a record may be made elsewhere: then parts (by, parts, total) says over how many
    documents a group is dealt here, and how many it has in all.
    """
    listed = tiles.select(by, F.lit(1).alias("kind"), F.col("o").cast("bigint").alias("o"), F.to_json("entry").alias("e"))
    mapped = coverage.select(by, F.lit(0).alias("kind"), F.col("gid").cast("bigint").alias("o"), F.concat(F.lit('"'), "gid", F.lit('":'), F.to_json("entry")).alias("e"))
    if parts is None:
        counts = tiles.groupBy(by).agg(F.count("*").alias("n")).unionByName(coverage.groupBy(by).agg(F.count("*").alias("n")))
        parts = cut_lineage(counts.groupBy(by).agg(F.ceil(F.sum("n") / per_document).cast("int").alias("parts"))).withColumn("total", F.col("parts"))
    whole = heads.join(parts, by, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).withColumn("parts", F.coalesce("total", F.lit(1)))
    head = whole.select(by, "part", F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("o"), F.to_json(F.struct(*heads.columns, "part", "parts")).alias("e"))
    dealt = listed.unionByName(mapped).join(F.broadcast(parts.drop("total")), by).withColumn("part", F.pmod(F.xxhash64("kind", "o"), F.col("parts")).cast("int")).drop("parts")
    held = dealt.unionByName(head).groupBy(by, "part").agg(F.array_sort(F.collect_list(F.struct("kind", "o", "e"))).alias("all"))
    pick = lambda kind: F.array_join(F.transform(F.filter("all", lambda r: r["kind"] == kind), lambda r: r["e"]), ",")
    picked = held.select(by, "part", F.element_at("all", -1)["kind"].alias("top"), F.element_at("all", -1)["e"].alias("h"), pick(0).alias("c"), pick(1).alias("t")).filter("top = 2")
    body = F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"glomeruli_coverage":{'), "c", F.lit('},"tiles":['), "t", F.lit("]}"))
    return picked.select(by, "part", body.alias("json"))


def write_lists(objects: DataFrame, tiles: DataFrame, folder: str, by: str, batch: str, cell: list[str], plan: dict[tuple, list[tuple]]) -> DataFrame:
    """Parts of records whose tiles list the objects that their boxes overlap, as lines of files folder/by=.../part-centered-*.zst,
    one for each batch of cells; returns a report (by, documents, listed, bytes). All executors must share folder, as for write_blobs.

    objects (by, batch, cell, gid, entry: its fields as a JSON object, x0..y1) and tiles (by, batch, cell, own, entry, tx0..ty1) meet
    in their cell. These two are shuffled, never the lists, which are made where they are written, tile by tile. plan has for each
    (by, batch) its cells: their place, how their documents begin (the head as a JSON object, without part), the number of the first
    part, and the number of documents. Tiles follow their place, so that lists next to each other are alike and compress to a few
    bytes an entry. A task that runs again replaces its files, each whole or not at all.
    """
    import pyarrow as pa

    from ..runtime import ship

    ship(objects.sparkSession)

    def run(key: tuple, met: pa.Table, homes: pa.Table) -> pa.Table:
        from uuid import uuid4

        import pyarrow.compute as pc
        from pyarrow import fs

        from tessella.sources.sinks import listed

        group, k = (x.as_py() for x in key)
        met, homes = met.sort_by("gid"), homes.sort_by([("ty0", "ascending"), ("tx0", "ascending"), ("own", "ascending")])
        number = lambda t, c: pc.cast(t[c], pa.float64()).to_numpy()
        entries = met["entry"].combine_chunks()
        begins = pc.binary_join_element_wise(pc.utf8_slice_codeunits(entries, 0, -1), ',"coverage_pct":', "")
        boxes, gids, places = [number(met, c) for c in ("x0", "y0", "x1", "y1")], met["gid"].to_numpy(), [met[c].to_numpy() for c in cell]
        corners, owns, texts = np.stack([number(homes, c) for c in ("tx0", "ty0", "tx1", "ty1")], 1), homes["own"].to_pylist(), homes["entry"].to_pylist()
        homes_at = [homes[c].to_numpy() for c in cell]
        inside = lambda columns, place: np.flatnonzero(np.logical_and.reduce([c == v for c, v in zip(columns, place, strict=True)]))
        files, base = fs.FileSystem.from_uri(folder)
        parent, documents, count = f"{base}/{by}={group}", 0, 0
        files.create_dir(parent, recursive=True)
        part = f"{parent}/.{uuid4().hex}.part"
        with files.open_output_stream(part) as raw, pa.CompressedOutputStream(raw, "zstd") as f:
            for place, head, first, n in plan[group, k]:
                near, mine = inside(places, place), inside(homes_at, place)
                near_boxes, near_gids, near_begins = [b[near] for b in boxes], gids[near], begins.take(pa.array(near))
                for d in range(n):
                    f.write(f'{head[:-1]},"part":{first + d},"glomeruli_coverage":{{}},"tiles":['.encode())
                    for j, i in enumerate(mine[d * len(mine) // n : (d + 1) * len(mine) // n]):
                        found, size = listed(near_boxes, corners[i], near_gids, owns[i], near_begins)
                        count += size
                        f.write(f'{"," if j else ""}{texts[i][:-1]},"has_annotations":{"true" if size else "false"},"glomeruli":['.encode())
                        f.write(found)
                        f.write(b"]}")
                    f.write(b"]}\n")
                documents += n
        files.move(part, path := f"{parent}/part-centered-{k:05d}.zst")
        return pa.table([pa.array([v], pa.int64()) for v in (group, documents, count, files.get_file_info(path).size)], names=[by, "documents", "listed", "bytes"])

    side = lambda df: df.repartition(len(plan), by, batch).groupBy(by, batch)
    return side(objects).cogroup(side(tiles)).applyInArrow(run, f"{by} bigint, documents bigint, listed bigint, bytes bigint")


def listed(boxes: list[np.ndarray], tile: np.ndarray, gids: np.ndarray, own: int, begins) -> tuple[memoryview, int]:
    """The entries (JSON, comma-joined) of the objects that cover a part of a tile, with grid.box_coverage of their boxes, and their
    number. begins: each object's entry up to its coverage (an Arrow array)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    x0, y0, x1, y1 = boxes
    at = np.flatnonzero((x0 < tile[2]) & (x1 > tile[0]) & (y0 < tile[3]) & (y1 > tile[1]))
    x0, y0, x1, y1 = (b[at] for b in boxes)
    area = (x1 - x0) * (y1 - y0)
    shared = np.maximum(0.0, np.minimum(x1, tile[2]) - np.maximum(x0, tile[0])) * np.maximum(0.0, np.minimum(y1, tile[3]) - np.maximum(y0, tile[1]))
    covered = np.divide(shared, area, out=np.zeros(len(at)), where=area > 0) * 100
    at, covered = at[covered > 0], covered[covered > 0]
    if not len(at):
        return memoryview(b""), 0
    values, place = np.unique(covered, return_inverse=True)
    ends = pa.array([',"role":"secondary"},', ',"role":"primary"},']).take(pa.array((gids[at] == own).astype(np.int8)))
    made = pc.binary_join_element_wise(begins.take(pa.array(at)), pc.cast(pa.array(values), pa.string()).take(pa.array(place)), ends, "")
    offsets = np.frombuffer(made.buffers()[1], np.int32)[made.offset : made.offset + len(made) + 1]
    return memoryview(made.buffers()[2])[offsets[0] : offsets[-1] - 1], len(at)


def manifest_documents(features: DataFrame, by: str, index: str, entry: Column) -> DataFrame:
    """(by, json): entries of each slide by their four-digit index."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.format_string("%04d", F.col(index)).alias("key"), entry.alias("value")))))
    return features.groupBy(by).agg(pairs.alias("features")).select(by, F.to_json(F.struct("features")).alias("json"))


def index_documents(pairs: DataFrame, by: str, gid: str, tile: str) -> DataFrame:
    """(by, json): tiles of each object and objects of each tile."""
    by_gid = pairs.groupBy(by, gid).agg(F.array_sort(F.collect_list(tile)).alias("tiles"))
    by_tile = pairs.groupBy(by, tile).agg(F.array_sort(F.collect_list(gid)).alias("gids"))
    left = by_gid.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(gid).alias("gid"), "tiles"))).alias("glomeruli"))
    right = by_tile.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(tile).cast("string").alias("k"), "gids")))).alias("tile_to_glomeruli"))
    return left.join(right, by).select(by, F.to_json(F.struct("glomeruli", "tile_to_glomeruli")).alias("json"))


def read_documents(spark, folder: str, schema: str, names: list[str] | None = None) -> DataFrame:
    """JSON documents of write_documents with an explicit schema, of all groups or of the folders of names."""
    text = spark.read.text(folder) if names is None else spark.read.option("basePath", folder).text([f"{folder}/{n}" for n in names])
    return text.select("*", F.from_json("value", schema).alias("doc")).drop("value")


def write_documents(docs: DataFrame, folder: str, by: str, column: str = "json", compression: str = "none") -> None:
    """JSON documents as text (compressed, if asked), a folder for each group. Only the groups of docs are replaced, and a group's folder appears when all
    its documents are whole (Spark's commit moves it there), so completed() is what a resumed run may skip."""
    docs.select(by, F.col(column).alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).text(folder, compression=compression)


def _files(spark, path: str):
    """(file system, path) of Hadoop."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def group_folders(spark, folder: str, by: str) -> list[str]:
    """Names of the groups' folders, as Spark's writers escape them; none if the folder is not there."""
    files, path = _files(spark, folder)
    if not files.exists(path):
        return []
    return sorted(x.getPath().getName() for x in files.listStatus(path) if x.isDirectory() and x.getPath().getName().startswith(f"{by}="))


def publish(spark, staged: str, folder: str, by: str) -> list[str]:
    """Move the groups' folders of staged to folder, each at once, where they replace those of the same group; returns their names."""
    files, into = _files(spark, folder)
    files.mkdirs(into)
    for name in (names := group_folders(spark, staged, by)):
        files.delete(_files(spark, f"{folder}/{name}")[1], True)
        if not files.rename(_files(spark, f"{staged}/{name}")[1], _files(spark, f"{folder}/{name}")[1]):
            raise OSError(f"{staged}/{name} could not be moved to {folder}")
    return names


def delete(spark, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def stored(spark, folder: str, names: list[str]) -> int:
    """Bytes of groups' folders."""
    files, _ = _files(spark, folder)
    return sum(files.getContentSummary(_files(spark, f"{folder}/{n}")[1]).getLength() for n in names)


def drop_documents(spark, folder: str, names: list[str]) -> None:
    """Delete the documents in groups' folders. The folders stay, with an empty _SUCCESS: completed() still has the groups."""
    files, _ = _files(spark, folder)
    for n in names:
        files.create(_files(spark, f"{folder}/{n}/_SUCCESS")[1], True).close()
        for x in files.listStatus(_files(spark, f"{folder}/{n}")[1]):
            if x.getPath().getName() != "_SUCCESS":
                files.delete(x.getPath(), True)


def completed(spark, folder: str, by: str) -> DataFrame:
    """(by): the groups that write_documents has finished, by their folders (no document is read); none if the folder is not there."""
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    values = [unescape(n[len(by) + 1 :]) for n in group_folders(spark, folder, by)]
    return spark.createDataFrame([(None if v == "__HIVE_DEFAULT_PARTITION__" else v,) for v in values], f"{by} string")


def write_csv(df: DataFrame, folder: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(folder, header=True)


def write_split(splits: DataFrame, folder: str, column: str, seed: int, sizes: tuple[float, float, float]) -> None:
    """The split record: settings and the sorted members of each part."""
    member = lambda p: F.array_sort(F.collect_list(F.when(F.col("split") == p, F.col(column)))).alias(p)
    record = splits.agg(F.count("*").alias("total_biopsies"), *[member(p) for p in ("train", "val", "test")])
    settings = [F.lit(seed).alias("seed"), *[F.lit(s).alias(n) for n, s in zip(("train_size", "val_size", "test_size"), sizes, strict=True)]]
    record.select(*settings, "*").coalesce(1).write.mode("overwrite").json(folder)
