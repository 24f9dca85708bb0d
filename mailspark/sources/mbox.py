"""The ``mbox`` data source: one row per message of plain or compressed mbox
files. A plain file, and a compressed one that tells where its frames are, is
read in byte ranges of its content; a range owns the messages whose separator
line starts inside it. Small files share a partition."""

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from mailspark.schema import RAW_MESSAGES
from mailspark.session import written
from mailspark.sources import storage
from mailspark.sources.storage import (
    codec_of, list_files, open_at, open_decoded, open_random, seek_table,
)

SPLIT_BYTES = 128 << 20
SMALLEST_SPLIT = 256 << 10
CHUNK = 1 << 20
BATCH_BYTES, BATCH_ROWS = 2 << 20, 2000
SEPARATOR = b"\nFrom "

ARROW = pa.schema([
    pa.field("archive_file", pa.string(), False),
    pa.field("mbox_offset", pa.int64(), False),
    pa.field("mbox_length", pa.int64(), False),
    pa.field("raw", pa.binary(), False),
])


@dataclass
class MboxSplit(InputPartition):
    """(path, start, end) pieces; ``end`` is None for a compressed file that
    is read whole. A fourth value is the frame to enter it by: its places in
    the file and in the content."""

    pieces: tuple


def message_bytes(record):
    """Message of one record: without separator line and closing blank line."""
    body = record[record.find(b"\n") + 1:] if b"\n" in record else b""
    return body[:-1] if body == b"\n" or body.endswith(b"\n\n") else body


def records(stream, start, end):
    """(offset, record bytes) of the messages that start in [start, end). The
    stream stands at byte max(start - 1, 0)."""
    at = max(start - 1, 0)
    # A line break before the file makes its first line an ordinary match.
    held = b"\n" if start == 0 else b""
    base = at - len(held)
    begin, scan, done = None, 0, False
    while True:
        hit = held.find(SEPARATOR, scan)
        if hit < 0:
            if done:
                if begin is not None:
                    yield base + begin, held[begin:]
                return
            scan = max(len(held) - len(SEPARATOR) + 1, scan)
            keep = scan if begin is None else begin
            keep = min(keep, scan)
            held, base, scan = held[keep:], base + keep, scan - keep
            if begin is not None:
                begin -= keep
            more = stream.read(max(CHUNK, len(held)))
            done = not more
            held += more
            continue
        offset = base + hit + 1
        if begin is not None:
            yield base + begin, held[begin:hit + 1]
        if end is not None and offset >= end:
            return
        begin, scan = hit + 1, hit + 1


def read_pieces(pieces):
    """Record batches of the messages of some pieces."""
    columns, size = ([], [], [], []), 0
    for path, start, end, *point in pieces:
        codec = codec_of(path)
        if codec and end is not None:
            table = ([point[0][0]], [point[0][1]], end, None) if point else seek_table(path)
            stream = open_at(path, max(start - 1, 0), table)
        else:
            stream = open_decoded(path, codec) if codec else open_random(path)
        with stream:
            if start > 0 and not codec:
                stream.seek(start - 1)
            for offset, record in records(stream, start, end):
                raw = message_bytes(record)
                for column, value in zip(columns, (path, offset, len(record), raw)):
                    column.append(value)
                size += len(raw)
                if size >= BATCH_BYTES or len(columns[0]) >= BATCH_ROWS:
                    yield _batch(columns)
                    columns, size = ([], [], [], []), 0
    if columns[0]:
        yield _batch(columns)


def _batch(columns):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def plan_splits(files, split_bytes, points=None):
    """Cuts large files that can be entered in the middle, and packs what is
    small together. The frame table is read of large files only; ``points``
    has frames of files without one, by path: [(place in the file, place in
    the content)], the last one standing for the end."""
    out, pack, packed = [], [], 0
    for path, size in files:
        if path in (points or {}):
            *frames, (_, whole) = points[path]
            # A range needs the byte before it, so it starts one behind a frame.
            starts = [plain + 1 if plain else 0 for _, plain in frames]
            out.extend(((path, start, end, tuple(frame)),) for frame, start, end in zip(
                frames, starts, [*starts[1:], whole + 1]))
            continue
        if size > split_bytes:
            table = seek_table(path)
            whole = size if codec_of(path) is None else table[2] if table else None
            if whole is not None:
                starts = range(0, max(whole, 1), split_bytes)
                out.extend(((path, s, min(s + split_bytes, whole)),) for s in starts)
                continue
        if pack and packed + size > split_bytes:
            out.append(tuple(pack))
            pack, packed = [], 0
        pack.append((path, 0, None if codec_of(path) else size))
        packed += size
    if pack:
        out.append(tuple(pack))
    return [MboxSplit(pieces) for pieces in out]


class MboxReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def files(self):
        if "files" in self.options:
            return {path: size for path, size in json.loads(self.options["files"])}
        files = {}
        for path in self.options.get("path", "").split("\n"):
            files.update(list_files(path) if path else [])
        return files

    def partitions(self):
        files = self.files()
        size = int(self.options.get("splitbytes", SPLIT_BYTES))
        # Little data is cut finer, so that every core gets a share.
        share = sum(files.values()) // int(self.options.get("parallelism", 1))
        size = min(size, max(share, SMALLEST_SPLIT))
        points = json.loads(self.options.get("points", "{}"))
        return plan_splits(sorted(files.items()), size, points) or [MboxSplit(())]

    def read(self, partition):
        yield from read_pieces(partition.pieces)


class PruningMboxReader(MboxReader):
    """Also leaves out files that a filter on archive_file rules out."""

    def __init__(self, options):
        super().__init__(options)
        self.wanted = None

    def pushFilters(self, filters):
        for f in filters:
            named = getattr(f, "attribute", None) == ("archive_file",)
            if named and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            # Spark still applies every filter to the rows.
            yield f

    def files(self):
        files = super().files()
        return files if self.wanted is None else {
            p: size for p, size in files.items() if p in self.wanted}


class MboxDataSource(DataSource):
    @classmethod
    def name(cls):
        return "mbox"

    def schema(self):
        return RAW_MESSAGES

    def reader(self, schema):
        pruning = self.options.get("pushdown") == "true"
        return PruningMboxReader(self.options) if pruning else MboxReader(self.options)


def read_mbox(spark, paths, split_bytes=SPLIT_BYTES, files=None, points=None):
    """Messages of mbox files, folders or globs. ``files`` is what
    ``require_sources`` found for them; with it nothing is listed again.
    ``points`` (``access_points``) lets gzip files of other makers be read by
    several tasks."""
    spark.dataSource.register(MboxDataSource)
    paths = [paths] if isinstance(paths, str) else list(paths)
    # Spark refuses readers that take filters unless this setting is on.
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = (spark.read.format("mbox").option("path", "\n".join(paths))
              .option("splitBytes", str(split_bytes)).option("pushdown", pushdown)
              .option("parallelism", spark.sparkContext.defaultParallelism))
    if files is not None:
        reader = reader.option("files", json.dumps([f[:2] for f in files]))
    if points:
        reader = reader.option("points", json.dumps(points))
    return reader.load()


def access_points(spark, files, split_bytes=SPLIT_BYTES):
    """{path: [(place in the file, place in the content)]} of gzip files that
    have several members but do not tell where. Ranges of the files are looked
    through by many tasks, each member being decoded once; the driver learns
    one point per split and the end. A file of one member has none and stays
    with one task."""
    large = [(f[0], f[1]) for f in files if codec_of(f[0]) == "gzip" and f[1] > split_bytes]
    if not large:
        return {}

    def find(batches):
        for b in batches:
            for path, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end"))):
                found = list(storage.gzip_members(path, start, end))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array([m[0] for m in found], pa.int64()),
                     pa.array([m[1] for m in found], pa.int64())], names=["path", "place", "size"])

    step = F.lit(split_bytes)
    pieces = spark.createDataFrame(large, "path string, bytes long").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start"))
    members = written(
        pieces.select("path", "start", (F.col("start") + step).alias("end")).repartition("path", "start")
        .mapInArrow(find, "path string, place long, size long"), "members")
    inside = W.partitionBy("path").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    places = members.withColumn("plain", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    firsts = places.groupBy("path", F.floor(F.col("plain") / step).alias("split")).agg(
        F.min_by("place", "plain").alias("place"), F.min("plain").alias("plain"))
    ends = members.groupBy("path").agg(F.sum("size").alias("plain"))
    out = {}
    for r in firsts.orderBy("path", "plain").collect():
        out.setdefault(r.path, []).append((r.place, r.plain))
    for r in ends.collect():
        out[r.path].append((None, r.plain))
    return {path: found for path, found in out.items() if len(found) > 2}


def require_sources(paths):
    """[(file, size, position of the first path that names it)], each path
    listed once; a path without a file is an error."""
    files = {}
    for number, path in enumerate([paths] if isinstance(paths, str) else paths):
        found = storage.list_files(path)
        if not found:
            raise FileNotFoundError(f"archive not found: {path}")
        for name, size in found:
            files.setdefault(name, (name, size, number))
    return sorted(files.values())
