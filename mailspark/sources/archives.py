"""Writing, extracting and compressing archives, each as a Spark job."""

import hashlib
import math
import posixpath
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.functions import columns as C
from mailspark.operators import joins, ranges
from mailspark.operators.parse import generated_id, parse_one
from mailspark.schema import LOCATION
from mailspark.session import scratch, written
from mailspark.sources.mbox import message_bytes
from mailspark.sources.storage import (
    Published, append_frames, codec_of, compress_bytes, decoder, delete, exists, list_files, open_at,
    open_decoded, open_random, seek_table, seek_table_bytes,
)

SHARD_BYTES = 1 << 30
FRAME_BYTES = 16 << 20
#: Bytes of a compressed shard that one task sorts and compresses.
PIECE_BYTES = 32 << 20
READ_BYTES = 4 << 20


# ----------------------------------------------------------------------- write


def from_line(from_addr="from_addr", date="date"):
    """Separator line of a message, without the line break."""
    address = F.regexp_extract(F.coalesce(F.col(from_addr), F.lit("")), r"([^\s<>]+@[^\s<>]+)", 1)
    return F.concat(
        F.lit("From "), F.coalesce(F.nullif(address, F.lit("")), F.lit("MAILER-DAEMON")),
        F.lit(" "), F.date_format(C.sort_date(F.col(date)), "EEE MMM dd HH:mm:ss yyyy"))


def record_bytes(separator, raw):
    """One archive record. Body lines that look like a separator are quoted."""
    body = re.sub(rb"(?m)^From ", b">From ", raw)
    if not body.endswith(b"\n"):
        body += b"\n"
    return separator + b"\n" + body + b"\n"


def _suffix(codec):
    return ".mbox" + (C.EXTENSIONS[codec] if codec else "")


def _shard_writer(folder, codec, passed):
    suffix = _suffix(codec)

    def write(batches):
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():05d}{suffix}"
        out = Shard(path, task.taskAttemptId(), codec)
        try:
            yield from rows(batches, path, out)
            out.publish()
        except BaseException:
            out.drop()
            raise

    def rows(batches, path, out):
        for batch in batches:
            offsets, lengths, sums, sizes = [], [], [], []
            for line, raw in zip(batch.column("_from").to_pylist(),
                                 batch.column("raw").to_pylist()):
                record = record_bytes(line.encode(), raw)
                offsets.append(out.size)
                lengths.append(len(record))
                out.write(record)
                # What a reader will see: quoted, with a closing line break.
                stored = message_bytes(record)
                sums.append(hashlib.sha256(stored).hexdigest())
                sizes.append(len(stored))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in passed]
                + [pa.array([path] * batch.num_rows, pa.string()),
                   pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()),
                   pa.array(sums, pa.string()), pa.array(sizes, pa.int64())],
                names=passed + MADE)

    return write


#: What writing finds out about a message.
MADE = ["archive_file", "mbox_offset", "mbox_length", "checksum", "size_bytes"]


class Shard:
    """An archive file in the making. A compressed one is cut into frames that
    are complete in themselves; a zstd file ends in the table of its frames.
    Nothing is made before the first record."""

    def __init__(self, path, attempt, codec):
        self.path, self.attempt, self.codec = path, attempt, codec
        self.out, self.frame, self.waiting, self.size = None, [], 0, 0
        self.frames = []

    def write(self, record):
        if self.out is None:
            self.out = Published(self.path, self.attempt)
        self.size += len(record)
        if self.codec is None:
            self.out.write(record)
            return
        self.frame.append(record)
        self.waiting += len(record)
        if self.waiting >= FRAME_BYTES:
            self._pack()

    def _pack(self):
        if self.frame:
            packed = compress_bytes(b"".join(self.frame), self.codec)
            self.out.write(packed)
            self.frames.append((len(packed), self.waiting))
        self.frame, self.waiting = [], 0

    def publish(self):
        if self.out is not None:
            self._pack()
            if self.codec == "zstd":
                self.out.write(seek_table_bytes(self.frames))
            self.out.publish()

    def drop(self):
        if self.out is not None:
            self.out.drop()


def _pieces(total, shard_bytes):
    """How many pieces a compressed shard is made in."""
    return max(1, math.ceil(min(total, shard_bytes) / PIECE_BYTES))


def assign_shards(slim, order, size, shard_bytes=SHARD_BYTES, shards=None):
    """Slim rows with the number of the output shard each belongs to and of its
    piece in there, how many shards there are, and how many pieces to each: the
    ordered rows are cut every ``shard_bytes``, or into ``shards`` pieces of
    equal size."""
    total = slim.agg(F.sum(size)).first()[0] or 0
    if shards is not None:
        shard_bytes = max(1, math.ceil(total / shards))
    pieces = _pieces(total, shard_bytes)
    placed = ranges.running_total(slim, [], order, F.col(size), "_bytes_before")
    shard = F.floor(F.col("_bytes_before") / shard_bytes).cast("int")
    piece = F.floor(F.col("_bytes_before") % shard_bytes * pieces / shard_bytes).cast("int")
    return (placed.withColumns({"shard": shard, "_piece": piece}).drop("_bytes_before"),
            max(1, math.ceil(total / shard_bytes)), pieces)


def write_mbox(messages, folder, order=("date", "rfc_message_id"), compression=None,
               shard_bytes=SHARD_BYTES, shards=None, pieces=1):
    """Writes messages (with ``raw``) in order to ``folder``, one mbox file per
    shard, and returns each message's columns with its new location and the
    checksum and size of the bytes that a reader will see: body lines that look
    like a separator are quoted, and a missing final line break is added. The
    raw bytes are shuffled once. Rows alike in the order are told apart by
    their bytes, so that a repeated attempt writes the same file.

    Rows that carry a ``shard`` (see ``assign_shards``; ``shards`` and ``pieces``
    tell how many there are) go straight to it. Others are range-partitioned by
    the order, which runs their plan once more to sample it. A compressed shard
    is made in pieces by several tasks, which are then joined."""
    codec = C.validate_compression(compression)
    folder = re.sub(r"^file:/*", "/", folder)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if shards is None:
        total = messages.agg(F.sum(F.octet_length("raw").cast("long"))).first()[0] or 0
        shards = max(1, math.ceil(total / shard_bytes))
        pieces = _pieces(total, shard_bytes)
    if codec is None:
        pieces = 1
    rows = messages.withColumns({"_from": from_line(), "_tie": F.xxhash64("raw")})
    if "shard" in messages.columns:
        seat = F.col("shard") * pieces + F.col("_piece") if pieces > 1 else F.col("shard")
        rows = rows.repartitionById(shards * pieces, seat)
    else:
        rows = rows.repartitionByRange(shards * pieces, *order)
    passed = [f for f in messages.schema if f.name not in ("raw", "shard", "_piece", *MADE)]
    names = [f.name for f in passed]
    # Within a shard only; the last word has a hash, as ids may repeat.
    laid_out = rows.sortWithinPartitions(*order, "_tie").select(*names, "_from", "raw")
    made = [T.StructField("archive_file", T.StringType()),
            T.StructField("mbox_offset", T.LongType()), T.StructField("mbox_length", T.LongType()),
            T.StructField("checksum", T.StringType()), T.StructField("size_bytes", T.LongType())]
    target = folder
    if pieces > 1:
        folder = re.sub(r"^file:/*", "/", scratch(messages.sparkSession, "pieces"))
    locations = laid_out.mapInArrow(_shard_writer(folder, codec, names),
                                    T.StructType(passed + made))
    locations = written(locations, "locations")
    return locations if pieces == 1 else _joined(locations, target, codec, shards, pieces)


def _joined(made, folder, codec, shards, pieces):
    """Rows of messages written in pieces, at their places in the shards that
    the pieces are joined to, a task per shard. Every ``pieces`` files by number
    are a shard; they are removed when all shards are in place."""
    number = F.regexp_extract("_made", r"part-(\d+)[^/]*$", 1).cast("int")
    shard = F.floor(F.col("_number") / pieces).cast("int")
    name = F.concat(F.lit(f"{folder}/part-"), F.format_string("%05d", "_shard"), F.lit(_suffix(codec)))
    earlier = W.partitionBy("_shard").orderBy("_number").rowsBetween(W.unboundedPreceding, -1)
    parts = written(
        made.groupBy(F.col("archive_file").alias("_made"))
        .agg(F.max(F.col("mbox_offset") + F.col("mbox_length")).alias("_size"))
        .withColumn("_number", number).withColumn("_shard", shard).withColumn("_file", name)
        .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))), "parts")
    files = parts.groupBy("_shard", "_file").agg(
        F.sort_array(F.collect_list(F.struct("_number", "_made"))).alias("_parts")).select(
        "_shard", "_file", F.col("_parts._made").alias("_parts")).repartitionById(shards, "_shard")

    def join(batches):
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for path, names in zip(b.column("_file").to_pylist(), b.column("_parts").to_pylist()):
                out, frames = Published(path, attempt), []
                try:
                    for part in names:
                        frames += append_frames(part, out)
                    if codec == "zstd":
                        out.write(seek_table_bytes(frames))
                    out.publish()
                except BaseException:
                    out.drop()
                    raise
            yield b.select(["_file"])

    def remove(batches):
        for b in batches:
            for part in (p for names in b.column("_parts").to_pylist() for p in names):
                if exists(part):
                    delete(part)
            yield b.select(["_file"])

    for step in (join, remove):
        files.mapInArrow(step, "_file string").write.format("noop").mode("overwrite").save()
    places = joins.keys_for_join(parts.select("_made", "_file", "_before"))
    columns = {"archive_file": F.col("_file"), "mbox_offset": F.col("mbox_offset") + F.col("_before")}
    return made.join(places, F.col("archive_file") == F.col("_made")).select(
        *[columns.get(c, F.col(c)).alias(c) for c in made.columns])


# --------------------------------------------------------------------- extract


def _located(batches):
    """(batch, row, record bytes or None, error) for rows sorted by archive and
    offset. Plain files are sought. Compressed ones are streamed forward once,
    those with a table of frames from the frame of the first message on."""
    path = stream = table = None
    position = 0
    for batch in batches:
        for i, (name, offset, length) in enumerate(zip(
                batch.column("archive_file").to_pylist(),
                batch.column("mbox_offset").to_pylist(),
                batch.column("mbox_length").to_pylist())):
            data = error = None
            try:
                if offset is None or length is None or offset < 0 or length < 0:
                    raise ValueError("invalid location")
                compressed = codec_of(name) is not None
                if name != path or (compressed and offset < position):
                    if stream is not None:
                        stream.close()
                    path = stream = None
                    if not exists(name):
                        raise FileNotFoundError(f"archive not found: {name}")
                    table = seek_table(name)
                    position = offset if table else 0
                    stream = (open_at(name, offset, table) if table else
                              open_decoded(name) if compressed else open_random(name))
                    path = name
                if compressed:
                    while position < offset:
                        skipped = stream.read(min(1 << 20, offset - position))
                        if not skipped:
                            break
                        position += len(skipped)
                    data = stream.read(length) if position == offset else b""
                    while data and len(data) < length:
                        more = stream.read(length - len(data))
                        if not more:
                            break
                        data += more
                    position += len(data)
                else:
                    stream.seek(offset)
                    data = stream.read(length)
            except Exception as problem:  # noqa: BLE001 - reported per row
                error = f"{type(problem).__name__}: {problem}"
            yield batch, i, data, error
    if stream is not None:
        stream.close()


def _entered(rows):
    """The zstd archives among the rows that have a table of frames."""
    def look(batches):
        for b in batches:
            names = b.column("_entered").to_pylist()
            there = [n for n in names if exists(n) and seek_table(n) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.string())], names=["_entered"])

    names = rows.filter(C.compression_of(F.col("archive_file")) == "zstd").select(
        F.col("archive_file").alias("_entered")).distinct()
    return names.mapInArrow(look, "_entered string")


def _by_archive(rows):
    """Rows grouped for reading: byte ranges of archives that can be entered
    in the middle are spread over tasks, another one stays with one."""
    marked = rows.join(_entered(rows), F.col("archive_file") == F.col("_entered"), "left")
    splits = C.compression_of(F.col("archive_file")).isNull() | F.col("_entered").isNotNull()
    piece = F.when(splits, F.floor(F.coalesce("mbox_offset", F.lit(0)) / ranges.RANGE_BYTES))
    return (marked.withColumn("_piece", F.coalesce(piece, F.lit(0))).drop("_entered")
            .repartition("archive_file", "_piece")
            .sortWithinPartitions("archive_file", "_piece", "mbox_offset").drop("_piece"))


def _reading(rows, fields, judge):
    """Adds the fields that ``judge`` makes of each row and its record."""
    schema = T.StructType(list(rows.schema) + fields)
    names = [f.name for f in fields]
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in fields]
    inputs = rows.columns

    def run(batches):
        batch, made, first, size = None, [], 0, 0
        for current, i, data, error in _located(batches):
            if made and (current is not batch or size >= READ_BYTES):
                yield flush(batch.slice(first, len(made)), made)
                made, size = [], 0
            if not made:
                batch, first = current, i
            made.append(judge(current, i, data, error))
            size += len(data or b"")
        if made:
            yield flush(batch.slice(first, len(made)), made)

    def flush(batch, made):
        arrays = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in inputs] + arrays, names=inputs + names)

    return _by_archive(rows).mapInArrow(run, schema)


def extract_messages(located):
    """Record bytes of messages by stored location, with ``status`` and
    ``error``. Fewer bytes than the stored length are a failure."""
    def judge(batch, i, data, error):
        wanted = batch.column("mbox_length")[i].as_py()
        if not error and len(data) != wanted:
            error = f"truncated: expected {wanted} bytes, read {len(data)}"
        return (None, "failed", error) if error else (data, "extracted", None)

    fields = [T.StructField("raw", T.BinaryType()), T.StructField("status", T.StringType()),
              T.StructField("error", T.StringType())]
    return _reading(located, fields, judge)


def extract_ids(messages, ids, key="gmail_id"):
    """Extraction of wanted ids; an id without a catalogue row fails. Only the
    catalogue rows of wanted ids are aggregated."""
    wanted = ids.select(key).distinct()
    places = joins.lookup_messages(
        messages.select(key, "archive_file", "mbox_offset", "mbox_length"), wanted, key
    ).groupBy(key).agg(F.min(F.struct("archive_file", "mbox_offset", "mbox_length")).alias("_at"))
    rows = wanted.join(places, key, "left").select(key, "_at.*")
    known = extract_messages(rows.filter(F.col("archive_file").isNotNull()))
    unknown = rows.filter(F.col("archive_file").isNull()).select(
        *rows.columns, F.lit(None).cast("binary").alias("raw"), F.lit("failed").alias("status"),
        F.concat(F.lit("message not in catalogue: "), F.col(key)).alias("error"))
    return known.unionByName(unknown)


def write_eml(extracted, folder, key="gmail_id"):
    """Writes one ``.eml`` file per extracted message; returns the outcome. A
    name that had to be changed to be safe gets a hash of the key, so that two
    keys never share a file. For many messages take the table of
    ``extract_messages`` or ``write_mbox``: each file is an object."""
    folder = re.sub(r"^file:/*", "/", folder)
    plain = F.concat(F.col(key), F.lit(".eml"))
    safe = C.safe_filename(plain, 240)
    stem = F.coalesce(F.regexp_replace(safe, r"\.eml$", ""), F.lit("message"))
    hashed = F.concat(stem, F.lit("-"),
                      F.left(F.sha2(F.col(key), 256), F.lit(12)), F.lit(".eml"))
    named = extracted.withColumn("_name", F.when(safe == plain, safe).otherwise(hashed))

    def write(batches):
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, raw, status in zip(*(batch.column(c).to_pylist()
                                           for c in ("_name", "raw", "status"))):
                if status == "extracted":
                    out = Published(f"{folder}/{name}", attempt)
                    out.write(raw)
                    out.publish()
            yield batch.select([key, "status", "error"])

    schema = T.StructType([T.StructField(c, T.StringType()) for c in (key, "status", "error")])
    return written(named.select(key, "status", "error", "_name", "raw").mapInArrow(write, schema),
                   "extracted")


def extraction_summary(outcome):
    return outcome.agg(F.count_if(F.col("status") == "extracted").alias("extracted"),
                       F.count_if(F.col("status") == "failed").alias("failed"))


def verify_offsets(messages):
    """Reads every message at its stored location: ``status`` is ok, or what
    is wrong with it. A message without Message-ID must have the id that is
    made of its subject and date."""
    at = ["gmail_id", "rfc_message_id", "archive_file", "mbox_offset", "mbox_length"]

    def judge(batch, i, data, error):
        if error:
            return ("read error", error)
        wanted = batch.column("mbox_length")[i].as_py()
        if len(data) != wanted:
            return ("length mismatch", f"expected {wanted}, read {len(data)}")
        if not data.startswith(b"From "):
            return ("id mismatch", "no message starts here")
        parsed = parse_one(message_bytes(data))
        found = (parsed.get("message_id") or "").strip(C.WHITESPACE) or generated_id(parsed)
        expected = batch.column("rfc_message_id")[i].as_py()
        if found != expected:
            return ("id mismatch", f"expected {expected}, got {found}")
        return ("ok", None)

    fields = [T.StructField("status", T.StringType()), T.StructField("error", T.StringType())]
    return _reading(messages.select(*at), fields, judge)


def compare_checksums(archived, messages):
    """Each catalogue row with ``status``: ok, checksum mismatch, or missing if
    no message of the parsed archives stands at its place. Every message is
    compared; nothing is read again."""
    found = archived.select(*LOCATION, F.col("checksum").alias("_found"), F.lit(True).alias("_there"))
    status = (F.when(F.col("_there").isNull(), "missing")
              .when(F.col("_found").eqNullSafe(F.col("checksum")), "ok").otherwise("checksum mismatch"))
    return messages.select(*LOCATION, "checksum").join(found, list(LOCATION), "left").select(
        *LOCATION, status.alias("status"))


# -------------------------------------------------------------------- compress


FILE = "source_file string, dest_file string, original_size long, skipped boolean"


def _targets(spark, files, codec):
    """One row per archive file. A file counts as compressed by its suffix or
    by a compressed file next to it. Each folder is listed once."""
    wanted = [re.sub(r"^file:/*", "/", f) for f in files]
    there = {}
    for folder in {posixpath.dirname(f) for f in wanted}:
        there.update(list_files(f"{folder}/*"))
    rows = []
    for name in wanted:
        if name not in there:
            raise FileNotFoundError(f"archive not found: {name}")
        done = codec_of(name) is not None or any(name + e in there for e in C.EXTENSIONS.values())
        rows.append((name, None if done else name + C.EXTENSIONS[codec], there[name], done))
    return spark.createDataFrame(rows, FILE)


def compress_archives(spark, files, compression="zstd", dry_run=False,
                      frame_bytes=FRAME_BYTES, in_place=False, keep_original=True):
    """Compresses archive files and returns one result row per file. A file is
    cut into frames that are compressed and checked by separate tasks, then
    joined in order. A dry run compresses the frames too, so its sizes are
    exact, but publishes nothing.

    Sources stay unless ``in_place`` is set or ``keep_original`` is not; they
    are removed once the compressed file is in its place. A catalogue must then
    be repointed (``repoint``)."""
    codec = C.validate_compression(compression)
    if codec is None or not files:
        raise ValueError("files and a compression are needed")
    targets = _targets(spark, files, codec)
    todo = targets.filter(~F.col("skipped"))
    if dry_run:
        done = _measured(todo, codec, frame_bytes)
    else:
        done = _compressed(todo, codec, frame_bytes)
        if in_place or not keep_original:
            _remove_sources(done)
    skipped = targets.filter("skipped").withColumn("compressed_size", F.lit(0).cast("long"))
    rows = done.unionByName(skipped)
    saved = F.when(F.col("skipped"), 0).otherwise(F.col("original_size") - F.col("compressed_size"))
    ratio = F.when(F.col("skipped"), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide("original_size", "compressed_size"), F.lit(0.0)))
    return rows.withColumns({"space_saved": saved, "compression_ratio": ratio})


#: Tasks that compress the frames of a job, at most.
FRAME_TASKS = 10_000


def _frames(todo, frame_bytes):
    """One row per frame of each file, dealt out evenly over as many tasks. A
    number of partitions is given, as the rows are small: adaptive execution
    would otherwise leave them all to one task."""
    last = F.greatest(F.ceil(F.col("original_size") / frame_bytes) - 1, F.lit(0))
    frames = todo.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    before, tasks = 0, []
    for r in todo.select("source_file", (last + 1).alias("n")).collect():
        tasks.append((r.source_file, before))
        before += r.n
    count = max(1, min(before, FRAME_TASKS))
    firsts = todo.sparkSession.createDataFrame(tasks, "source_file string, _first long")
    seat = F.pmod(F.col("_first") + F.col("frame"), F.lit(count)).cast("int")
    return frames.join(F.broadcast(firsts), "source_file").withColumn("_task", seat).repartitionById(
        count, "_task").select(*frames.columns)


def _file_by_file(rows):
    """The rows of each file in one task, the files dealt out evenly over as
    many tasks."""
    names = sorted(r.source_file for r in rows.select("source_file").distinct().collect())
    count = max(1, min(len(names), FRAME_TASKS))
    seats = rows.sparkSession.createDataFrame(
        [(n, i % count) for i, n in enumerate(names)], "source_file string, _task int")
    return rows.join(F.broadcast(seats), "source_file").repartitionById(count, "_task").select(*rows.columns)


def _packed(path, frame, frame_bytes, codec):
    """One frame, compressed and read back."""
    with open_random(path) as f:
        f.seek(frame * frame_bytes)
        data = f.read(frame_bytes)
    packed = compress_bytes(data, codec)
    with decoder(pa.BufferReader(packed), codec) as check:
        if check.read() != data:
            raise OSError(f"compressed frame {frame} of {path} does not read back")
    return packed


def _measured(todo, codec, frame_bytes):
    def measure(batches):
        for b in batches:
            sizes = [len(_packed(path, frame, frame_bytes, codec)) for path, frame in zip(
                b.column("source_file").to_pylist(), b.column("frame").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(sizes, pa.int64())], names=[*b.schema.names, "part_size"])

    names = ["source_file", "dest_file", "original_size", "skipped"]
    made = _frames(todo, frame_bytes).mapInArrow(measure, FILE + ", frame long, part_size long")
    one, two = (len(seek_table_bytes([(0, 0)] * n)) for n in (1, 2))
    table = F.lit(2 * one - two) + F.count("*") * (two - one) if codec == "zstd" else F.lit(0)
    return written(made.groupBy(*names).agg(
        (F.sum("part_size") + table).cast("long").alias("compressed_size")), "measured")


def _remove_sources(done):
    """Deletes the sources of compressed files, a task per file."""
    def remove(batches):
        for b in batches:
            for source, dest in zip(*(b.column(c).to_pylist() for c in ("source_file", "dest_file"))):
                if exists(dest) and exists(source):
                    delete(source)
            yield b

    _file_by_file(done.select("source_file", "dest_file")).mapInArrow(
        remove, "source_file string, dest_file string").write.format("noop").mode("overwrite").save()


def _compressed(todo, codec, frame_bytes):
    parts = scratch(todo.sparkSession, "frames")
    parts = re.sub(r"^file:/*", "/", parts)

    def compress(batches):
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            names, sizes = [], []
            for path, frame in zip(b.column("source_file").to_pylist(),
                                   b.column("frame").to_pylist()):
                packed = _packed(path, frame, frame_bytes, codec)
                key = hashlib.sha256(path.encode()).hexdigest()[:24]
                out = Published(f"{parts}/{key}-{frame:08d}", attempt)
                out.write(packed)
                out.publish()
                names.append(out.path)
                sizes.append(len(packed))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names, pa.string()), pa.array(sizes, pa.int64())],
                names=[*b.schema.names, "part", "part_size"])

    made = written(_frames(todo, frame_bytes).mapInArrow(
        compress, FILE + ", frame long, part string, part_size long"), "frames")
    # As for the frames: one task would join the frames of all files.
    ordered = _file_by_file(made).sortWithinPartitions("source_file", "frame")

    def join(batches):
        attempt = TaskContext.get().taskAttemptId()
        source = out = row = None
        frames, results = [], []

        def finish():
            table = seek_table_bytes(frames) if codec == "zstd" else b""
            out.write(table)
            out.publish()
            results.append({**row, "compressed_size": sum(c for c, _ in frames) + len(table)})

        for b in batches:
            for r in b.to_pylist():
                if r["source_file"] != source:
                    if out is not None:
                        finish()
                    source, row, frames = r["source_file"], r, []
                    out = Published(r["dest_file"], attempt)
                with open_random(r["part"]) as f:
                    out.write(f.read())
                start = r["frame"] * frame_bytes
                frames.append((r["part_size"], min(frame_bytes, r["original_size"] - start)))
        if out is not None:
            finish()
        names = ["source_file", "dest_file", "original_size", "skipped", "compressed_size"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in results], k) for n, k in zip(names, kinds)], names=names)

    return written(ordered.mapInArrow(join, FILE + ", compressed_size long"), "compressed")


def repoint(messages, results):
    """Catalogue with the archives that were compressed under their new name.
    Offsets refer to uncompressed bytes and stay."""
    moved = results.filter(F.col("dest_file").isNotNull()).select(
        F.col("source_file").alias("archive_file"), "dest_file")
    return messages.join(moved, "archive_file", "left").withColumn(
        "archive_file", F.coalesce("dest_file", "archive_file")).select(*messages.columns)
