"""The stored text index: immutable segments, block bounds, tombstones.

A segment holds the messages of one ``add``. They are numbered by length, in
blocks of 64, and two tables are written once:

* ``blocks``: a row per (term, block): which of its documents have the term,
  as the bits of one BIGINT, how often and of what length each is, the most
  occurrences and the least length; in columns of their own the postings, one
  per document and column, with positions;
* ``docs``: where each document's message lies, and its length.

Blocks lie in buckets of the first two letters of the term, sorted by term and
block, so a word or a prefix is one bucket. The documents of a block are
indexed in one task, so its rows are whole before anything but texts is moved.
A text finds its task by its length, so it is moved once, without a join; large
additions and merges go in rounds, whose shuffle files are removed in between.

A search of words reads no postings. The bits of the blocks give the number of matches and
the document frequencies exactly; a score needs the occurrences in them. Where
there are many blocks, the bounds give the best score that each may hold: the
best ones are scored, then those that can still reach the last place of the
page, and no others. Documents of like length share a block, so its bound is
close. Phrases, near words and column filters read the postings of the
documents that hold all their words, as the bits tell.

Adding messages writes one segment, dropping some writes tombstone bits; both
end in a new version, a small table that names the live segments. Readers keep
the version they have opened. ``merge`` joins segments of like size.
"""

import math
import re
import uuid
from dataclasses import dataclass, replace
from functools import reduce
from itertools import chain

import xxhash
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.functions import text as X
from mailspark.operators import index as I
from mailspark.operators import joins, ranges
from mailspark.operators import search as Q
from mailspark.schema import LOCATION
from mailspark.session import cleared, written

#: Documents of a block: the bits of a BIGINT.
BLOCK = 64

BUCKETS = 256

#: Segments of like size that ``merge`` waits for.
FANOUT = 8

#: Rows of a parquet page of postings; what is skipped is skipped by pages.
PAGE_ROWS = 2048

#: Characters of text that a task indexes at most, so that its rows are sorted
#: in memory, and those worth a task of their own.
TASK_BYTES, LEAST_BYTES = 32 << 20, 2 << 20

#: Characters that a token and what stands between two make up, about.
TOKEN_CHARS = 6

#: Tasks that write all buckets, at most, and characters that one of them may
#: have before there are more and rows are moved to their bucket.
WRITERS, MOST_BYTES = 256, 128 << 20

#: Characters of text that a round moves, and rounds at most.
ROUND_BYTES, ROUNDS = 1 << 30, 16

#: Parts of the texts of like length, at most; a task has some whole ones.
CELLS = 4096

#: A page of results that ends beyond this is cut on the cluster, not looked
#: for block by block; the blocks that the driver names are bounded likewise.
DEEP = 10_000

#: Blocks up to which all are scored at once.
AT_ONCE = 4096

#: Blocks that are tried first, where there are more.
FIRST = 16

#: Rows beyond a page that are fetched with it, to settle ties at its end.
TIES = 1000

#: Bounds are raised by this share, more than rounding can lower them.
ROUNDING = 1e-9

_BLOCKS = ("term string, block long, bits long, most long, least long, "
           "entries array<struct<seat: int, tf: long, dl: long>>, segment string, bucket int")
#: The postings of a row: arrays of one length, documents by their place in
#: the entries, columns by their number.
_PLACES = "ats array<tinyint>, cols array<tinyint>, places array<array<int>>"
_MADE = _BLOCKS.replace("segment string, bucket int", _PLACES)
_DOCS = f"doc long, {LOCATION[0]} string, {LOCATION[1]} long, dl long, segment string"
_DEAD = "block long, bits long, segment string"
_VERSION = ("segment string, messages long, tokens long, dead string, filled array<int>, "
            "columns array<string>, stemmed boolean, buckets int")
_TOP = f"{LOCATION[0]} string, {LOCATION[1]} long, relevance_score double"

_AT = ["segment", "block"]
_LAST = "\U0010ffff"


@dataclass(frozen=True)
class Segment:
    """A live segment: messages and tokens that are not dropped, the folder of
    its tombstones ('' if none), and its buckets that have rows."""

    segment: str
    messages: int
    tokens: int
    dead: str
    filled: tuple


def create(spark, path, columns=X.INDEXED, stemmed=True, buckets=BUCKETS):
    """A new, empty index under ``path``. What it is made with is stored with
    it."""
    return SegmentedIndex(spark, path, tuple(columns), stemmed, buckets, -1, ())._next(())


def open_index(spark, path):
    """The latest version of the index under ``path``."""
    rows = spark.read.schema(f"{_VERSION}, version long").parquet(f"{path}/versions").collect()
    if not rows:
        raise ValueError(f"no index under {path}")
    latest = [r for r in rows if r.version == max(r.version for r in rows)]
    about = latest[0]
    live = tuple(Segment(r.segment, r.messages, r.tokens, r.dead, tuple(r.filled))
                 for r in latest if r.segment)
    return SegmentedIndex(spark, path, tuple(about.columns), about.stemmed, about.buckets,
                          about.version, live)


def bucket_of(word, buckets):
    """The bucket of a word: of its first two letters."""
    value = xxhash.xxh64_intdigest(word[:2].encode(), 42)
    return (value - (1 << 64) if value >> 63 else value) % buckets


def _bucket(term, buckets):
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(buckets)).cast("int")


def _bit(doc="doc"):
    return F.expr(f"shiftleft(1L, cast(pmod({doc}, {BLOCK}) as int))")


def _has(bits, doc="doc"):
    return F.expr(f"shiftright({bits}, cast(pmod({doc}, {BLOCK}) as int)) & 1L") == 1


#: Row of a partition, from 0.
_ROW = f"monotonically_increasing_id() & {(1 << 33) - 1}L"


def _cell(parts):
    """Number of the part that a text of ``_size`` at a location is in: by its
    length, in eighths of a power of two, and a hash. In whole numbers, so that
    every pass has the same."""
    at, bits = ", ".join(LOCATION), "length(bin(_size + 8L))"
    return F.expr(f"({bits} * 8L + (shiftright(_size + 8L, {bits} - 4) & 7L)) * {parts}L"
                  f" + pmod(xxhash64({at}), {parts}L)")


def _dealt(lengths, parts, tasks):
    """Parts dealt out over tasks, by length and of like size: (part, task,
    number of the task's first document), and the number after all."""
    cells = sorted(map(tuple, lengths.groupBy(_cell(parts)).agg(
        F.sum("_size"), F.count("*")).collect()))
    total = max(1, sum(c[1] for c in cells))
    rows, before, held, base, current = [], 0, 0, 0, 0
    for cell, size, count in cells:
        task = min(before * tasks // total, tasks - 1)
        if task != current:
            base, held, current = base + -(-held // BLOCK) * BLOCK, 0, task
        rows.append((cell, task, base))
        before, held = before + size, held + count
    return rows, base + -(-held // BLOCK) * BLOCK


def _block(doc="doc"):
    return F.floor(F.col(doc) / BLOCK)


def _quoted(word):
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _holds(slot):
    """SQL test of a row's term. Plans of searches are written as SQL texts: a
    search is short, and a call for each of its many small expressions would
    take longer than its jobs."""
    word, opened = slot
    return f"startswith(term, {_quoted(word)})" if opened else f"term = {_quoted(word)}"


def _wanted(every):
    """SQL test of a term being searched; a prefix is a range of terms."""
    words = sorted({w for w, opened in every if not opened})
    tests = [f"term IN ({', '.join(map(_quoted, words))})"] if words else []
    tests += [f"term >= {_quoted(w)} AND term < {_quoted(w + _LAST)}" for w, opened in every if opened]
    return "(" + ") OR (".join(tests) + ")"


def _slots(terms):
    return list(dict.fromkeys(s for t in terms for s in I.slots(t)))


def _positive(terms):
    return [i for i, t in enumerate(terms) if not t.negated]


def _matching(terms, any_of):
    """SQL test of the counts of a match."""
    tests = [f"_n{i} = 0" for i, t in enumerate(terms) if t.negated]
    wanted = (" OR " if any_of else " AND ").join(f"_n{i} > 0" for i in _positive(terms))
    return " AND ".join([f"({wanted})", *tests])


def _matched(terms, any_of):
    """SQL of the bits of the documents that match plain terms."""
    wanted = (" | " if any_of else " & ").join(f"t{i}" for i in _positive(terms))
    absent = [f"~t{i}" for i, t in enumerate(terms) if t.negated]
    return "(" + " & ".join([f"({wanted})", *absent]) + ")"


def _runs(numbers):
    """Sorted whole numbers as (first, last) of their unbroken runs."""
    out = []
    for n in sorted(numbers):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return out


@dataclass(frozen=True)
class SegmentedIndex:
    """One version of a stored index. Searches take it as ``index=``;
    ``messages`` is the catalogue that the results are shown from. ``add``,
    ``drop``, ``sync`` and ``merge`` give the next version."""

    spark: object
    path: str
    columns: tuple
    stemmed: bool
    buckets: int
    version: int
    segments: tuple

    @property
    def size(self):
        return sum(s.messages for s in self.segments)

    @property
    def tokens(self):
        return sum(s.tokens for s in self.segments)

    # ------------------------------------------------------------- versions

    def _next(self, segments):
        """Writes the next version; its one file is what makes it current. A
        version that another writer has made meanwhile is an error."""
        made = replace(self, version=self.version + 1, segments=tuple(segments))
        rows = [(s.segment, s.messages, s.tokens, s.dead, list(s.filled), list(self.columns),
                 self.stemmed, self.buckets)
                for s in segments or [Segment("", 0, 0, "", ())]]
        (self.spark.createDataFrame(rows, _VERSION).coalesce(1).write.mode("errorifexists")
         .parquet(f"{self.path}/versions/version={made.version}"))
        return made

    def add(self, messages):
        """Indexes messages that the index does not hold, as one segment. No
        earlier segment is read or written. The messages are read for their
        lengths, then once a round, so they should be cheap to read."""
        messages = messages.select(*LOCATION, *self.columns).dropna(subset=list(LOCATION))
        size = sum((F.length(F.coalesce(F.col(c), F.lit(""))) for c in self.columns), F.lit(0)).cast("long")
        slim = written(Q.tokenized(messages, self.columns).select(
            *LOCATION, size.alias("_size"), Q._length(self.columns).alias("dl")), "lengths")
        repeated = written(slim.groupBy(*LOCATION).agg(F.count("*").alias("n")).filter("n > 1")
                           .select(*LOCATION), "repeated")
        lengths, texts, others = slim, messages.withColumn("_size", size), None
        if not repeated.isEmpty():
            others = joins.keys_for_join(repeated)
            lengths, texts = (t.join(others, list(LOCATION), "left_anti") for t in (lengths, texts))
        total = lengths.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
        tasks = self._tasks(total)
        parts = min(CELLS, 1 << (tasks - 1).bit_length())
        cells, end = _dealt(lengths, parts, tasks)
        row = F.row_number().over(W.partitionBy("_task").orderBy("_size", *LOCATION)) - 1
        docs = self._to_tasks(lengths, cells, parts).select(
            (F.col("_base") + row).alias("doc"), *LOCATION, "dl")
        made = self._built(texts, cells, parts, tasks, self._rounds(total, tasks))
        if others is not None:
            more, blocks = self._again(slim.join(others, list(LOCATION), "left_semi"), messages, end)
            docs, made = docs.unionByName(more), chain(made, [blocks])
        segment = self._write(docs, made, tasks)
        return self if segment is None else self._next([*self.segments, segment])

    def _to_tasks(self, rows, cells, parts):
        dealt = self.spark.createDataFrame(cells, "_cell long, _task int, _base long")
        return rows.withColumn("_cell", _cell(parts)).join(F.broadcast(dealt), "_cell").drop("_cell")

    def _built(self, texts, cells, parts, tasks, rounds):
        """The rows of texts at places of their own, round by round. A task
        numbers its texts as the documents are numbered."""
        for k in range(rounds):
            first, end = tasks * k // rounds, tasks * (k + 1) // rounds
            here = [(cell, task - first, base) for cell, task, base in cells if first <= task < end]
            rows = self._to_tasks(texts, here, parts).repartitionById(end - first, "_task")
            rows = rows.sortWithinPartitions("_size", *LOCATION).select(
                (F.col("_base") + F.expr(_ROW)).alias("doc"), *self.columns)
            yield I.build_blocks(rows, self.columns, self.stemmed, BLOCK, _MADE)

    def _again(self, lengths, messages, first):
        """Documents and rows of places that come several times: each of their
        numbers, from ``first`` on, has all texts of the place."""
        numbers = written(ranges.positions(
            lengths.drop("dl"), [], [F.col("_size"), *map(F.col, LOCATION)], "doc").select(
            *LOCATION, (F.col("doc") + first).alias("doc")), "numbers")
        at = joins.keys_for_join(numbers)
        docs = lengths.join(at, list(LOCATION)).select("doc", *LOCATION, "dl")
        tasks = self._tasks(lengths.agg(F.sum("_size")).first()[0])
        texts = messages.join(at, list(LOCATION)).select("doc", *self.columns)
        texts = texts.repartition(tasks, _block()).sortWithinPartitions("doc")
        return docs, I.build_blocks(texts, self.columns, self.stemmed, BLOCK, _MADE)

    def _tasks(self, size):
        """Tasks that make the rows of so many characters of text."""
        few = min(self.spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES))
        many = min(-(-size // TASK_BYTES), max(WRITERS, -(-size // MOST_BYTES)))
        return max(1, few, many)

    def _rounds(self, size, tasks):
        """Rounds for so many characters of text; each keeps all cores busy."""
        wide = max(1, tasks // self.spark.sparkContext.defaultParallelism)
        return max(1, min(ROUNDS, -(-size // ROUND_BYTES), wide))

    def _write(self, docs, made, tasks):
        """The tables of a new segment, its rows coming round by round from so
        many tasks; None if it has no messages."""
        name, at = uuid.uuid4().hex[:16], "{}/{}/segment={}".format
        with cleared(self.spark):
            docs.repartitionByRange("doc").sortWithinPartitions("doc").write.option(
                "compression", "zstd").parquet(at(self.path, "docs", name))
        docs = self.spark.read.parquet(at(self.path, "docs", name))
        messages, tokens = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not messages:
            return None
        # Each task writes its part of every bucket, so rows are not moved
        # again. Of very many tasks that would be too many files: then the rows
        # go to their bucket, that of a common term by way of several tasks.
        options = {"compression": "zstd", "parquet.page.row.count.limit": str(PAGE_ROWS)}
        for blocks in made:
            blocks = blocks.withColumn("bucket", _bucket("term", self.buckets))
            if tasks > WRITERS:
                blocks = blocks.hint("rebalance", "bucket")
            with cleared(self.spark):
                (blocks.sortWithinPartitions("bucket", "term", "block").write.mode("append")
                 .partitionBy("bucket").options(**options).parquet(at(self.path, "blocks", name)))
        files = self.spark.read.schema(_BLOCKS.replace("segment string, ", "")).parquet(
            at(self.path, "blocks", name)).inputFiles()
        filled = {int(re.search(r"/bucket=(\d+)/[^/]*$", f)[1]) for f in files}
        return Segment(name, messages, tokens, "", tuple(sorted(filled)))

    def docs(self):
        """(doc, archive_file, mbox_offset, dl, segment) of all messages that
        are not dropped."""
        return self._alive(self._docs())

    def _docs(self):
        paths = [f"{self.path}/docs/segment={s.segment}" for s in self.segments]
        return self._read("docs", _DOCS, paths)

    def _read(self, kind, schema, paths):
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def _dead(self):
        """(segment, block, dead): bits of the dropped messages; None if there
        are none."""
        folders = [f"{self.path}/dead/{s.dead}" for s in self.segments if s.dead]
        if not folders:
            return None
        parts = [self.spark.read.schema(_DEAD).parquet(f).filter(F.col("segment") == s.segment)
                 for f, s in zip(folders, [s for s in self.segments if s.dead])]
        return reduce(lambda a, b: a.unionByName(b), parts).select(*_AT, F.col("bits").alias("dead"))

    def _alive(self, docs):
        dead = self._dead()
        if dead is None:
            return docs
        return docs.withColumn("block", _block()).join(dead, _AT, "left").filter(
            F.col("dead").isNull() | ~_has("dead")).drop("block", "dead")

    def drop(self, messages):
        """Takes the messages at these locations (any columns, by
        archive_file and mbox_offset) out of the index: their bits are set in
        new tombstones of the segments concerned. What is not indexed is
        ignored. No posting is read or written."""
        keys = messages.select(*LOCATION).distinct()
        gone = written(self.docs().join(joins.keys_for_join(keys), list(LOCATION)).select(
            "segment", "doc", "dl"), "gone")
        lost = {r.segment: r for r in gone.groupBy("segment").agg(
            F.count("*").alias("messages"), F.sum("dl").alias("tokens")).collect()}
        if not lost:
            return self
        bits = gone.groupBy("segment", _block().alias("block")).agg(F.bit_or(_bit()).alias("bits"))
        earlier = self._dead()
        if earlier is not None:
            bits = bits.unionByName(earlier.withColumnRenamed("dead", "bits").filter(
                F.col("segment").isin(list(lost)))).groupBy(*_AT).agg(F.bit_or("bits").alias("bits"))
        folder = uuid.uuid4().hex[:16]
        bits.select("block", "bits", "segment").write.partitionBy("segment").parquet(f"{self.path}/dead/{folder}")
        return self._next([
            replace(s, messages=s.messages - lost[s.segment].messages,
                    tokens=s.tokens - lost[s.segment].tokens, dead=folder)
            if s.segment in lost else s for s in self.segments
            if s.segment not in lost or s.messages > lost[s.segment].messages])

    def drop_archives(self, names):
        """Takes all messages of these archives out of the index."""
        return self.drop(self._docs().filter(F.col("archive_file").isin(list(names))))

    def differences(self, messages):
        """Locations that only the index ('orphaned') or only the catalogue
        ('missing') has."""
        return I.compare_index(messages, self.docs())

    def sync(self, messages):
        """Brings the index in line with a catalogue that has the indexed
        columns: orphans are dropped, missing messages are added. All others
        stay as they are."""
        differing = written(self.differences(messages), "differing")
        after = self.drop(differing.filter("status = 'orphaned'"))
        missing = differing.filter("status = 'missing'").select(*LOCATION)
        if missing.isEmpty():
            return after
        return after.add(messages.join(joins.keys_for_join(missing), list(LOCATION), "left_semi"))

    def merge(self, fanout=FANOUT, everything=False):
        """Joins segments of like size, dropped messages left out: those of a
        tier (messages in powers of ``fanout``) as soon as there are
        ``fanout`` of them, or all of them. A message is thus rewritten a
        logarithmic number of times. The texts are not read."""
        tiers = {}
        for s in self.segments:
            tier = 0 if everything else int(math.log(max(s.messages, 1), fanout) + ROUNDING)
            tiers.setdefault(tier, []).append(s)
        least = 1 if everything else fanout
        full = [group for _, group in sorted(tiers.items()) if len(group) >= least]
        if not full or everything and len(full[0]) == 1 and not full[0][0].dead:
            return self
        old = replace(self, segments=tuple(full[0]))
        docs = ranges.positions(
            old.docs(), [], [F.col("dl"), *map(F.col, LOCATION)], "_new")
        docs = written(docs, "renumbered")
        numbers = docs.select("segment", F.col("doc").alias("_old"), F.col("_new").alias("doc"))
        size = old.tokens * TOKEN_CHARS
        tasks = self._tasks(size)
        made = old._write(docs.select(F.col("_new").alias("doc"), *LOCATION, "dl"),
                          old._renumbered(numbers, tasks, self._rounds(size, tasks)), tasks)
        rest = [s for s in self.segments if s not in full[0]]
        return self._next([*rest, *([made] if made else [])])

    def _renumbered(self, numbers, tasks, rounds):
        """The rows of all blocks for documents of new numbers (segment, _old,
        doc), some buckets a round. What goes to one new block is put together
        where it is read, and only such pieces of rows are moved."""
        new = written(numbers.groupBy("segment", _block("_old").alias("block")).agg(F.collect_list(
            F.struct(F.pmod("_old", F.lit(BLOCK)).cast("tinyint").alias("seat"), "doc")).alias("_to")), "moves")
        new = joins.keys_for_join(new)
        filled = sorted({b for s in self.segments for b in s.filled})
        rounds = max(1, min(rounds, len(filled)))
        piece = ["term", "block", "bits", "most", "least", "entries",
                 "transform(ats, a -> cast(entries[a].seat AS tinyint)) AS seats", "cols", "places"]
        whole = [F.bit_or("bits").alias("bits"), F.max("most").alias("most"), F.min("least").alias("least"),
                 F.sort_array(F.flatten(F.collect_list("entries"))).alias("entries")]
        whole += [F.flatten(F.collect_list(c)).alias(c) for c in ("seats", "cols", "places")]
        # A document's place in the entries: as many bits are set below its own.
        ats = F.expr("transform(seats, s -> cast(bit_count(bits & ~shiftleft(-1L, s)) AS tinyint))")
        for k in range(rounds):
            rows = self._lookup("blocks", f"{_BLOCKS}, {_PLACES}", None, set(filled[k::rounds])).join(new, _AT)
            moved = rows.select("term", "entries", "ats", "cols", "places", "_to").mapInArrow(
                I.regrouped(BLOCK), _MADE)
            yield moved.selectExpr(*piece).repartition(-(-tasks // rounds), "block").groupBy(
                "term", "block").agg(*whole).withColumn("ats", ats).drop("seats")

    # --------------------------------------------------------------- lookup

    def _lookup(self, kind, schema, every, wanted=None):
        """Rows of the searched words and prefixes, pruned to their buckets, or
        all rows of the wanted ones."""
        if every is not None and not any(opened and len(w) < 2 for w, opened in every):
            wanted = {bucket_of(w, self.buckets) for w, _ in every}
        paths = [f"{self.path}/{kind}/segment={s.segment}/bucket={b}" for s in self.segments
                 for b in s.filled if wanted is None or b in wanted]
        rows = self._read(kind, schema, paths)
        return rows if every is None else rows.filter(_wanted(every))

    def _postings(self, every):
        """A row per (term, document, column) of the searched words, or of
        all."""
        return self._unfolded(self._lookup("blocks", f"{_BLOCKS}, {_PLACES}", every))

    def _unfolded(self, rows, *more):
        names = ", ".join(map(_quoted, self.columns))
        return rows.selectExpr("term", *_AT, *more, (
            "inline(transform(places, (p, i) -> named_struct('at', entries[ats[i]], 'col', cols[i], 'place', p)))"
        )).selectExpr(
            f"block * {BLOCK} + at.seat AS doc", f"array({names})[col] AS column", "term",
            "cast(size(place) AS long) AS tf", "place AS positions", "at.dl AS dl", "segment", *more)

    def _terms(self, terms):
        if not any(not t.negated for t in terms):
            raise ValueError("a search needs a term that must match")
        for t in terms:
            Q._columns(t, self.columns)
        return [Q._stemmed(t) if self.stemmed else t for t in terms]

    def _candidates(self, terms):
        """Per block, for each term: the bits of the documents that have all
        its words (``t0``, ...; those that match, if the term is plain), the
        most occurrences and the least length (``f0``, ``d0``, ...)."""
        every = _slots(terms)
        per_slot = []
        for k, slot in enumerate(every):
            of = f"(CASE WHEN {_holds(slot)} THEN {{}} END)".format
            per_slot += [f"coalesce(bit_or{of('bits')}, 0L) AS b{k}", f"coalesce(sum{of('most')}, 0L) AS f{k}",
                         f"min{of('least')} AS d{k}"]
        rows = self._lookup("blocks", _BLOCKS, every).groupBy(*_AT).agg(*map(F.expr, per_slot))
        dead, alive = self._dead(), []
        if dead is not None:
            rows, alive = rows.join(dead, _AT, "left"), ["~coalesce(dead, 0L)"]
        out = []
        for i, t in enumerate(terms):
            at = [every.index(s) for s in I.slots(t)]
            fs, ds = ", ".join(f"f{k}" for k in at), ", ".join(f"d{k}" for k in at)
            out += [" & ".join([f"b{k}" for k in at] + alive) + f" AS t{i}",
                    (f"least({fs})" if len(at) > 1 else fs) + f" AS f{i}",
                    (f"greatest({ds})" if len(at) > 1 else ds) + f" AS d{i}"]
        return rows.selectExpr(*_AT, *out)

    def _score(self, numbers, matching, counts="_n{}", length="_dl"):
        """SQL of the BM25 score of the terms of these numbers."""
        return Q.bm25_sql([counts.format(i) for i in numbers], [length.format(i) for i in numbers],
                          matching, self.size, self.tokens)

    def _counted(self, terms, blocks=None):
        """Counts of plain terms in all documents, or in those of the given
        blocks (segment, block). The rows of a block meet in one partition."""
        rows = self._lookup("blocks", _BLOCKS, _slots(terms))
        if blocks is not None:
            rows = rows.filter(self._within(blocks))
        rows = (rows.select("term", *_AT, "entries").repartition(*_AT)
                .selectExpr("term", *_AT, "inline(entries)").groupBy(*_AT, "seat").agg(
                    F.expr("max(dl) AS _dl"), *[
                        F.expr(f"coalesce(sum(CASE WHEN {_holds(I.slots(t)[0])} THEN tf END), 0L) AS _n{i}")
                        for i, t in enumerate(terms)]))
        return self._alive(rows.selectExpr(
            "segment", f"block * {BLOCK} + seat AS doc", "_dl", *[f"_n{i}" for i in range(len(terms))]))

    def _placed(self, terms, rows):
        """Counts of any terms in the documents that have all words of one of
        them, by the bits of the rows."""
        bits = " | ".join(f"t{i}" for i in range(len(terms)))
        chosen = rows.selectExpr(*_AT, f"{bits} AS bits").filter("bits <> 0")
        inside = self._lookup("blocks", f"{_BLOCKS}, {_PLACES}", _slots(terms)).drop("bits").join(chosen, _AT)
        inside = self._unfolded(inside, "bits").filter(_has("bits"))
        return I.counts(inside, terms, ["segment", "doc"])

    def _within(self, named):
        """Test of a row being of one of the named blocks (segment, block), as
        ranges, which reach the scan."""
        blocks = {}
        for segment, block in named:
            blocks.setdefault(segment, []).append(block)
        return " OR ".join(
            f"segment = '{segment}' AND (" + " OR ".join(
                f"block BETWEEN {a} AND {z}" for a, z in _runs(numbers)) + ")"
            for segment, numbers in blocks.items())

    def _ranked(self, counted, terms, any_of, matching):
        """(segment, doc, relevance_score) of the matches."""
        score = self._score(_positive(terms), matching)
        return counted.filter(_matching(terms, any_of)).selectExpr(
            "segment", "doc", f"{score} AS relevance_score")

    def _search(self, terms, any_of, held=None):
        """(segment, doc, relevance_score) of all matches, and their number.
        Counts from positions are kept, and told in ``held``, for a caller that
        reads them again and lets go of them."""
        rows = self._candidates(terms)
        if all(I.is_plain(t) for t in terms):
            _, total, *matching = self._totals(rows, terms, any_of)
            return self._ranked(self._counted(terms), terms, any_of, matching), total
        found = self._placed(terms, rows)
        if held is not None:
            held.append(found.persist())
        total, *matching = found.selectExpr(f"count_if({_matching(terms, any_of)})", *[
            f"count_if(_n{i} > 0)" for i in _positive(terms)]).first()
        return self._ranked(found, terms, any_of, matching), total

    def _totals(self, rows, terms, any_of):
        """Blocks with a match, matches in all, and documents of each wanted
        term: plain terms are counted in bits."""
        matched = _matched(terms, any_of)
        return rows.selectExpr(f"count_if({matched} <> 0)", f"coalesce(sum(bit_count({matched})), 0L)", *[
            f"coalesce(sum(bit_count(t{i})), 0L)" for i in _positive(terms)]).first()

    def _located(self, found):
        return self._docs().join(found, ["segment", "doc"]).select(*LOCATION, "relevance_score")

    def _first(self, found, wanted, passing):
        """The best rows (location and score), ties at the end included, of
        those that pass; None if there are more than ``TIES`` of those."""
        best = [F.desc("relevance_score")]
        if passing is None:
            # At most the page and its ties.
            top = found.orderBy(*best).limit(wanted + TIES)
            top = self._docs().join(F.broadcast(top), ["segment", "doc"])
        else:
            top = passing.join(self._located(found), list(LOCATION)).orderBy(*best).limit(wanted + TIES)
        top = top.select(*LOCATION, "relevance_score").collect()
        top.sort(key=lambda r: -r[2])
        last = top[wanted - 1][2] if 0 < wanted <= len(top) else None
        if last is not None and len(top) == wanted + TIES and top[-1][2] == last:
            return None
        return [r for r in top if last is None or r[2] >= last]

    def matches(self, messages, terms, where=None, any_of=False):
        """All matching messages with ``relevance_score`` and
        ``total_results``."""
        found, total = self._search(self._terms(terms), any_of)
        rows = messages if where is None else messages.filter(where)
        out = self._located(found)
        count = F.lit(total) if where is None else rows.select(*LOCATION).join(
            out, list(LOCATION)).agg(F.count("*")).scalar()
        return rows.join(out, list(LOCATION)).select(
            *messages.columns, "relevance_score", F.coalesce(count, F.lit(0)).alias("total_results"))

    def page(self, messages, terms, where=None, any_of=False, limit=100, offset=0):
        """The best matches: at least the rows of the page, with their score
        and the number of all matches. Of a page that ends within ``DEEP``
        rows the driver learns that many; a deeper one is cut on the cluster."""
        wanted, top = limit + offset, None
        if wanted <= DEEP:
            searched = self._terms(terms)
            passing = None if where is None else messages.filter(where).select(*LOCATION)
            if all(I.is_plain(t) for t in terms):
                top, total = self._best(searched, any_of, wanted, passing)
            else:
                held = []
                try:
                    found, total = self._search(searched, any_of, held)
                    if passing is not None and total:
                        total = passing.join(self._located(found), list(LOCATION)).count()
                    top = self._first(found, wanted, passing) if total and wanted else []
                finally:
                    for rows in held:
                        rows.unpersist()
        if top is None:
            return self.matches(messages, terms, where, any_of)
        best = self.spark.createDataFrame([tuple(r) for r in top], _TOP)
        rows = messages.filter(F.col("archive_file").isin(sorted({r[0] for r in top})))
        return rows.join(F.broadcast(best), list(LOCATION)).selectExpr(
            *[f"`{c}`" for c in messages.columns], "relevance_score", f"{total}L AS total_results")

    def _best(self, terms, any_of, wanted, passing):
        """(rows, total) of plain terms: the ``wanted`` best matches and their
        ties at the end, and the number of all matches; None for the rows if
        there are too many ties. The blocks of the highest bounds are scored;
        then those, if any, whose bound reaches the last score found."""
        rows = self._candidates(terms)
        blocks, total, *matching = self._totals(rows, terms, any_of)
        matched = _matched(terms, any_of)
        if passing is not None and total:
            bits = rows.selectExpr(*_AT, f"{matched} AS bits").filter("bits <> 0")
            total = passing.join(
                self._docs().withColumn("block", _block()).join(bits, _AT).filter(_has("bits"))
                .select(*LOCATION), list(LOCATION)).count()
        if not total or not wanted:
            return [], total

        def scored(named=None):
            found = self._ranked(self._counted(terms, named), terms, any_of, matching)
            return self._first(found, wanted, passing)

        if blocks <= AT_ONCE:
            return scored(), total
        # Terms that a block lacks have no length there.
        bound = " + ".join(
            f"coalesce({self._score([i], [n], 'f{}', 'd{}')}, 0D)" for i, n in zip(_positive(terms), matching))
        bounded = rows.filter(f"{matched} <> 0").selectExpr(*_AT, f"({bound}) * {1 + ROUNDING!r}D AS bound")
        tried = bounded.orderBy(F.desc("bound")).limit(max(FIRST, -(-wanted // 8))).collect()
        top = scored([(r.segment, r.block) for r in tried])
        last = top[wanted - 1][2] if top and len(top) >= wanted else None
        if last is None:
            return scored(), total
        if tried[-1].bound < last:
            return top, total
        rest = bounded.filter(f"bound >= {last!r}D").select(*_AT).limit(DEEP + 1).collect()
        return scored([tuple(r) for r in rest] if len(rest) <= DEEP else None), total
