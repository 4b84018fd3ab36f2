"""Exact removal of repeated windows, over bytes (suffix sort) or words (FM-index).

A window of ``width`` units is removed where an equal one starts earlier: in a smaller doc_id, or before it in the same
document.  No unit is left out; the plan keeps one row per anchor run (see passages.py):

1. scan      each block of texts gives its runs; a run whose content the block, or lately the task, already holds is
             settled on the spot, so a group of copies sends few rows per task, whatever its size;
2. settle    runs with one anchor meet in one task, sorted by Spark's spilling sort; later runs of equal content are
             repeats; an anchor with one content needs nothing more.  Anchors that are frequent in a sample of the texts
             are dealt by content too, so that they spread; results don't depend on the sample;
3. compare   the first run of each content of an anchor with several contents is fetched from its text and compared,
             window by window, with the others: operator 9 range-partitions them by leading bytes at sampled splitters
             and sorts by multikey quicksort, operator 8 searches an FM-index per shard;
4. cut       the settled spans of a document are merged and removed.

An anchor with more than HOT contents (the edge of a passage that very many documents share) is not gathered in one
place: its windows travel one by one under their own hash, again after each batch has settled its own.

Contents count as equal where the 64-bit hash of the anchor and the XXH64 of the bytes both agree, single windows where
128 bits (XXH3) of their bytes do; what the suffix sort and the FM-index compare is bytes and words themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscore.llm import passages as P
from ragscore.llm.common import forget, order_id, tidy, written

#: Contents of an anchor beyond which its windows are dealt out singly. Results don't depend on it.
HOT = 256
#: Windows that are compared at once.
SLICE = 150_000
#: Texts and bytes of them that are cut at once.
ROWS, BYTES = 256, 1 << 26
#: Bytes of fetched runs that a worker holds before it sends them on.
FETCHED = 1 << 22
#: Tasks that the contents of a frequent anchor are dealt to, and contents that a scanning task remembers.
SALTS, LATELY = 64, 1 << 16
#: Texts, about, in which anchors are counted to find frequent ones, and how many of those at most are dealt by content.
SAMPLE, FREQUENT = 4096, 16_384
_SCAN = "key long, content long, doc long, loc long, extra int"
_FOUND = "key long, doc long, loc long, extra int, stop int"
_FETCHED = "lead long, key long, doc long, loc long, extra int, stop int, content binary"
_SPANS = "doc long, loc long, stop int"
#: A run's number of windows and its anchor's place share an integer.
_COUNT_BITS = 12
_COUNT = (1 << _COUNT_BITS) - 1
#: Set in that integer where an anchor has many contents.
_MANY = 1 << 30


def _arrow(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    arrays = [c if isinstance(c := columns[n], pa.Array) else pa.array(np.asarray(c).astype(kinds[k].to_pandas_dtype()) if k != "binary" else c, kinds[k]) for n, k in names]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in names])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _merge(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, touching ones joined."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[new], reach[np.r_[new[1:] - 1, len(start) - 1]]


def _joined(doc: np.ndarray, loc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, loc, stop) of the spans that windows at loc cover together."""
    order = np.lexsort((loc, doc))
    doc, loc = doc[order], loc[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (loc[1:] > loc[:-1] + width)])
    last = np.r_[first[1:] - 1, len(doc) - 1]
    return doc[first], loc[first], (loc[last] & 0xFFFFFFFF) + width


class Lately:
    """Contents that a task has sent lately with their first places; those seen again stay longest."""

    def __init__(self):
        self.key, self.content = np.zeros((2, LATELY), np.uint64)
        self.doc, self.loc, self.use = np.zeros((3, LATELY), np.int64)

    def knows(self, key: np.ndarray, content: np.ndarray, doc: np.ndarray, loc: np.ndarray) -> np.ndarray:
        """Which of these distinct contents were sent with an earlier place; the others are noted."""
        at = (content % np.uint64(LATELY)).astype(np.int64)
        hit = (self.use[at] > 0) & (self.key[at] == key) & (self.content[at] == content)
        known = hit & ((self.doc[at] < doc) | ((self.doc[at] == doc) & (self.loc[at] < loc)))
        self.use[at[~hit]] -= 1
        self.use[at[hit]] = 8
        note = np.flatnonzero(~known & (hit | (self.use[at] <= 0)))
        to = at[note]
        self.key[to], self.content[to], self.doc[to], self.loc[to] = key[note], content[note], doc[note], loc[note]
        self.use[to] = np.maximum(self.use[to], 1)
        return known


def _scan(width: int, gram: int, unit: str, frequent: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lately = Lately()
        for batch in batches:
            texts = _texts(batch)
            docs, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy().astype(np.int64)
            pa.default_memory_pool().release_unused()
            for held, units in P.blocks(texts, width, unit):
                prefix = P.Prefix(units.values)
                runs = P.scan(units, prefix, width, gram)
                if not len(runs.start):
                    continue
                held = np.array(held)
                doc, tag = docs[held[runs.item]], tags[held[runs.item]]
                within = runs.start - units.base[runs.item] + units.skip[runs.item]
                loc = (tag << 32) | within
                order = np.lexsort((loc, doc, runs.content_hash, runs.anchor_hash))
                k, c, d, x = runs.anchor_hash[order], runs.content_hash[order], doc[order], loc[order]
                new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = (d != d[lead]) | (x != x[lead])
                first = np.flatnonzero(~later)
                later[first] = lately.knows(k[first], c[first], d[first], x[first])
                keep, drop = order[~later], order[later]
                extra = runs.count[keep] | (runs.anchor[keep] << _COUNT_BITS) | np.where(np.isin(runs.anchor_hash[keep], frequent), _MANY, 0)
                yield _arrow(_SCAN, key=_signed(runs.anchor_hash[keep]), content=_signed(runs.content_hash[keep]), doc=doc[keep], loc=loc[keep], extra=extra)
                if len(drop):
                    s, e = _merge(runs.start[drop], runs.start[drop] + runs.count[drop] + width - 1)
                    # spans of neighbouring texts may touch: cut them at text starts
                    s, e = _cut(s, e, units)
                    it = units.item[s]
                    shift = units.skip[it] - units.base[it]
                    yield _arrow(_SCAN, key=_signed(P.mix((s + docs[held[it]]).astype(np.uint64))), content=e + shift, doc=docs[held[it]], loc=(tags[held[it]] << 32) | (s + shift), extra=np.full(len(s), -1))

    return run


def _cut(start: np.ndarray, stop: np.ndarray, units: P.Units) -> tuple[np.ndarray, np.ndarray]:
    first, last = units.item[start], units.item[stop - 1]
    if (first == last).all():
        return start, stop
    s, e = [], []
    for a, b, i, j in zip(start, stop, first, last, strict=True):
        edges = [a, *units.base[i + 1 : j + 1], b]
        for x, y in zip(edges, edges[1:], strict=False):
            if y > x:
                s.append(x)
                e.append(y)
    return np.array(s), np.array(e)


def _settle(width: int) -> Callable:
    """Reads rows sorted by (key, content, doc, loc): the firsts of a key's contents are asked for, if several; later rows are spans."""
    most = HOT

    def asked(cols: dict, rows: np.ndarray, many: bool | np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            yield _arrow(_FOUND, key=cols["key"][rows], doc=cols["doc"][rows], loc=cols["loc"][rows], extra=cols["extra"][rows] | np.where(many, _MANY, 0), stop=np.full(len(rows), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the firsts of the last key's contents; only the last of them once they are sent
        sent = False
        for batch in batches:
            cols = {n: batch.column(n).to_numpy() for n in ("key", "content", "doc", "loc", "extra")}
            span = cols["extra"] < 0
            if span.any():
                n = int(span.sum())
                yield _arrow(_FOUND, key=np.zeros(n), doc=cols["doc"][span], loc=cols["loc"][span], extra=np.full(n, -1), stop=cols["content"][span])
                cols = {k: v[~span] for k, v in cols.items()}
            if not len(cols["key"]):
                continue
            if held is not None:
                cols = {k: np.r_[held[k], v] for k, v in cols.items()}
            k, c, d, x, extra = cols.values()
            new_key = np.r_[True, k[1:] != k[:-1]]
            new = new_key | np.r_[True, c[1:] != c[:-1]]
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (d != d[lead]) | (x != x[lead])
            group = np.cumsum(new_key) - 1
            contents = np.bincount(group, weights=new).astype(np.int64)
            many = (contents > most) | (extra[np.flatnonzero(new_key)] & _MANY > 0)
            if sent:
                many[0], new[0] = True, False
            last = group == group[-1]
            over = bool(many[-1])
            ask = np.flatnonzero(new & ((contents > 1) | many)[group] & (~last | over))
            yield from asked(cols, ask, many[group[ask]])
            rows = np.flatnonzero(later)
            if len(rows):
                doc, loc, stop = _spans_of(d[rows], x[rows], (x[rows] & 0xFFFFFFFF) + (extra[rows] & _COUNT) + width - 1)
                yield _arrow(_FOUND, key=np.zeros(len(doc)), doc=doc, loc=loc, extra=np.full(len(doc), -1), stop=stop)
            at = lead[-1:] if over else np.flatnonzero(new & last)
            held, sent = {n: v[at] for n, v in cols.items()}, over
        if held is not None and not sent and len(held["key"]) > 1:
            yield from asked(held, np.arange(len(held["key"])), False)

    return run


def _spans_of(doc: np.ndarray, loc: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, loc, stop), those that meet in one text joined."""
    order = np.lexsort((loc, doc))
    doc, loc, stop = doc[order], loc[order], stop[order]
    text = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (loc[1:] >> 32 != loc[:-1] >> 32)])
    reach = np.maximum.accumulate((text << 33) + stop)
    new = np.flatnonzero(np.r_[True, (text << 33)[1:] + (loc[1:] & 0xFFFFFFFF) > reach[:-1]])
    last = np.r_[new[1:] - 1, len(doc) - 1]
    return doc[new], loc[new], reach[last] - (text[last] << 33)


def _fetch(width: int, unit: str) -> Callable:
    """The bytes of the asked runs; windows of hot anchors singly, without bytes, repeats inside a group of texts settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy().astype(np.int64)
            out: dict[str, list] = {n: [] for n in ("lead", "key", "doc", "loc", "extra", "content")}
            singles: list[tuple] = []
            hashed, size = bytearray(), 0
            for i in range(batch.num_rows):
                text, asked = batch.column("text")[i].as_buffer().to_pybytes(), batch.column("asked")[i].values
                units = text if unit == "byte" else text.split()
                piece = (lambda a, b, u=units: u[a:b]) if unit == "byte" else (lambda a, b, u=units: b" ".join(u[a:b]))
                for start, extra, key in zip(*(asked.field(n).to_numpy().tolist() for n in ("start", "extra", "key")), strict=True):
                    count, anchor = extra & _COUNT, (extra & ~_MANY) >> _COUNT_BITS
                    place = (int(tags[i]) << 32) | start
                    if extra & _MANY:
                        for s in range(start, start + count):
                            hashed += xxhash.xxh3_128_digest(piece(s, s + width))
                        singles.append((docs[i], place, count))
                        continue
                    content = piece(start, start + count + width - 1)
                    for n, v in (("key", key), ("doc", docs[i]), ("loc", place), ("extra", count), ("content", content)):
                        out[n].append(v)
                    out["lead"].append(int.from_bytes(content[anchor : anchor + 8], "big") - (1 << 63) if unit == "byte" else 0)
                    size += len(content)
                if size > FETCHED or len(hashed) > FETCHED or i + 1 == batch.num_rows:
                    if out["key"]:
                        yield _arrow(_FETCHED, **out, stop=np.full(len(out["key"]), -1))
                    if singles:
                        yield from _windows_once(hashed, singles, width)
                    out, singles, hashed, size = {n: [] for n in out}, [], bytearray(), 0

    return run


def _windows_once(hashed: bytearray, singles: list[tuple], width: int) -> Iterator[pa.RecordBatch]:
    """The first of equal windows; the others as spans."""
    key, lead = np.frombuffer(bytes(hashed), np.int64).reshape(-1, 2).T
    doc, loc, count = (np.array(v, np.int64) for v in zip(*singles, strict=True))
    loc = np.repeat(loc, count) + np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
    doc = np.repeat(doc, count)
    order = np.lexsort((loc, doc, lead, key))
    key, doc, loc, lead = key[order], doc[order], loc[order], lead[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (lead[1:] != lead[:-1])]
    at = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[at]) | (loc != loc[at])
    rows = ~later
    m = int(rows.sum())
    yield _arrow(_FETCHED, lead=lead[rows], key=key[rows], doc=doc[rows], loc=loc[rows], extra=np.zeros(m), stop=(loc[rows] & 0xFFFFFFFF) + width, content=pa.nulls(m, pa.binary()))
    if later.any():
        doc, loc, stop = _joined(doc[later], loc[later], width)
        m = len(doc)
        yield _arrow(_FETCHED, lead=P.mix(doc.astype(np.uint64)).view(np.int64), key=loc, doc=doc, loc=loc, extra=np.full(m, -1), stop=stop, content=pa.nulls(m, pa.binary()))


def _compare(width: int, equal: Callable) -> Callable:
    """Reads rows sorted by (lead, key, doc, loc). equal: marks the windows of whole groups that start earlier too."""

    def runs(cols: dict, whole: bool) -> Iterator[pa.RecordBatch]:
        n = len(cols["key"])
        if not n:
            return
        group = np.cumsum(np.r_[True, (cols["key"][1:] != cols["key"][:-1]) | (cols["lead"][1:] != cols["lead"][:-1])]) - 1
        size = np.cumsum(cols["extra"].astype(np.int64))
        start = 0
        ends = np.r_[np.flatnonzero(group[1:] != group[:-1]) + 1, n]
        while start < n:
            base = size[start - 1] if start else 0
            fit = ends[(ends > start) & (size[ends - 1] - base <= SLICE)]
            stop = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, start, "right")])
            part = {k: v[start:stop] for k, v in cols.items()}
            row, j = equal(part, group[start:stop])
            if len(row):
                doc, loc, stop_at = _joined(part["doc"][row], part["loc"][row] + j, width)
                yield _arrow(_SPANS, doc=doc, loc=loc, stop=stop_at)
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        single = None
        for batch in batches:
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("lead", "key", "doc", "loc", "extra", "stop", "content")}
            done = cols["extra"] < 0
            if done.any():
                yield _arrow(_SPANS, doc=cols["doc"][done], loc=cols["loc"][done], stop=cols["stop"][done])
            one = cols["extra"] == 0
            if one.any():
                s = {n: cols[n][one] for n in ("lead", "key", "doc", "loc", "stop")}
                if single is not None:
                    s = {n: np.r_[single[n], v] for n, v in s.items()}
                new = np.r_[True, (s["key"][1:] != s["key"][:-1]) | (s["lead"][1:] != s["lead"][:-1])]
                at = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = (s["doc"] != s["doc"][at]) | (s["loc"] != s["loc"][at])
                if later.any():
                    yield _arrow(_SPANS, doc=s["doc"][later], loc=s["loc"][later], stop=s["stop"][later])
                single = {n: v[at[-1] : at[-1] + 1] for n, v in s.items()}
            more = cols["extra"] > 0
            if not more.any():
                continue
            cols = {k: v[more] for k, v in cols.items()}
            if held is not None:
                cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
            n = len(cols["key"])
            open_from = n - 1
            same = (cols["key"] == cols["key"][-1]) & (cols["lead"] == cols["lead"][-1])
            open_from = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            yield from runs({k: v[:open_from] for k, v in cols.items()}, False)
            held = {k: v[open_from:] for k, v in cols.items()}
        if held is not None:
            yield from runs(held, True)

    return run


def _windows(part: dict) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of every window."""
    count = part["extra"].astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def equal_by_suffix_sort(width: int) -> Callable:
    from ragscore.llm.multikey import equal_classes

    def equal(part: dict, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, j = _windows(part)
        sizes = np.array([len(x) for x in part["content"]], np.int64)
        text = np.frombuffer(b"".join(part["content"]), np.uint8)
        at = (np.cumsum(sizes) - sizes)[row] + j
        live, cls = equal_classes(text, at, width, group[row])
        if not len(live):
            return live, live
        doc, loc = part["doc"][row[live]], part["loc"][row[live]] + j[live]
        order = np.lexsort((loc, doc, cls))
        cls, doc, loc, live = cls[order], doc[order], loc[order], live[order]
        new = np.r_[True, cls[1:] != cls[:-1]]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[lead]) | (loc != loc[lead])
        return row[live[later]], j[live[later]]

    return equal


def equal_by_fm_index(width: int) -> Callable:
    from ragscore.llm.fm_index import FMIndex

    def equal(part: dict, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((part["loc"], part["doc"]))  # then an earlier place in the text is an earlier window
        pieces = [part["content"][i].split(b" ") for i in order]
        sizes = np.array([len(p) for p in pieces], np.int64)
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for p in pieces for w in p], np.int64)
        first = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.ones(int((sizes + 1).sum()), np.int64)  # 1 parts the documents
        text[np.repeat(first, sizes) + np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = ids + 2
        index = FMIndex(text, len(known) + 2)
        row, j = _windows({"extra": part["extra"][order]})
        at = first[row] + j
        low, high = index.search(text[at[:, None] + np.arange(width)])
        before = index.earliest(low, high)
        other = order[np.searchsorted(first, before, "right") - 1]
        mine = order[row]
        tie = (part["doc"][other] == part["doc"][mine]) & (part["loc"][other] + before - first[np.searchsorted(first, before, "right") - 1] == part["loc"][mine] + j)
        later = (before < at) & ~tie
        return mine[later], j[later]

    return equal


def spans(documents: DataFrame, id_col: str, text_col: str, width: int, gram: int, unit: str) -> DataFrame:
    """(doc, tag, spans): for each text with removed units the spans [start, stop), in units, in any order.

    doc is the id as a long (null ids before all others), tag a hash of the text: rows that repeat an id and its text
    count as one document and share their spans; other texts under one id are documents of their own, ordered by tag.
    """
    spark = documents.sparkSession
    texts = keyed(documents, id_col, text_col).select("doc", "tag", "text")
    runs = texts.mapInArrow(_scan(width, gram, unit, _frequent(texts, width, gram, unit)), _SCAN)
    salt = F.when((F.col("extra") >= 0) & (F.col("extra").bitwiseAND(_MANY) > 0), F.pmod("content", F.lit(SALTS))).otherwise(0)
    found = written(runs.repartition("key", salt).sortWithinPartitions("key", "content", "doc", "loc").mapInArrow(_settle(width), _FOUND), "found")
    del runs
    tidy(spark)
    tag, start = F.shiftright("loc", 32).cast("int").alias("tag"), F.col("loc").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start")
    asked = found.where("stop < 0").select("doc", tag, F.struct(start, "extra", "key").alias("run"))
    asked = asked.groupBy("doc", "tag").agg(F.collect_list("run").alias("asked"))
    fetched = texts.join(asked, ["doc", "tag"]).mapInArrow(_fetch(width, unit), _FETCHED)
    if unit == "byte":
        fetched = fetched.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "lead", "key")
        equal = equal_by_suffix_sort(width)
    else:
        fetched = fetched.repartition("key")
        equal = equal_by_fm_index(width)
    compared = fetched.sortWithinPartitions("lead", "key", "doc", "loc").mapInArrow(_compare(width, equal), _SPANS)
    every = found.where("stop >= 0").select("doc", "loc", "stop").unionByName(compared)
    every = written(every.groupBy("doc", tag).agg(F.collect_list(F.struct(start, "stop")).alias("spans")), "spans")
    forget(found)
    del fetched, compared, asked, found, texts  # with their shuffle files, before the texts are shuffled again
    tidy(spark)
    return every


def _frequent(texts: DataFrame, width: int, gram: int, unit: str) -> np.ndarray:
    """Anchors of many contents in a sample of the texts, those that may have over HOT in all; at most FREQUENT."""
    share = min(1.0, SAMPLE / max(1, texts.select("doc").count()))
    some = texts.where(F.xxhash64("doc", F.lit(5)) <= -(1 << 63) + min((1 << 64) - 1, int(share * (1 << 64))))
    runs = some.mapInArrow(_scan(width, gram, unit, np.zeros(0, np.uint64)), _SCAN).where("extra >= 0")
    counts = runs.select("key", "content").distinct().groupBy("key").count().where(F.col("count") > max(8, HOT * share))
    found = counts.orderBy(F.desc("count"), "key").limit(FREQUENT).select("key").toArrow()["key"].to_numpy()
    return np.sort(found).view(np.uint64)


def keyed(documents: DataFrame, id_col: str, text_col: str, carry: list[str] = ()) -> DataFrame:
    """(doc, tag, text, is_null, carried columns in a struct)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(
        order_id(id_col).alias("doc"),
        F.col(id_col).alias("_id"),
        F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tag"),
        text.alias("text"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(None).alias("_none")]).alias("_carry"),
    )


def _apply(unit: str) -> Callable:
    where = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            first = size = 0
            for i in range(batch.num_rows):
                text, cell = batch.column("text")[i].as_buffer().to_pybytes(), batch.column("spans")[i]
                units = text if unit == "byte" else text.split()
                n = len(units)
                s = e = np.zeros(0, np.int64)
                if cell.is_valid:
                    v = cell.values
                    s, e = _merge(v.field("start").to_numpy().astype(np.int64), v.field("stop").to_numpy().astype(np.int64))
                edges = zip([0, *e.tolist()], [*s.tolist(), n], strict=True)
                kept = b"".join(units[a:b] for a, b in edges) if unit == "byte" else b" ".join(w for a, b in edges for w in units[a:b])
                for o, x in zip(out, (n, int((e - s).sum()), len(s), [{"start": a, "stop": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)], kept), strict=True):
                    o.append(x)
                size += len(kept)
                if i + 1 - first == ROWS or size > BYTES or i + 1 == batch.num_rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), where, pa.binary())
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_carry"), *map(pa.array, out, kinds)], ["_id", "_carry", *OWN])
                    out, first, size = [[], [], [], [], []], i + 1, 0

    return run


OWN = ("n_units", "n_removed", "n_spans", "removed", "kept")


def without_repeats(documents: DataFrame, id_col: str, text_col: str, width: int, gram: int, unit: str, carry: list[str] = ()) -> DataFrame:
    """One row per input row: the id, n_units, n_removed, n_spans, removed (spans) and kept (bytes), then carried columns."""
    found = spans(documents, id_col, text_col, width, gram, unit)
    rows = keyed(documents, id_col, text_col, carry).join(found, ["doc", "tag"], "left").select("_id", "text", "_carry", "spans")
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "stop")])
    own = zip(OWN, (T.LongType(), T.LongType(), T.LongType(), T.ArrayType(span), T.BinaryType()), strict=True)
    out = rows.mapInArrow(_apply(unit), T.StructType([rows.schema["_id"], rows.schema["_carry"], *[T.StructField(n, t) for n, t in own]]))
    return out.select(F.col("_id").alias(id_col), *OWN, *[F.col("_carry").getField(c).alias(c) for c in carry if c not in (*OWN, id_col)])
