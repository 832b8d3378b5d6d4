"""Long windows that occur more than once, found over all documents without shuffling every window.

A *scan* cuts the windows of a text into spans: runs of consecutive windows that
share one anchor, a symbol that a window's own content determines. So equal
windows have equal anchors, wherever they stand, at equal distances. Then

1. anchors are counted, and those seen once drop out with all their windows;
2. spans that are equal as a whole are told apart by order alone: only the first
   of them stays open, the others are removed;
3. the open spans of one anchor meet, and each of their windows is compared.

The scan reads the texts once for each step, as texts are smaller than what they
are cut into. What one step hands to the next scan is a Bloom filter of fixed
size: it may let through more than needed, which costs work and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import texts as tx
from recollect.llm.filters import bloom, held_in, work_table
from recollect.llm.word_ids import concat_ranges
from recollect.session import ship

_U = np.uint64
#: Open spans of one anchor that one task compares; the windows of larger groups are dealt out one by one.
GROUP_SPANS = 4096


@dataclass
class Spans:
    """Spans of a slice of texts, in order of text and start."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    shift: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    windows: Callable[[int, int], bytes]
    hashes: Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Kind:
    """What is repeated: the scan of a slice, the hashes behind a list of ``windows`` payloads, the window's length,
    and whether an earlier start in the same document counts."""

    scan: Callable[[pa.RecordBatch], Spans]
    unpack: Callable[[list[bytes], np.ndarray], np.ndarray]
    length: int
    within: bool


def prepared(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc_id``, ``tag`` (tells rows apart that repeat an id), ``text``."""
    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.hash(F.col(text)).alias("tag"), F.col(text).alias("text"))


def _place(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key of a span's place, for a filter."""
    return tx.mix(tx.mix(doc.astype(_U) + tag.astype(_U) * _U(0x9E3779B97F4A7C15)) + start.astype(_U))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Document ids in their order (NULL first) and tags."""
    docs = batch.column("doc_id")
    return docs.fill_null(np.iinfo(np.int64).min).to_numpy(), batch.column("tag").to_numpy()


_SPAN = "doc_id bigint, tag int, start bigint, count int"


def _anchors(rows: DataFrame, kind: Kind) -> DataFrame:
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([_signed(kind.scan(batch).anchor)], ["anchor"])

    return rows.select("text").mapInArrow(names, "anchor bigint").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")


def _whole_spans(rows: DataFrame, kind: Kind, shared) -> DataFrame:
    """Every span of a shared anchor; ``gone`` where an equal span stands earlier in the same batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts = []
            for batch in tx.slices(whole, "text"):
                s = kind.scan(batch)
                keep = np.flatnonzero(held_in(shared.value, s.anchor))
                docs, tags = _ids(batch)
                at = s.text[keep]
                parts.append((s.anchor[keep], s.content[keep], docs[at], tags[at], s.start[keep], s.count[keep]))
            if not parts:
                continue
            anchor, content, doc, tag, start, count = (np.concatenate(x) for x in zip(*parts))
            # Copies that meet in one batch need not travel: an equal span that is later is removed here.
            second = start if kind.within else np.zeros_like(start)
            order = np.lexsort((second, doc, content, anchor))
            a, c, d, t = anchor[order], content[order], doc[order], second[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
            gone = np.zeros(len(order), bool)
            gone[order] = (d != d[first]) | (t != t[first])
            # Their key is spread, so that a group of copies isn't one task's.
            anchor = np.where(gone, tx.mix(anchor + start.astype(_U) + doc.astype(_U)), anchor)
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor), _signed(content), pa.array(doc), pa.array(tag, pa.int32()), pa.array(start, pa.int64()), pa.array(count, pa.int32()), pa.array(gone)],
                ["anchor", "content", "doc_id", "tag", "start", "count", "gone"],
            )

    return rows.mapInArrow(cut, f"anchor bigint, content bigint, {_SPAN}, gone boolean")


def _windows(rows: DataFrame, kind: Kind, open_spans, large) -> DataFrame:
    """The open spans with their windows; those of large groups window by window, dealt by the window's hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                s = kind.scan(batch)
                docs, tags = _ids(batch)
                keep = np.flatnonzero(held_in(open_spans.value, _place(docs[s.text], tags[s.text], s.start)))
                big = held_in(large.value, s.anchor[keep])
                one, many = keep[~big], keep[big]
                yield _span_rows(docs, tags, s, one, s.start[one], s.count[one], s.shift[one], np.zeros(len(one), _U), [s.windows(i, i + 1) for i in one.tolist()])
                if len(many):
                    n = s.count[many]
                    span = np.repeat(many, n)
                    step = concat_ranges(np.zeros_like(n), n)
                    hashes = s.hashes(many)
                    yield _span_rows(docs, tags, s, span, s.start[span] + step, np.ones(len(span), np.int64), s.shift[span] - step, hashes, [None] * len(span))

    return rows.mapInArrow(cut, f"anchor bigint, part bigint, shift int, {_SPAN}, windows binary")


def _span_rows(docs, tags, s: Spans, span, start, count, shift, part, windows) -> pa.RecordBatch:
    at = s.text[span]
    return pa.RecordBatch.from_arrays(
        [
            _signed(s.anchor[span]), _signed(part), pa.array(shift, pa.int32()), pa.array(docs[at]), pa.array(tags[at], pa.int32()),
            pa.array(start, pa.int64()), pa.array(count, pa.int32()), pa.array(windows, pa.binary()),
        ],
        ["anchor", "part", "shift", "doc_id", "tag", "start", "count", "windows"],
    )


def _compare(kind: Kind) -> Callable:
    """Over rows sorted by anchor, part and place: the runs of windows that an earlier row has too."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        anchor, part, shift, doc, tag, start, count = map(get, ("anchor", "part", "shift", "doc_id", "tag", "start", "count"))
        count = count.astype(np.int64)
        row = np.repeat(np.arange(len(anchor)), count)
        step = concat_ranges(np.zeros_like(count), count)
        payloads = table.column("windows").to_pylist()
        packed = np.array([p is not None for p in payloads], bool)
        hashes = part.view(_U)[row].copy()
        if packed.any():
            hashes[packed[row]] = kind.unpack([p for p in payloads if p is not None], count[packed])
        place = shift[row] - step
        order = np.lexsort(((start + shift)[row], doc[row], hashes, place, anchor[row]))
        r, h, p = row[order], hashes[order], place[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[r[1:]] != anchor[r[:-1]]) | (p[1:] != p[:-1]) | (h[1:] != h[:-1])
        first = r[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else r
        later = doc[first] < doc[r]
        if kind.within:
            later |= (doc[first] == doc[r]) & (start[first] + shift[first] < start[r] + shift[r])
        gone = np.zeros(len(order) + 1, bool)
        gone[order] = later
        # Runs inside a row: a border after each row's last window.
        edge = np.concatenate((row, [-1]))
        same = np.zeros(len(gone), bool)
        same[1:] = edge[1:] == edge[:-1]
        begin = np.flatnonzero(gone & ~(same & np.concatenate(([False], gone[:-1]))))
        end = np.flatnonzero(gone[:-1] & ~(same[1:] & gone[1:])) + 1
        at = row[begin] if len(begin) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(tag[at], pa.int32()), pa.array(start[at] + step[begin] if len(begin) else at, pa.int64()), pa.array(end - begin, pa.int32())],
            ["doc_id", "tag", "start", "count"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # A group may go on in the next batch: all rows but the last group's are ready. A group has
            # GROUP_SPANS rows, or rows of one window each; of the latter its first row is enough.
            key = np.stack([batch.column(c).to_numpy() for c in ("anchor", "part")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if held:
                last = np.array([held[-1].column(c)[-1].as_py() for c in ("anchor", "part")])
                if (key[:, 0] != last).any():
                    yield flush(held)
                    held = []
            if held and len(cut) == 0 and batch.column("windows").null_count == batch.num_rows:
                yield flush([held[0].slice(0, 1), batch])
                continue
            cut = int(cut[-1]) if len(cut) else 0
            if cut:
                yield flush([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(held)

    return run


def removed_windows(rows: DataFrame, kind: Kind) -> DataFrame:
    """``doc_id, tag, start, count``: runs of window starts that also start earlier; runs may overlap.

    ``rows`` is from ``prepared``. A NULL id comes before all others.
    """
    spark = ship(rows.sparkSession)
    shared = spark.sparkContext.broadcast(bloom(_anchors(rows, kind)))
    dealt = _whole_spans(rows, kind, shared).repartition("anchor")
    order = [F.col("doc_id"), F.col("start") if kind.within else F.lit(0)]
    equal = Window.partitionBy("anchor", "content").orderBy(*order)
    rank = F.rank().over(equal)
    ranked = dealt.withColumn("gone", F.col("gone") | (rank > 1))
    spans = ranked.withColumn("open", F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(Window.partitionBy("anchor")))
    # Alone means decided: gone, or kept as nothing else has the anchor.
    spans = spans.where("gone or open > 1").withColumn("large", F.when((F.col("open") > GROUP_SPANS) & ~F.col("gone"), F.col("anchor")))
    kept = work_table(spans.select("doc_id", "tag", "start", "count", "gone", "large"), "whole-spans")
    place = kept.where("not gone").select("doc_id", "tag", "start").mapInArrow(_places, "place bigint")
    large = kept.select("large").where("large is not null").distinct()
    open_spans, large = (spark.sparkContext.broadcast(bloom(x)) for x in (place, large))
    met = _windows(rows, kind, open_spans, large).repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc_id", "start")
    return kept.where("gone").select("doc_id", "tag", "start", "count").unionByName(met.mapInArrow(_compare(kind), _SPAN))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, tag, start = (batch.column(c).to_numpy() for c in ("doc_id", "tag", "start"))
        yield pa.RecordBatch.from_arrays([_signed(_place(doc, tag, start))], ["place"])


def with_runs(docs: DataFrame, doc: str, text: str, removed: DataFrame, length: int) -> DataFrame:
    """``docs`` with ``starts`` and ``ends``: the units that the removed windows cover, in sorted disjoint runs."""
    merged = removed.groupBy(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    runs = merged.mapInArrow(_merge(length), "_doc bigint, _tag int, starts array<bigint>, ends array<bigint>")
    known = F.coalesce(F.col(doc).cast("bigint"), F.lit(np.iinfo(np.int64).min))
    joined = docs.join(runs, (known == F.col("_doc")) & (F.hash(F.col(text)) == F.col("_tag")), "left")
    none = F.array().cast("array<bigint>")
    return joined.select(*docs.columns, *[F.coalesce(c, none).alias(c) for c in ("starts", "ends")])


def _merge(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            column = batch.column("runs")
            offsets = column.offsets.to_numpy()
            flat = column.values
            s, n = flat.field("start").to_numpy(), flat.field("count").to_numpy()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                begin = s[a:b]
                order = np.argsort(begin)
                begin, end = begin[order], (begin + n[a:b] + (length - 1))[order]
                reach = np.maximum.accumulate(end)
                new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
                starts.append(begin[new])
                ends.append(np.append(reach[new[1:] - 1], reach[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), batch.column("_tag"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["_doc", "_tag", "starts", "ends"]
            )

    return run
