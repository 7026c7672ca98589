"""Removal of long repeated byte strings by sparse suffix arrays.

A byte goes when a ``length``-byte string over it also starts anywhere else, in
the same document or another.

1. Anchors.  In each window of ``length`` bytes the gram of ``GRAM`` bytes with
   the smallest hash is the window's anchor; equal windows have equal anchors
   in equal places.  A document has an anchor for some 85 windows.
2. Anchors whose gram occurs once in the corpus are dropped; 30 bytes each are
   shuffled for that, after equal contexts near each other have become one.
3. The others take their context along: the bytes that their windows cover, some
   280.  Grams are dealt to buckets; in a bucket the contexts right of equal
   grams are sorted as suffixes, and the reversed ones left of them too, by
   deep-shallow sorting: multikey quicksort down to ``SHALLOW`` bytes beyond the
   gram, then blind tries for groups that are still equal there.  Common prefix
   lengths of neighbours give each suffix a class for every depth, and a window
   that reaches o bytes left of its anchor is repeated where another suffix has
   the same left class at o and the same right class at length - o.
4. Grams with more than ``HOT`` occurrences are not gathered: their windows are
   counted one by one by 128-bit hashes, partial sums first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textscan import RUN, U, mix, span_hash, text_chunks

GRAM = 32
SHALLOW = 16
BUCKET = 8192
#: Anchors (some 30 bytes each) and contexts (some 300) that a task gets at most on average, however large the table is.
ANCHORS, CONTEXTS = 1 << 20, 1 << 16
HOT = 1 << 16
WINDOW = 1 << 18
_POS = U((1 << 26) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values, by running minima inside blocks from both sides."""
    n = len(x)
    pad = np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """row, place in the row, gram hash, bytes left and right of the place that the anchor's windows reach."""
    out = []
    for base in range(0, max(1, len(data) - length + 1), RUN):
        d = data[base : base + RUN + length - 1]
        if len(d) < length:
            break
        at = np.arange(len(d) - GRAM + 1)
        grams = span_hash(d, at, at + GRAM)
        best = _sliding_min((grams & ~_POS) | at.astype(np.uint64), length - GRAM + 1)  # of windows at 0, 1, ...
        place = (best & _POS).astype(np.int64)
        start = np.arange(len(place)) + base
        row = np.searchsorted(offs, start, "right") - 1
        fits = start + length <= offs[row + 1]
        place, start, row = place[fits], start[fits], row[fits]
        if not len(place):
            continue
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
        last = np.append(first[1:], len(place)) - 1
        p = place[first] + base
        out.append((row[first], p - offs[row[first]], grams[place[first]], p - start[first], start[last] + length - p))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _merged(rid: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each rid with overlapping ones put together."""
    order = np.lexsort((first, rid))
    rid, first, end = rid[order], first[order], end[order]
    base = np.cumsum(np.append(0, rid[1:] != rid[:-1])) << 33
    reach = np.maximum.accumulate(end + base)
    new = np.append(True, first[1:] + base[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(rid)) - 1
    return rid[new], first[new], (reach - base)[last]


def _anchor_rows(length: int):
    """Anchors (kind 0), and spans (kind 1: place, and right for the length) that repeat within a window of them.

    Of anchors with equal contexts (by two 64-bit hashes and both lengths) among
    ``WINDOW`` in a row of a task one goes on and all are repeated bytes already:
    copies of a text, a passage or a period of a periodic one meet here before
    any shuffle.
    """

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        one, two, gram, rid, place, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((right, left, two, one))
        new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in (one, two, left, right)], axis=0))
        first, back = order[new], np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        times = np.bincount(back)
        zero = np.zeros(len(first), np.int32)
        cols = [zero, gram[first].view(np.int64), rid[first], place[first], left[first], right[first]]
        often = times[back] > 1
        if often.any():
            r, a, z = _merged(rid[often], (place - left)[often], (place + right)[often])
            more = [np.ones(len(r), np.int32), np.zeros(len(r), np.int64), r, a, np.zeros(len(r), np.int64), z - a]
            cols = [np.concatenate(x) for x in zip(cols, more, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int64, np.int64, np.int32, np.int32, np.int32), strict=True)], ["kind", "gram", "rid", "place", "left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(1)):
                row, place, gram, left, right = anchors(data, offs, length)
                if not len(row):
                    continue
                at = offs[row] + place
                rid = b.column(0).slice(lo, hi - lo).to_numpy()[row]
                held.append((span_hash(data, at - left, at + right), span_hash(data, at - left, at + right, 1), gram, rid, place, left, right))
                n += len(row)
                if n >= WINDOW:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by gram, those whose gram is not alone; one row is held over between batches."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.RecordBatch.from_arrays(b.columns, b.schema.names)
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            skip, carried = 1, held_twin
        else:
            skip, carried = 0, False
        g = b.column(0).to_numpy()
        same = g[1:] == g[:-1]
        twin = np.append(False, same) | np.append(same, False)
        twin[0] |= carried
        sent = twin.copy()
        sent[-1] = False  # the last row waits for the next batch
        held, held_twin = b.slice(b.num_rows - 1), bool(twin[-1])
        if sent.any():
            yield b.filter(pa.array(sent))
    if held is not None and held_twin:
        yield held


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column("text").cast(pa.binary())
        marks = b.column("marks")
        for i in range(b.num_rows):
            raw, rid = text[i].as_py(), b.column("rid")[i].as_py()
            m = marks[i].values
            place, left, right = (m.field(n).to_numpy() for n in ("place", "left", "right"))
            yield pa.RecordBatch.from_arrays(
                [m.field("gram"), pa.array(np.full(len(place), rid)), m.field("place"), pa.array([raw[p - a : p] for p, a in zip(place.tolist(), left.tolist(), strict=True)], pa.binary()), pa.array([raw[p : p + z] for p, z in zip(place.tolist(), right.tolist(), strict=True)], pa.binary())],
                ["gram", "rid", "place", "before", "after"],
            )


def _batched(batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(_contexts(batches))


class BlindTrie:
    """Orders distinct strings: inner nodes [depth, {byte: child}], leaves are numbers of strings."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: int | list | None = None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = i
            return
        node = self.root
        while not isinstance(node, int):  # blind: only branching bytes are looked at
            node = node[1].get(s[node[0] : node[0] + 1]) if s[node[0] : node[0] + 1] in node[1] else next(iter(node[1].values()))
        t = self.strings[node]
        common = _common(s, t)
        parent, node = None, self.root
        while not isinstance(node, int) and node[0] < common:
            parent, node = (node, s[node[0] : node[0] + 1]), node[1].get(s[node[0] : node[0] + 1])
        if not isinstance(node, int) and node is not None and node[0] == common:
            node[1][s[common : common + 1]] = i
            return
        fork = [common, {t[common : common + 1]: node, s[common : common + 1]: i}]
        if parent is None:
            self.root = fork
        else:
            parent[0][1][parent[1]] = fork

    def order(self) -> list[int]:
        out, work = [], [self.root]
        while work:
            node = work.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                work += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def _common(s: bytes, t: bytes) -> int:
    n = min(len(s), len(t))
    if s[:n] == t[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:  # s[:lo] == t[:lo], s[:hi] != t[:hi]
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if s[lo:mid] == t[lo:mid] else (lo, mid)
    return lo


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW, step: int = 4) -> list[int]:
    """The sorted order of distinct strings that agree in their first depth bytes."""
    out: list[int] = []
    limit = depth + shallow
    work = [(list(range(len(strings))), depth)]
    while work:
        group, at = work.pop()
        if len(group) < 2:
            out += group
            continue
        if at >= limit:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            out += trie.order()
            continue
        pivot = strings[group[len(group) // 2]][at : at + step]
        less, same, more = [], [], []
        for i in group:
            c = strings[i][at : at + step]
            (less if c < pivot else same if c == pivot else more).append(i)
        work += [(more, at), (same, at + step if len(pivot) == step else limit), (less, at)]
    return out


def _classes(strings: list[bytes], group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of all strings (by group first), and common prefixes with the one before (-1 at a group's first)."""
    cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    order = np.empty(len(group), np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = strings[lo:hi]
        index = {s: i for i, s in enumerate(dict.fromkeys(part))}
        rank = np.empty(len(index), np.int64)
        rank[deep_shallow(list(index), depth)] = np.arange(len(index))
        order[lo:hi] = lo + np.argsort(rank[[index[s] for s in part]], kind="stable")
    size = np.array([len(strings[i]) for i in order])
    table = np.zeros((len(order), size.max() + 1), np.uint8)
    flat = np.frombuffer(b"".join(strings[i] for i in order), np.uint8)
    row = np.repeat(np.arange(len(order)), size)
    table[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(1), differ.argmax(1), table.shape[1])
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    common[group[order][1:] != group[order][:-1]] = -1
    return order, np.append(-1, common)


def repeated_windows(gram: np.ndarray, before: list[bytes], after: list[bytes], length: int) -> np.ndarray:
    """For distinct (gram, before, after) sorted by gram: which windows, by bytes left of the anchor, occur in another row."""
    n = len(gram)
    flags = np.zeros((n, length - GRAM + 1), bool)
    if n < 2:
        return flags
    right_order, right = _classes(after, gram, GRAM)
    left_order, left = _classes([s[::-1] for s in before], gram, 0)
    left_size, right_size = np.array([len(s) for s in before]), np.array([len(s) for s in after])
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(length - GRAM + 1):
        fit = (left_size >= o) & (right_size >= length - o)
        if fit.sum() < 2:
            continue
        a[left_order] = np.cumsum(left < o)
        b[right_order] = np.cumsum(right < length - o)
        rows = np.flatnonzero(fit)
        key = a[rows] * (n + 1) + b[rows]
        sort = np.argsort(key)
        same = key[sort][1:] == key[sort][:-1]
        flags[rows[sort[np.append(False, same) | np.append(same, False)]], o] = True
    return flags


def _bucket_spans(length: int):
    """rid, first, end of the repeated bytes that each anchor's windows show."""

    def run(t: pa.Table) -> pa.Table:
        gram, rid, place = (t[c].to_numpy() for c in ("gram", "rid", "place"))
        kinds: dict[tuple, int] = {}
        kind = np.array([kinds.setdefault(k, len(kinds)) for k in zip(gram.tolist(), t["before"].to_pylist(), t["after"].to_pylist(), strict=True)])
        items = list(kinds)
        times = np.bincount(kind, minlength=len(items))
        grams = np.array([k[0] for k in items])
        others = np.unique(grams, return_inverse=True, return_counts=True)
        mates = np.flatnonzero(others[2][others[1]] > 1)
        mates = mates[np.argsort(grams[mates], kind="stable")]
        flags = np.zeros((len(items), length - GRAM + 1), bool)
        if mates.size:
            flags[mates] = repeated_windows(grams[mates], [items[i][1] for i in mates], [items[i][2] for i in mates], length)
        reach = np.arange(length - GRAM + 1)
        left, right = np.array([len(k[1]) for k in items]), np.array([len(k[2]) for k in items])
        flags |= (times > 1)[:, None] & (reach <= left[:, None]) & (length - reach <= right[:, None])
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        item, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        runs = np.searchsorted(item, np.arange(len(items) + 1))
        n = (runs[1:] - runs[:-1])[kind]
        row = np.repeat(np.arange(len(kind)), n)
        at = np.repeat(runs[kind] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return pa.table({"rid": rid[row], "first": (place[row] - high[at]).astype(np.int64), "end": (place[row] - low[at]).astype(np.int64) + length})

    return run


def _hot_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, after = b.column("before").to_pylist(), b.column("after").to_pylist()
            for i, (x, y) in enumerate(zip(before, after, strict=True)):
                d = np.frombuffer(x + y, np.uint8)
                at = np.arange(len(d) - length + 1)
                rid, place = b.column("rid")[i].as_py(), b.column("place")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(span_hash(d, at, at + length).view(np.int64)), pa.array(span_hash(d, at, at + length, 1).view(np.int64)), pa.array(np.full(len(at), rid)), pa.array(place - len(x) + at)],
                    ["w1", "w2", "rid", "first"],
                )

    return lambda batches: _batched(run(batches))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept")}
        spans = b.column("spans")
        for raw, s in zip(b.column("text").cast(pa.binary()).to_pylist(), spans, strict=True):
            removed = runs = 0
            kept = raw
            if s.is_valid and len(raw):
                v = s.values
                _, first, end = _merged(np.zeros(len(v), np.int64), v.field("first").to_numpy(), v.field("end").to_numpy())
                removed, runs = int((end - first).sum()), len(first)
                view = memoryview(raw)
                kept = b"".join(view[a:z] for a, z in zip([0, *end.tolist()], [*first.tolist(), len(raw)], strict=True))
            for c, x in zip(out, (len(raw), removed, runs, kept), strict=True):
                out[c].append(x)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], ["doc_id", *out])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row.

    Null texts are empty; texts under ``length`` bytes keep everything.  Repeated
    rows repeat each other's bytes, so both lose them.  Ties of equal strings
    don't matter: all their places lose them.  Strings are judged on the input.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows, _ = scratch.with_row_key(docs)
    rows = rows.withColumnRenamed("_rid", "rid")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.save(rows.select("rid", "text").mapInArrow(_anchor_rows(length), "kind int, gram long, rid long, place int, left int, right int"), "found")
    dealt = found.where("kind = 0").drop("kind").repartition(max(parts, -(-found.count() // ANCHORS)), "gram").sortWithinPartitions("gram")
    twins = scratch.save(dealt.mapInArrow(_repeated, dealt.schema), "anchors")
    marks = twins.groupBy("rid").agg(F.collect_list(F.struct("gram", "place", "left", "right")).alias("marks"))
    contexts = rows.select("rid", "text").join(marks, "rid").mapInArrow(_context_rows, "gram long, rid long, place int, before binary, after binary")
    crowd = twins.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    spans_schema = "rid long, first long, end long"
    any_hot = scratch.save(crowd.select("gram"), "hot-grams")
    few = any_hot.count()
    n = twins.count()
    buckets = max(64, -(-n // BUCKET))
    if few:
        contexts = scratch.save(contexts, "contexts")
        crowded = contexts.join(any_hot, "gram", "left_semi").mapInArrow(_hot_windows(length), "w1 long, w2 long, rid long, first long")
        often = crowded.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
        hot_spans = crowded.join(often, ["w1", "w2"], "left_semi").select("rid", "first", (F.col("first") + length).alias("end"))
        contexts = contexts.join(any_hot, "gram", "left_anti")
    bucketed = contexts.withColumn("_b", F.pmod(F.xxhash64("gram"), F.lit(buckets))).repartition(max(parts, -(-n // CONTEXTS)), "_b")
    spans = bucketed.groupBy("_b").applyInArrow(_bucket_spans(length), spans_schema)
    if few:
        spans = spans.unionByName(hot_spans)
    spans = scratch.save(spans, "spans")
    near = found.where("kind = 1").select("rid", F.col("place").cast("long").alias("first"), (F.col("place") + F.col("right")).cast("long").alias("end"))
    each = spans.unionByName(near).groupBy("rid").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    return rows.join(each, "rid", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
