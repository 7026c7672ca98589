"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

A slot of the mix is a point of a golden-ratio lattice on [0, 1): mapped through
the sources' cumulative target shares it names a source, so every stretch of
the mix has each source's share within a few slots.  Slots are ranked per
source by two-level counts (chunk of slots, then inside a chunk).  Each source's
documents, shuffled by a hash, form a stream that is cut into blocks of equal
word counts; slot r of a source takes its block r, and a second round begins
where the stream ends.  What the schedule's discrepancy leaves of a target is
taken by slots appended at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
CHUNK = 1 << 12
STRETCH = 1 << 7
#: Two neighbouring Fibonacci numbers: i * A mod M runs through the golden-ratio lattice.
M, A = 1836311903, 1134903170
FINE = 1 << 28


def document_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """row_id, doc_id, source, size (words; null text: 0), place (28-bit hash of the row's number that shuffles a source's rows)."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    size = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    place = F.conv(F.substring(F.md5(number.cast("string")), 1, 7), 16, 10).cast("long")
    return docs.select(number.alias("row_id"), F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), place.alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` times all words; a target stops at ``most`` times its source and
    the excess goes to the others by weight.  In closed form: with sources by
    rising size/weight, the first ones stop and the others share the rest.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = total.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1))
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    stopped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    rate = (F.sum("source_size").over(everything) * share - stopped) / F.sum("weight").over(after)
    rated = weighed.withColumn("_rate", rate).withColumn("_cap", F.col("source_size") * most)
    level = F.max(F.when(F.col("_rate") * F.col("weight") <= F.col("_cap"), F.col("_rate"))).over(everything)
    return rated.withColumn("_level", level).select(
        "source", "source_size", "weight", F.when(F.col("_level").isNull() | (F.col("_cap") < F.col("_level") * F.col("weight")), F.col("_cap").cast("double")).otherwise(F.col("_level") * F.col("weight")).alias("target")
    )


def _running(df: DataFrame, group: list, fine: Column, order: list, value: str, out: str) -> DataFrame:
    """out: the sum of value over the rows before, per group; in two levels, so that no task holds a whole group.

    Rows lie in cells of ``fine``, whose order must agree with ``order``.
    """
    celled = df.withColumn("_cell", fine)
    cells = celled.groupBy(*group, "_cell").agg(F.sum(value).alias("_sum"))
    rough = F.floor(F.col("_cell") / 1024)
    upper = cells.groupBy(*group, rough.alias("_rough")).agg(F.sum("_sum").alias("_upper"))
    upper = upper.withColumn("_base", F.coalesce(F.sum("_upper").over(Window.partitionBy(*group).orderBy("_rough").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_upper")
    cells = cells.withColumn("_rough", rough).join(upper, [*group, "_rough"])
    inner = Window.partitionBy(*group, "_rough").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*group, "_cell", (F.col("_base") + F.coalesce(F.sum("_sum").over(inner), F.lit(0))).alias("_before"))
    near = Window.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return celled.join(cells, [*group, "_cell"]).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(near), F.lit(0))).drop("_cell", "_before")


def _slots(targets: DataFrame, block: int) -> DataFrame:
    """slot, sid, rank: which of its source's blocks each slot takes; ranks run from 0 without gaps up to the source's last block of its target."""
    share = F.sum("need").over(Window.partitionBy())
    upto = F.sum("need").over(Window.orderBy("sid"))
    wide = targets.withColumn("_lo", ((upto - F.col("need")) / share * M)).withColumn("_hi", (upto / share * M))
    n = targets.agg(F.coalesce(F.sum(F.ceil(F.col("need") / block)), F.lit(0))).first()[0]
    points = targets.sparkSession.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(M)) * A, F.lit(M)).alias("u"))
    # A point's source by an equi-join on 1024 cells of [0, 1), with the bounds checked inside a cell.
    cells = wide.select("sid", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / M * 1024).cast("int"), F.least(F.floor(F.col("_hi") / M * 1024), F.lit(1023)).cast("int"))).alias("cell"))
    named = points.withColumn("cell", F.floor(F.col("u") * 1024 / M).cast("int")).join(cells, "cell").where((F.col("u") >= F.col("_lo")) & (F.col("u") < F.col("_hi"))).select("slot", "sid", F.lit(1).alias("one"))
    ranked = _running(named, ["sid"], F.floor(F.col("slot") / CHUNK), ["slot"], "one", "rank").select("slot", "sid", "rank")
    need = targets.select("sid", F.ceil(F.col("need") / block).alias("_n"))
    used = ranked.join(need, "sid").where("rank < _n").select("slot", "sid", "rank")
    have = used.groupBy("sid").agg(F.count("*").alias("_have"))
    short = need.join(have, "sid", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).where("_have < _n")
    tail = short.select(F.lit(n).alias("slot"), "sid", F.explode(F.sequence("_have", F.col("_n") - 1)).alias("rank"))
    return used.unionByName(tail)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int | None = None, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, targets, pieces).

    pieces: slot, epoch, row_id, first, words: which words of which row each
    slot takes, in the mix's order.  A source takes its target's whole words;
    a row is taken at most ``most`` times over.  Null keys and repeated rows are
    rows of their own; a null source is a source, the last one.  Rows without
    words are never taken.  ``block`` words go to a slot; by default
    what makes 2**18 slots, between 16 and 1024.
    """
    sizes = scratch.save(document_sizes(docs, key, text, source, row), "sizes")
    named = source_targets(sizes, weights, share, most)
    targets = scratch.save(named.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("need", F.floor(F.col("target")).cast("long")), "targets")
    if block is None:
        total = targets.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
        block = min(1024, max(16, total // (1 << 18)))
    live = targets.where("need > 0").select("sid", "source", "source_size", "need")
    words = sizes.where("size > 0")
    rows = words.agg(F.count("*")).first()[0]
    cells = max(1, rows // 256)
    placed = words.join(F.broadcast(live) if live.count() <= 10_000 else live, words["source"].eqNullSafe(live["source"])).select("row_id", "doc_id", "sid", "source_size", "need", "size", "place")
    placed = _running(placed, ["sid"], F.floor(F.col("place") * cells / FINE), ["place", F.col("doc_id").asc_nulls_last(), "row_id"], "size", "at")
    turns = placed.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(most)]))).withColumn("from", F.col("at") + F.col("epoch") * F.col("source_size"))
    turns = turns.where(F.col("from") < F.col("need")).withColumn("upto", F.least(F.col("from") + F.col("size"), F.col("need")))
    cut = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("upto") - 1) / block))))
    cut = cut.select("row_id", "epoch", "sid", "rank", F.greatest(F.col("from"), F.col("rank") * block).alias("lo"), F.least(F.col("upto"), (F.col("rank") + 1) * block).alias("hi"), "from")
    pieces = cut.join(_slots(live, block), ["sid", "rank"]).select("slot", "epoch", "row_id", (F.col("lo") - F.col("from")).alias("first"), (F.col("hi") - F.col("lo")).alias("words"))
    return sizes, targets, pieces


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **parameters) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted), first_slot, last_slot.

    The slots are the first and the last of the schedule that take words of the
    row (null where none does).  Null texts have size 0 and are never taken; a
    null source is a source; null and repeated ids are rows of their own, placed
    by their row number instead of their id.  An empty table gives no row; other
    columns are not read.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    rows, _ = scratch.with_row_key(docs)
    sizes, targets, pieces = mix(rows, row="_rid", **parameters)
    each = pieces.groupBy("row_id").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    named = targets.select(F.col("source").alias("_s"), "source_size", "target")
    joined = sizes.join(F.broadcast(named) if targets.count() <= 10_000 else named, F.col("source").eqNullSafe(F.col("_s"))).join(each, "row_id", "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", "last_slot")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **parameters) -> DataFrame:
    """docs in the mix: a row once for each round in which the mix takes its first word, columns as they were.

    Rows lie in the schedule's order: stretches of ``STRETCH`` slots are dealt to
    the partitions, by slot inside each.  Rows without words are not in the mix.  A null source is
    a source; repeated rows and null keys are rows of their own.  An empty table
    stays empty.
    """
    rid = scratch.fresh(docs, "_rid")
    rows, _ = scratch.with_row_key(docs, key, rid)
    _, _, pieces = mix(rows, key=key, text=text, source=source, row=rid, **parameters)
    slot, turn = scratch.fresh(docs, "_slot"), scratch.fresh(docs, "_turn")
    starts = pieces.where("first = 0").select(F.col("row_id").alias(rid), F.col("slot").alias(slot), F.col("epoch").alias(turn))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(starts, rid).repartition(parts, F.floor(F.col(slot) / STRETCH)).sortWithinPartitions(slot, turn, rid).select(*docs.columns)
