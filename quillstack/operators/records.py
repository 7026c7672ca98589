"""State as tables: upserts, drafts, reports, sessions; copies on write, never row updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import term_key


def upsert_latest(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """base with delta's rows in place of those of equal keys; the last in order wins among delta's own."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max(F.struct("_new", *order, *[c for c in rest if c not in ("_new", *order)])).alias("_w"))
    return last.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in base.columns if c not in keys])


def coalesce_update(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with each given value of new; nulls leave the old value."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(n, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def alive(sessions: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Sessions whose expiry, so many days after their start, is still to come."""
    return sessions.withColumn("expires_at", F.col("started") + F.expr(f"INTERVAL '{days}' DAY")).where(F.col("expires_at") > now)


def free_slug(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """base, slug: the base itself, or base-i with the smallest free i from 2.

    A taken slug is joined to the bases that it can stand for, itself and itself
    without its number, by equality.  The smallest gap is found by numbering the
    taken numbers of a base: the first that is above its place leaves one free.
    """
    number = F.regexp_extract("slug", "^(.*)-([1-9][0-9]{0,8})$", 2)
    own = taken.select(F.col("slug").alias("base"), F.lit(1).alias("i"))
    counted = taken.where(number != "").select(F.regexp_extract("slug", "^(.*)-([1-9][0-9]{0,8})$", 1).alias("base"), number.cast("int").alias("i")).where("i >= 2")
    used = wanted.select("base").distinct().join(own.unionByName(counted).distinct(), "base")
    run = Window.partitionBy("base").orderBy("i")
    full = used.where("i >= 2").withColumn("_n", F.row_number().over(run) + 1).where("i = _n").groupBy("base").agg(F.max("i").alias("_full"))
    held = used.where("i = 1").select("base", F.lit(True).alias("_held"))
    free = F.concat("base", F.lit("-"), (F.coalesce("_full", F.lit(1)) + 1).cast("string"))
    return wanted.join(held, "base", "left").join(full, "base", "left").select("base", F.when(F.col("_held"), free).otherwise(F.col("base")).alias("slug"))


def numbered_slugs(df: DataFrame, base: str, group: list, order: list) -> DataFrame:
    """df with slug: the nth row of a base gets -n from the second on."""
    n = F.row_number().over(Window.partitionBy(*group, base).orderBy(*order))
    return df.withColumn("slug", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))


def severity_histogram(diagnostics: DataFrame, group: list[str]) -> DataFrame:
    """Counts of the three severities, zero where there is none."""
    return diagnostics.groupBy(*group).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")])


def kept_diagnostics(diagnostics: DataFrame, code: str, most: int, order: list) -> DataFrame:
    """All diagnostics above info, and the first of one info code."""
    rest = diagnostics.where(F.col("severity") != "info")
    first = diagnostics.where((F.col("severity") == "info") & (F.col("code") == code)).orderBy(*order).limit(most)
    return rest.unionByName(first)


def top_reasons(items: DataFrame, reason: str, order: list, most: int = 10) -> DataFrame:
    """The first items of every reason, with the reason's number of items."""
    w = Window.partitionBy(reason)
    return items.withColumns({"n": F.count("*").over(w), "place": F.row_number().over(w.orderBy(*order))}).where(F.col("place") <= most)


def first_mode(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Each group's most frequent value; of equals the one seen first."""
    n = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return n.groupBy(*group).agg(F.min(F.struct(-F.col("_n"), "_first", value))[value].alias(value))


def not_stored(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files to upload: no stored object has the same key, size and md5."""
    return files.join(stored, ["key", "size", "md5"], "left_anti")


def first_wins(terms: DataFrame, key: str, expansion: str, order: str) -> DataFrame:
    """term rows with verdict: the first definition of a key is kept; later ones are duplicates or conflicts.

    Conflicts are the later rows whose expansion differs from the first one's
    without regard to case, white space and compatibility forms.
    """
    w = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(w)
    same = F.col("_same").eqNullSafe(F.first("_same").over(w))
    judged = terms.withColumn("_same", term_key(F.col(expansion)))
    return judged.withColumns({"verdict": F.when(n == 1, "kept").when(same, "duplicate").otherwise("conflict"), "kept_expansion": F.first(expansion).over(w)}).drop("_same")


def conflicts(terms: DataFrame, key: str, expansion: str, order: str) -> DataFrame:
    """key, kept, others: keys with conflicting definitions, the others joined in the order they were met, repeats too."""
    judged = first_wins(terms, key, expansion, order).where("verdict = 'conflict'")
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(expansion).alias("e"))))
    return judged.groupBy(key, F.col("kept_expansion").alias("kept")).agg(F.array_join(F.transform(listed, lambda x: x["e"]), "; ").alias("others"))
