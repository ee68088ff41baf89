"""Closed frequent itemsets of baskets, breadth first, and the rules that they give.

A closed itemset is one whose proper supersets all lie in fewer baskets. Each is reached just once: an itemset P, made by
adding the item e last, is extended by every item i > e that enough of its baskets hold; what all of the baskets of P and i
hold is absorbed, and the result is kept if that brought no item below i that P has not (a prefix-preserving extension).

A level of this search is a few joins and aggregations over tables: candidates, and their occurrences (candidate, basket).
Each level is written, so that a lost executor costs one level at most and lineage stays short.

Very large baskets, fewer than half of the least support, are set apart: they would bring a row for every two of their items.
What the other baskets count for an item, plus the number of a candidate's large baskets, bounds its support; only
items that may still reach the least support are looked up in the large baskets. The counts are exact either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import drop_written, passing, written

#: Least support: so many baskets, and one in so many of all.
LEAST, ONE_IN = 5, 20_000
#: Least confidence of a rule, in percent.
CONFIDENCE = 60


def _baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(b, i): the distinct items of each basket, without nulls."""
    return rows.select(F.col(f"`{basket}`").alias("b"), F.col(f"`{item}`").cast("long").alias("i")).where("b is not null and i is not null").distinct()


def _large(pairs: DataFrame, most: int) -> int:
    """The least power of two that at most `most` baskets of (b, i) reach in size. The driver gets a row for each power."""
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    counts = pairs.groupBy("b").agg(F.count("*").alias("n")).groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()
    top, held = max((r.p for r in counts), default=0) + 1, 0
    sizes = {r.p: r.n for r in counts}
    while top > 0 and held + sizes.get(top - 1, 0) <= most:
        top -= 1
        held += sizes.get(top, 0)
    return 2**top


class _Mine:
    """What all levels share: baskets but the large ones as arrays (b, items), the large ones as rows (b, i)."""

    def __init__(self, pairs: DataFrame, least: int) -> None:
        most = least // 2
        bound = _large(pairs, most)
        self.least, self.pairs = least, pairs
        large = written(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") >= bound).select("b"))
        self.n_large = large.count()
        self.large = written(pairs.join(large, "b", "left_semi"))
        self.small = written(pairs.join(large, "b", "left_anti").groupBy("b").agg(F.array_sort(F.collect_list("i")).alias("items")))
        drop_written(large)

    def counted(self, level: Level) -> DataFrame:
        """(c, i, n): the items that at least `least` baskets of a candidate hold, its own ones among them."""
        found = level.small.join(self.small, "b")
        if level.near is None:
            found = found.select("c", F.explode("items").alias("i")).where("i > c")
        else:  # what isn't frequent with the parent isn't with the candidate
            found = found.select("c", "p", F.explode("items").alias("i")).join(level.near, ["p", "i"])
        out = found.groupBy("c", "i").agg(F.count("*").alias("n")).where(F.col("n") >= self.least - self.n_large)
        maybe = None
        if self.n_large:
            held = level.large.groupBy("c").agg(F.count("*").alias("h"))
            maybe = written(out.join(held, "c", "left").where(F.col("n") + F.coalesce("h", F.lit(0)) >= self.least))
            more = maybe.where("h is not null").select("c", "i").join(level.large, "c").join(self.large, ["b", "i"]).groupBy("c", "i").agg(F.count("*").alias("m"))
            out = maybe.join(more, ["c", "i"], "left").select("c", "i", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")).where(F.col("n") >= self.least)
        if level.near is None:  # each two items were counted once
            both = F.array(F.struct("c", "i", "n"), F.struct(F.col("i").alias("c"), F.col("c").alias("i"), "n"))
            out = out.select(F.inline(both)).union(level.candidates.select("c", F.col("e").alias("i"), "support"))
        out = written(out)
        if maybe is not None:
            drop_written(maybe)
        return out

    def closed(self, level: Level, counts: DataFrame) -> DataFrame:
        """(c, items, e, support) of the candidates that keep their prefix, with what their baskets all hold."""
        full = counts.join(level.candidates.select("c", "support"), "c").where("n = support")
        full = full.groupBy("c").agg(F.array_sort(F.collect_list("i")).alias("items"))
        keeps = F.forall(F.array_except("items", "parent"), lambda x: x >= F.col("e"))
        return written(level.candidates.join(full, "c").where(keeps).select("c", "items", "e", "support"))

    def next(self, level: Level, counts: DataFrame, kept: DataFrame) -> Level:
        """The level of the kept itemsets' extensions by items beyond their last one."""
        grown = counts.join(kept, "c").where("i > e and n < support")
        candidates = written(grown.select(F.monotonically_increasing_id().alias("c"), F.col("c").alias("p"), F.col("items").alias("parent"), F.col("i").alias("e"), F.col("n").alias("support")))
        to = candidates.select(F.col("c").alias("to"), F.col("p").alias("c"), F.col("e").alias("i"))
        small = level.small.select("c", "b").join(to.select("c").distinct(), "c", "left_semi").join(self.small, "b").select("c", "b", F.explode("items").alias("i"))
        small = written(small.join(to, ["c", "i"]).select(F.col("to").alias("c"), F.col("c").alias("p"), "b"))
        large = written(level.large.join(to, "c").join(self.large, ["b", "i"]).select(F.col("to").alias("c"), "b"))
        near = written(counts.join(kept.select("c"), "c", "left_semi").select(F.col("c").alias("p"), "i"))
        return Level(candidates, small, large, near)


class Level:
    """candidates (c, parent, e, support); their occurrences in small (c, p, b) and large (c, b) baskets; and
    near (p, i), the items that are frequent with a candidate's parent p (None at the first level, where c is the item)."""

    def __init__(self, candidates: DataFrame, small: DataFrame, large: DataFrame, near: DataFrame | None) -> None:
        self.candidates, self.small, self.large, self.near = candidates, small, large, near

    def drop(self) -> None:
        for table in (self.candidates, self.small, self.large, self.near):
            if table is not None and hasattr(table, "written_to"):
                drop_written(table)


def closed_itemsets(rows: DataFrame, basket: str = "sale_id", item: str = "item_id", least: int = LEAST, one_in: int = ONE_IN) -> tuple[DataFrame, DataFrame, int]:
    """(items, support) of all closed itemsets in at least `least` baskets and one in `one_in` of all; (i, s), the support of
    each item that frequent; and how many baskets there are.

    rows has a basket and an item in each row; rows where either is null are left out, and repeated rows count once. Items are
    long, the array ascending. No rows give no itemsets. A basket may hold any number of items, and an item may be in all baskets
    (then every itemset has it). Other columns, whatever their names, aren't read. Nothing but a histogram of basket sizes by powers
    of two, and counts, reaches the driver.
    """
    with passing(rows.sparkSession) as keep:
        every = written(_baskets(rows, basket, item))
        total = every.select("b").distinct().count()
        least = max(least, -(-total // one_in))
        supports = keep(written(every.groupBy("i").agg(F.count("*").alias("s")).where(F.col("s") >= least)))
        pairs = written(every.join(supports.select("i"), "i"))
        drop_written(every)
        mine = _Mine(pairs, least)
        base = sorted(r.i for r in supports.where(F.col("s") == total).select("i").collect()) if total else []  # at most as many as the smallest basket has
        found = []
        if base:
            found.append(keep(written(rows.sparkSession.createDataFrame([(base, total)], "items array<long>, support long"))))
        shared = F.array(*map(F.lit, base)).cast("array<long>")
        candidates = supports.where(F.col("s") < total).select(F.col("i").alias("c"), shared.alias("parent"), F.col("i").alias("e"), F.col("s").alias("support"))
        level = Level(candidates, mine.small.select(F.explode("items").alias("c"), "b"), mine.large.select(F.col("i").alias("c"), "b"), None)
        while True:
            counts = mine.counted(level)
            kept = keep(mine.closed(level, counts))
            found.append(kept.select("items", "support"))
            after = mine.next(level, counts, kept)
            level.drop()
            drop_written(counts)
            level = after
            if level.candidates.isEmpty():
                break
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        out = keep(written(out))
    return out, supports, total


def rules(closed: DataFrame, supports: DataFrame, total: int, percent: int = CONFIDENCE) -> DataFrame:
    """(items, c, a, s, support): rules of the closed itemsets of two items or more, each by its item c.

    The rest, without c, has the support a, and c alone s. Of a rest that isn't closed itself, the baskets hold c too:
    what it closes to lies between it and the whole, so that its support is that of the whole."""
    one = closed.where(F.size("items") > 1).select("items", "support", F.explode("items").alias("c"))
    one = one.withColumn("rest", F.array_remove("items", F.col("c")))
    rest = closed.select(F.col("items").alias("rest"), F.col("support").alias("a"))
    found = one.join(rest, "rest", "left").withColumn("a", F.coalesce("a", "support")).join(supports.select(F.col("i").alias("c"), "s"), "c")
    n = F.col("support")
    lifted = n.cast("decimal(20,0)") * F.lit(total) > F.col("a").cast("decimal(20,0)") * F.col("s")
    return found.where((100 * n >= percent * F.col("a")) & lifted).select("items", "c", "a", "s", "support")


def _joined(items: Column) -> Column:
    return F.array_join(items.cast("array<string>"), ",")


def digest(closed: DataFrame, supports: DataFrame, total: int, percent: int = CONFIDENCE) -> DataFrame:
    """A row for each closed itemset: items (ids joined by commas), n_items, support, n_rules, best_item (of its rules, c of the
    smallest a, then the smallest) and rules_sha256."""
    line = F.concat_ws(":", "c", "a", "s")
    of = rules(closed, supports, total, percent).groupBy("items").agg(
        F.count("*").alias("n_rules"), F.min(F.struct("a", "c"))["c"].alias("best_item"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", line.alias("t")))), lambda x: x["t"]), ";").alias("t")
    )
    out = closed.join(of, "items", "left")
    return out.select(_joined(F.col("items")).alias("items"), F.size("items").cast("long").alias("n_items"), "support", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), "best_item", F.sha2(F.coalesce("t", F.lit("")), 256).alias("rules_sha256"))
