"""N-gram Jaccard join by token-group matrices.

Documents are sets of word shingles; two link when percent of their union is common.

1. Equal sets become one class, by 128-bit fingerprints and their size.
2. Classes that can have a partner are put into clusters of similar documents. A
   coordinated sample of the shingles (those with the smallest fingerprints, more than
   a class may miss of a partner) shows how many classes share each; a class with too
   many shingles of its own has no partner, and the others need only be put together
   by the rarest of their shingles, as many as prefix filtering asks for. This loses nothing,
   and is done once more with all shingles of the classes that are left.
3. In a cluster, documents are dealt into groups of similar ones. The token-group matrix
   has each group's token union; a query document opens a group only if its overlap with the
   union allows a link, and only for members that it isn't connected with yet. Members
   are compared exactly. Clusters too large for one task are split into blocks that
   share a few hub documents; what is not connected with most of the cluster then is compared with the
   documents that share one of its rare shingles: block by block, or shingle by shingle where that
   takes fewer rows, so that a large cluster of few links costs no square of its size.
4. Links between classes give connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import components, passing, written
from tallyweave.llm.wordarrays import SPACED, Words, mix, word_chunks

#: Classes and shingles of a cluster that one task takes.
LOCAL_SETS, LOCAL_TOKENS = 1024, 1_000_000
#: Hub documents of a large cluster, about: members of all of its blocks.
HUBS = 8
#: Rows compared by shingle that are as dear as one compared by block.
BY_SHINGLE = 1.0
#: Candidates whose ids are broadcast to pick their texts; beyond that the texts are shuffled.
SENT_KEYS = 500_000
#: Sampled share of the shingles, as a multiple of what a class may miss of a partner.
SAMPLE = 1.5
#: Numbers of classes that share a shingle are told apart up to this.
CAP = 32
#: Cells of a token-group matrix, and sets in a group at least.
CELLS, GROUP = 32 << 20, 16

_ALT = np.uint64(0x632BE59BD9B4E019)


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): document i's distinct shingles, ascending, are
    tokens[bounds[i]:bounds[i + 1]]. With fewer words than size the whole sequence
    is the one shingle; without words there is none."""
    counts = w.counts
    parts = [w.windows(size)]
    for n in range(1, size):
        if (counts == n).any():
            at, value = w.windows(n)
            whole = counts[np.searchsorted(w.bounds, at, side="right") - 1] == n
            parts.append((at[whole], value[whole]))
    at, value = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    owner = np.searchsorted(w.bounds, at, side="right") - 1
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(w.rows) + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def set_keys(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each set."""
    n = np.diff(bounds).astype(np.uint64)
    return mix(_sums(mix(tokens), bounds) + n).view(np.int64), mix(_sums(mix(tokens ^ _ALT), bounds) ^ n).view(np.int64)


def prefix_length(n, percent: int):
    """Shingles of a set of n that a partner need not have, and one more."""
    return n - -(-percent * n // 100) + 1


class Join:
    """The parameters: shingle size, percent, and the sampling threshold that follows."""

    def __init__(self, size: int, percent: int, sample: float = SAMPLE) -> None:
        self.size, self.percent = size, percent
        self.below = np.uint64(min((1 << 64) - 1, int(min(1.0, sample * (100 - percent) / 100) * 2.0**64)))

    def heads(self, docs: DataFrame) -> DataFrame:
        """For each row: doc_id, n (size of its set), k1, k2 (its keys), sampled (its sampled shingles)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w in word_chunks(batch.column("text"), SPACED):
                    tokens, bounds = shingle_sets(w, self.size)
                    k1, k2 = set_keys(tokens, bounds)
                    sampled = np.concatenate(([0], np.cumsum(tokens < self.below)))
                    columns = [np.diff(bounds).astype(np.int64), k1, k2, (sampled[bounds[1:]] - sampled[bounds[:-1]]).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.rows[0], len(w.rows)), *map(pa.array, columns)], ["doc_id", "n", "k1", "k2", "sampled"])

        return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, k1 long, k2 long, sampled long")

    def shared_shingles(self, docs: DataFrame) -> DataFrame:
        """(k1, token, df): sampled shingles that more than one class has. A class with too few
        sampled shingles shows all of its shingles. df: classes that show it, CAP at most.

        A shingle that CAP classes of one run of documents have is known to be shared, and
        sent as such: no partition gets many rows for a frequent shingle."""

        cap = CAP

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w in word_chunks(batch.column("text"), SPACED):
                    tokens, bounds = shingle_sets(w, self.size)
                    n = np.diff(bounds)
                    k1, _ = set_keys(tokens, bounds)
                    shown = tokens < self.below
                    seen = np.concatenate(([0], np.cumsum(shown)))
                    thin = seen[bounds[1:]] - seen[bounds[:-1]] < prefix_length(n, self.percent)
                    first = np.zeros(len(n), bool)
                    first[np.unique(k1, return_index=True)[1]] = True
                    use = np.repeat(first, n) & (shown | np.repeat(thin, n))
                    key, value = tokens[use].view(np.int64), np.repeat(k1, n)[use]
                    flag = np.zeros(len(key), np.int8)
                    order = np.argsort(key, kind="stable")
                    key, value = key[order], value[order]
                    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                    length = np.diff(np.r_[start, len(key)])
                    hot = length >= cap
                    if hot.any():
                        known = np.repeat(hot, length)
                        marks = start[hot]
                        key, value, flag = (
                            np.concatenate((key[~known], value[known], key[marks])),
                            np.concatenate((value[~known], key[known], value[marks])),
                            np.concatenate((flag[~known], np.full(known.sum(), 2, np.int8), np.full(len(marks), 1, np.int8))),
                        )
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value), pa.array(flag)], ["key", "value", "flag"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)]
            frequent = None
            for batch in _ended(batches):
                if batch is not None:
                    now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                    rest = [np.concatenate(x) for x in zip(rest, now, strict=True)] if len(rest[0]) else now
                    if len(rest[0]) < 100_000:
                        continue
                key, value, flag = rest
                if not len(key):
                    continue
                cut = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
                done, rest = [x[:cut] for x in rest], [x[cut:] for x in rest]
                out = [_shared_runs(*done, frequent, cap)] if cut else []
                frequent = frequent if cut == 0 else None
                if len(rest[0]) > 100_000:  # one shingle's rows; the last is kept, for the end of the run
                    tail = [x[-1:] for x in rest]
                    out.append(_shared_runs(*(x[:-1] for x in rest), rest[0][0], cap))
                    frequent, rest = rest[0][0], tail
                for k1, token, df in out:
                    if len(k1):
                        yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(token), pa.array(df)], ["k1", "token", "df"])

        rows = docs.select("text").mapInArrow(emit, "key long, value long, flag byte")
        return rows.repartition("key").sortWithinPartitions("key", "value", "flag").mapInArrow(compare, "k1 long, token long, df int")

    def clusters(self, docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node, component) of classes, by k1, that may have partners; and the shingles (k1, token) that put them
        together: any two classes that link share one."""
        late = F.expr(f"(token ^ {-(1 << 63)}) >= {int(self.below) - (1 << 63)}")
        shared = self.shared_shingles(docs).groupBy("k1").agg(F.collect_set(F.struct(late.alias("late"), "df", "token")).alias("all"))
        shared = shared.join(classes.groupBy("k1").agg(F.max("n").alias("n"), F.max("sampled").alias("sampled")), "k1")
        early = F.array_sort(F.filter("all", lambda x: ~x["late"]))
        after = F.array_sort(F.filter("all", lambda x: x["late"]))
        prefix = F.expr(f"n + cast(floor(-({self.percent} * n) / 100.0) as long) + 1")
        shared = shared.withColumns({"early": early, "after": after, "p": prefix})
        of_early = F.greatest(F.lit(0), F.least(F.size("early"), F.col("p") - F.col("sampled") + F.size("early")))
        own_late = F.col("n") - F.col("sampled") - F.size("after")
        of_after = F.greatest(F.lit(0), F.least(F.size("after"), F.col("p") - F.col("sampled") - own_late))
        kept = F.concat(F.slice("early", F.lit(1), of_early.cast("int")), F.slice("after", F.lit(1), of_after.cast("int")))
        buckets = written(shared.select("k1", F.explode(kept).alias("x")).select("k1", F.col("x.token").alias("token")))
        least = buckets.groupBy("token").agg(F.min("k1").alias("hub"))
        return components(buckets.join(least, "token").select(F.col("k1").alias("a"), F.col("hub").alias("b"))), buckets

    def sets(self, docs: DataFrame, clusters: DataFrame) -> DataFrame:
        """(k1, n, tokens, cluster) of the documents whose class is in clusters(k1, cluster)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w in word_chunks(batch.column("text"), SPACED):
                    tokens, bounds = shingle_sets(w, self.size)
                    k1, _ = set_keys(tokens, bounds)
                    n = np.diff(bounds)
                    rows = np.flatnonzero(n)
                    data = [tokens[bounds[i] : bounds[i + 1]].tobytes() for i in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(k1[rows]), pa.array(n[rows].astype(np.int64)), pa.array(data, pa.binary())], ["k1", "n", "tokens"])

        few = clusters.count() <= SENT_KEYS
        return docs.select("text").mapInArrow(run, "k1 long, n long, tokens binary").join(F.broadcast(clusters) if few else clusters, "k1")

    def links(self, docs: DataFrame, clusters: DataFrame, buckets: DataFrame, local_sets: int = LOCAL_SETS, local_tokens: int = LOCAL_TOKENS) -> DataFrame:
        """(a, b) by k1: links that connect all classes that are connected."""
        clusters = clusters.select(F.col("node").alias("k1"), F.col("component").alias("cluster"))
        sets = written(self.sets(docs, clusters))
        sizes = sets.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / local_sets), F.ceil(F.sum("n") / local_tokens)).alias("blocks"), F.min("k1").alias("hub"), F.count("*").alias("n_sets"))
        large = sizes.where("blocks > 1")
        whole = {"block": F.lit(0), "part": F.lit(0), "label": F.col("k1"), "query": F.lit(True)}
        if not large.head(1):
            return self._solve(sets.withColumns(whole))
        large = _sent(written(large.withColumn("blocks", (2 * F.col("blocks")).cast("int"))))
        small = self._solve(sets.join(large, "cluster", "left_anti").withColumns(whole))
        is_hub = (F.col("k1") == F.col("hub")) | (F.pmod(F.xxhash64("k1", F.lit(3)), F.greatest(F.lit(1), F.floor(F.col("n_sets") / HUBS))) == 0)
        mine = F.array(F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int"))
        in_block = sets.join(large, "cluster").withColumn("block", F.explode(F.when(is_hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(mine)))
        first = written(small.union(self._solve(in_block.withColumns(whole | {"block": F.col("block")}))))
        labels = components(first).withColumnRenamed("node", "k1")
        members = sets.select("k1", "cluster").join(large, "cluster").join(labels, "k1", "left")
        members = members.select("k1", "cluster", "blocks", F.coalesce("component", "k1").alias("label"))
        main = members.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        members = _sent(written(members.join(main, "cluster").select("k1", "cluster", "blocks", "label", (F.col("label") != F.col("main")).alias("far"))))
        if not members.where("far").head(1):
            return first
        # What is left are links with a class outside the largest part of its cluster: the two share a token of buckets.
        shared = buckets.join(members, "k1")
        parts = lambda n: F.greatest(F.lit(1), F.ceil(2 * F.col(n) / local_sets)).cast("int")
        counts = [F.count("*").alias("n_sets"), F.count_if("far").alias("n_far")]
        groups = shared.groupBy("cluster", "token").agg(*counts, F.min("label").alias("a"), F.max("label").alias("z")).where("n_far > 0 and a != z")
        groups = _sent(written(groups.select("cluster", "token", parts("n_sets").alias("by"), parts("n_far").alias("parts"), "n_sets", "n_far")))
        able = written(shared.join(groups.select("token", F.col("by"), F.col("parts").alias("token_parts")), "token"))
        by_block = able.select("k1", "cluster", "blocks", "label", "far").distinct()
        rows_of = F.col("n_far") * F.col("blocks") + F.col("n_sets") * F.col("parts")
        block_rows = by_block.groupBy("cluster", "blocks").agg(*counts).withColumn("parts", parts("n_far")).select("cluster", "parts", rows_of.alias("block_rows"))
        token_rows = groups.withColumnRenamed("by", "blocks").groupBy("cluster").agg(F.sum(rows_of).alias("token_rows"))
        plan = block_rows.join(token_rows, "cluster").withColumn("by_token", F.col("token_rows") * BY_SHINGLE < F.col("block_rows"))
        whole_rows = by_block.join(plan.where("not by_token").select("cluster", "parts"), "cluster")
        token_rows = able.join(plan.where("by_token").select("cluster"), "cluster").select("k1", F.col("token").alias("cluster"), F.col("by").alias("blocks"), "label", "far", F.col("token_parts").alias("parts"))
        rows = whole_rows.select(token_rows.columns).unionByName(token_rows).join(sets.join(large.select("cluster"), "cluster", "left_semi").select("k1", "n", "tokens"), "k1")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        asked = rows.where("far").withColumns({"part": F.pmod(F.xxhash64("k1", F.lit(7)), F.col("parts")).cast("int"), "query": F.lit(True)}).withColumn("block", each("blocks"))
        held = rows.withColumns({"block": F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int"), "query": F.lit(False)}).withColumn("part", each("parts"))
        columns = ["cluster", "block", "part", "k1", "n", "tokens", "label", "query"]
        return first.union(self._solve(asked.select(columns).unionByName(held.select(columns))))

    def _solve(self, rows: DataFrame) -> DataFrame:
        """Links within each (cluster, block, part), with at least one query row."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for group in _groups(batches, held):
                k1 = np.array([r[3] for r in group], np.int64)
                edges = link(
                    [np.frombuffer(r[4], np.uint64) for r in group], percent, np.unique([r[5] for r in group], return_inverse=True)[1], np.array([r[6] for r in group], bool)
                )
                if edges:
                    a, b = np.array(edges).T
                    yield pa.RecordBatch.from_arrays([pa.array(k1[a]), pa.array(k1[b])], ["a", "b"])

        rows = rows.select("cluster", "block", "part", "k1", "tokens", "label", "query").repartition("cluster", "block", "part").sortWithinPartitions("cluster", "block", "part", "k1", "query")
        return rows.mapInArrow(run, "a long, b long")

    def components(self, docs: DataFrame, local_sets: int = LOCAL_SETS, local_tokens: int = LOCAL_TOKENS) -> DataFrame:
        docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
        with passing(docs.sparkSession) as keep:
            heads = keep(written(self.heads(docs)))
            classes = written(heads.where("n > 0").groupBy("k1", "k2", "n", "sampled").agg(F.min("doc_id").alias("least")))
            found, _ = self.clusters(docs, classes)
            few = candidates(docs, classes, found)
            # Among the candidates all shingles are counted: most that only passages had brought together drop out.
            found, buckets = Join(self.size, self.percent, float("inf")).clusters(few, classes.withColumn("sampled", F.col("n")))
            joined = components(self.links(few, found, buckets, local_sets, local_tokens))
            joined = joined.select(F.col("node").alias("k1"), F.col("component").alias("c"))
            linked = written(classes.select("k1", "k2", "n", "least").join(joined, "k1"))
            # Classes without links, and rows without shingles, get the least id of their class, or their own.
            linked = linked.join(linked.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("k1", "k2", "n", "component_id")
            alone = classes.select("k1", "k2", "n", "least").join(linked.select("k1"), "k1", "left_anti").withColumnRenamed("least", "component_id")
            labels = keep(written(alone.unionByName(linked)))
        out = heads.join(labels, ["k1", "k2", "n"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _sent(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has SENT_KEYS rows at most."""
    return F.broadcast(table) if table.count() <= SENT_KEYS else table


def candidates(docs: DataFrame, classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """doc_id and text of a document of each class in clusters: the one with the smallest id. Documents
    without an id are all taken, if the ids of a class are all null."""
    ids = written(clusters.select(F.col("node").alias("k1")).join(classes, "k1").select(F.col("least").alias("_id")).distinct())
    nameless = bool(ids.where("_id is null").head(1))
    named = ids.where("_id is not null")
    out = docs.join(F.broadcast(named) if named.count() <= SENT_KEYS else named, F.col("doc_id") == F.col("_id"), "left_semi")
    return written(out.unionByName(docs.where("doc_id is null")) if nameless else out)


def _ended(batches):
    yield from batches
    yield None


def _shared_runs(key: np.ndarray, value: np.ndarray, flag: np.ndarray, frequent, cap: int = CAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k1, token, df) of sorted rows that hold whole runs, but for the first if its token is frequent."""
    known = flag == 2
    out = [(key[known], value[known], np.full(known.sum(), cap, np.int32))]
    key, value, flag = key[~known], value[~known], flag[~known]
    if len(key):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        new = np.r_[True, (key[1:] != key[:-1]) | (value[1:] != value[:-1])]
        length = np.diff(np.r_[start, len(key)])
        df = np.minimum(np.add.reduceat(new.astype(np.int64), start), cap)
        df[(np.maximum.reduceat(flag, start) == 1) | (key[start] == frequent if frequent is not None else False)] = cap
        df = np.repeat(df, length)
        use = new & (df > 1)
        out.append((value[use], key[use], df[use].astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _groups(batches: Iterator[pa.RecordBatch], held: list[tuple]) -> Iterator[list[tuple]]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                yield list(held)
                held.clear()
            held.append(row)
    if held:
        yield list(held)


def link(sets: list[np.ndarray], percent: int, labels: np.ndarray, query: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of indices that link sets of different labels, until all sets that are
    connected by links from a query set have the same label."""
    n_sets = len(sets)
    if n_sets < 2:
        return []
    size = np.array([len(s) for s in sets])
    order = np.lexsort((size, np.array([s[0] for s in sets])))
    sets, size, labels, query = [sets[i] for i in order], size[order], labels[order].copy(), query[order]
    universe, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(size)))
    per_group = max(GROUP, -(-n_sets * len(universe) // CELLS))
    group = np.arange(n_sets) // per_group
    starts = np.arange(0, n_sets, per_group)
    matrix = np.zeros((len(starts), len(universe)), bool)
    matrix[np.repeat(group, size), tokens] = True
    least, most = np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts)
    flags = np.zeros(len(universe), np.int32)
    edges: list[tuple[int, int]] = []
    for q in np.flatnonzero(query):
        mine = tokens[bounds[q] : bounds[q + 1]]
        n = size[q]
        bound = matrix[:, mine].sum(1)
        opened = ((100 + percent) * bound >= percent * (n + least)) & (100 * most >= percent * n) & (100 * n >= percent * least)
        opened &= (np.minimum.reduceat(labels, starts) != labels[q]) | (np.maximum.reduceat(labels, starts) != labels[q])
        members = np.flatnonzero(opened[group] & (labels != labels[q]) & (100 * size >= percent * n) & (100 * n >= percent * size))
        if not len(members):
            continue
        flags[mine] = 1
        lengths = size[members]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(bounds[members] - (ends - lengths), lengths)
        common = np.add.reduceat(flags[tokens[at]], ends - lengths)
        flags[mine] = 0
        linked = members[100 * common >= percent * (n + lengths - common)]
        for e in linked:
            if labels[e] != labels[q]:
                edges.append((int(order[q]), int(order[e])))
                labels[labels == labels[e]] = labels[q]
    return edges


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, local_sets: int = LOCAL_SETS, local_tokens: int = LOCAL_TOKENS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row.

    docs needs doc_id and text. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Documents
    link when 100 * common >= percent * union of their shingles. Null texts and texts
    without words have no shingles and no links; theirs is their own doc_id. Rows
    of one doc_id count as documents of their own with that id; a null doc_id is the
    smallest of no component that has another. Texts are read whole however long; a row's shingles are in
    memory at once. An empty table gives no rows. Other columns are not read.
    """
    return Join(size, percent).components(docs, local_sets, local_tokens)
