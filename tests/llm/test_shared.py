import random

from tallyweave.llm import shared


def brute(edges):
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            label[b] = a
    return {x: root(x) for x in label}


def run(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
    rows = shared.components(frame).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


def test_components(spark, monkeypatch):
    r = random.Random(6)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    loose = [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    edges = chain + star + loose + [(5, 5), (None, 7), (-3, 9), (-3, 9)]
    r.shuffle(edges)
    for size in (shared.FOREST_EDGES, 5):
        monkeypatch.setattr(shared, "FOREST_EDGES", size)
        assert run(spark, edges) == brute(edges)
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_written_tables_go(spark):
    table = shared.written(spark.range(5).toDF("a"))
    assert table.count() == 5
    (path,) = {f.rpartition("/")[0].removeprefix("file://") for f in table.inputFiles()}
    shared.drop_written(table)
    import os

    assert not os.path.exists(path)


def test_blocks_delete_their_own_tables_alone(spark):
    """Tables of other threads, and those handed on, stay; after an exception all of a block's go."""
    import threading

    import pytest

    there = lambda table: table.count() == 3
    rows, other, begun, done = spark.range(3), [], threading.Event(), threading.Event()

    def elsewhere():
        other.append(shared.written(rows))
        begun.set()
        done.wait()

    with shared.passing(spark) as outer:
        thread = threading.Thread(target=elsewhere)
        thread.start()
        begun.wait()
        with shared.passing(spark) as keep:
            gone, kept = shared.written(rows), keep(shared.written(rows))
        assert gone.written_to not in shared._tables and there(kept)
        last = outer(shared.written(rows))
    assert kept.written_to not in shared._tables and there(last) and there(other[0])
    done.set()
    thread.join()
    with pytest.raises(KeyError), shared.passing(spark) as keep:
        held = keep(shared.written(rows))
        raise KeyError
    assert held.written_to not in shared._tables
    shared.drop_written(last)
    shared.drop_written(other[0])
