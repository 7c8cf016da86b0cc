"""Hierarchies and clusters against plain Python, splits by hash, and a stream of several micro-batches."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.operators import causal, hierarchy
from quillstone.plans import QUERIES
from quillstone.plans.orders import blake_split, gzip_size
from quillstone.runtime import ship
from quillstone.streaming import adaptive


def _halves(ids: list, x: dict, left: int) -> tuple[list, list]:
    rows = np.array([x[i] for i in ids])
    spread = np.round(rows.var(axis=0), 9)
    axis = int(spread.argmax())
    by_axis = sorted(ids, key=lambda i: (x[i][axis], i))
    a, b = x[by_axis[left // 2]], x[by_axis[min(len(ids) - 1, left + (len(ids) - left) // 2)]]
    gap = lambda i: (round(sum((x[i] - a) ** 2) - sum((x[i] - b) ** 2), 9), i)
    done = sorted(ids, key=gap)
    return done[:left], done[left:]


def _order(ids: list, x: dict, levels: tuple) -> list:
    size = next((s for s in levels if len(ids) > s), None)
    if size is None:
        return sorted(ids)
    one, two = _halves(ids, x, -(-len(ids) // size) // 2 * size)
    return _order(one, x, levels) + _order(two, x, levels)


def test_hierarchy_equals_recursion(spark):
    rng = np.random.default_rng(5)
    x = {i: np.round(rng.normal(size=3), 3) for i in range(90)}
    x[7] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, features array<double>")
    got = [r.id for r in hierarchy.hierarchical_order(rows, (32, 8), 1).orderBy("rank").collect()]
    assert got == _order(list(x), x, (32, 8))
    with pytest.raises(ValueError):
        hierarchy.hierarchical_order(rows, (32, 7))


def test_small_and_empty_hierarchies(spark):
    rows = spark.createDataFrame([(2, [1.0]), (1, [5.0])], "id long, features array<double>")
    assert [(r.id, r.rank) for r in hierarchy.hierarchical_order(rows).orderBy("rank").collect()] == [(1, 0), (2, 1)]
    assert hierarchy.hierarchical_order(rows.where("id > 5")).count() == 0


def test_line_clusters_equal_lloyd(spark):
    rng = np.random.default_rng(6)
    values = np.round(np.concatenate([rng.normal(m, 0.3, 40) for m in (0, 4, 9)]), 3)
    got = {r.id: r.cluster for r in hierarchy.line_clusters(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, value double"), 20, 4).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    k = len(values) // 20
    want = {i: r * k // len(values) for r, i in enumerate(order)}
    for _ in range(4):
        centres = sorted(round(float(np.mean([values[i] for i in want if want[i] == c])), 9) for c in set(want.values()))
        middles = [(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)]
        want = {i: sum(m < values[i] for m in middles) for i in want}
    assert got == want


def test_splits_and_sizes(spark):
    ship(spark)
    rows = spark.createDataFrame([(0, "a" * 999), (12345, ""), (None, None)], "i long, t string").select("i", blake_split("i").alias("s"), gzip_size("t").alias("g")).collect()
    for r in rows[:2]:
        assert r.s == int.from_bytes(hashlib.blake2s(str(r.i).encode(), digest_size=4).digest(), "little") % 8
    assert rows[0].g < 50 and rows[2].s is None and rows[2].g is None


def test_stream_state_outlives_batches(spark, tmp_path):
    ship(spark)
    rows = [(str(i % 3), i, i, "abca"[i % 4]) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "key string, event_id long, ts long, symbol string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, event_id long, ts long, symbol string").parquet(str(tmp_path / "in"))
        adaptive.drain(adaptive.adaptive_bits(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.event_id: r.bits for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    seen: dict = {}
    for key, i, _, s in rows:
        mine = seen.setdefault(key, {})
        assert abs(got.pop(i) - (math.log2(sum(mine.values()) + 0.5 * (len(mine) + 1)) - math.log2(mine.get(s, 0) + 0.5))) < 1e-9
        mine[s] = mine.get(s, 0) + 1
    assert not got and spark.read.parquet(str(tmp_path / "out")).select(F.sum("bits")).first()[0] > 0


def test_trigram_counts_leave_in_bounded_batches(spark, tmp_path):
    texts = [np.random.default_rng(k).integers(97, 123, 9000, np.uint8).tobytes().decode() for k in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    grams = [len({t[k : k + 3] for k in range(len(t) - 2)}) for t in texts]
    assert QUERIES["trigram_tail_counts"](spark, str(tmp_path)).count() == sum(grams) > 2 * causal.BATCH_ROWS
    found = []
    for batch in _counted(texts):
        assert batch.num_rows < causal.BATCH_ROWS + 16 * 1024
        found.append(batch.num_rows)
    assert sum(found) == sum(grams)


def _counted(texts):
    """The batches of trigram counts of one batch of texts."""
    taken = []

    class Docs:
        sparkSession, schema = None, StructType().add("block", "integer").add("doc_id", "long").add("text", "string")
        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: taken.append(f)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(causal, "ship", lambda _: None)
        causal.grams(Docs(), kept=("tail",))
    return taken[0](iter([pa.RecordBatch.from_pydict({"block": [0] * len(texts), "doc_id": list(range(len(texts))), "text": texts})]))
