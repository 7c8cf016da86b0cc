"""Dumps split over many tasks, corpora written in an order, feature blocks and traces with faults."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.runtime import ship
from quillstone.sources import dumps, tables


def _page(i: int) -> str:
    text = "#REDIRECT [[x]]" if i % 5 == 0 else "a\nb\nc\nd é\n" * (i % 40) + "[[fr:Foo]]\n[[de:Bar]]"
    return f'    <title>T{i}</title>\n    <id>{i * 3}</id>\n    <revision>\n      <text xml:space="preserve">{text}</text>\n    </revision>\n'


@pytest.fixture
def dump(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    path = tmp_path / "x.xml"
    path.write_text("<mediawiki>\n" + "".join(f"  <page>\n{_page(i)}  </page>\n" for i in range(200)) + "  <page>\n    <title>cut")
    yield str(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_pages_keep_their_order_and_parts(spark, dump):
    pages = dumps.read_pages(spark, dump)
    assert [r.raw for r in pages.orderBy("page_index").collect()] == [_page(i) for i in range(200)]
    raw = F.col("raw")
    rows = dumps.streams(pages.withColumn("id", dumps.page_id(raw)).withColumn("r", dumps.is_redirect(raw))).withColumn("j", dumps.joined()).collect()
    assert all(r.j == r.raw and r.id == 3 * r.page_index and r.r == (r.page_index % 5 == 0) for r in rows)
    tails = {r.page_index: r.tail for r in rows}
    assert tails[1] == "[[fr:Foo]]\n[[de:Bar]]" and tails[5] == "" and tails[40] == ""
    assert all(t == "[[fr:Foo]]\n[[de:Bar]]" for i, t in tails.items() if i % 5 and i % 40)


def test_corpus_and_manifest(spark, dump, tmp_path):
    reversed_ = dumps.read_pages(spark, dump).withColumn("rank", 199 - F.col("page_index")).drop("page_index")
    out = str(tmp_path / "out")
    dumps.write_corpus(reversed_, "rank", out)
    got = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert got == "".join(f"  <page>\n{_page(i)}  </page>\n" for i in reversed(range(200)))
    rows = dumps.manifest(reversed_, "rank").orderBy("rank").collect()
    assert rows[-1].stream_end == len(got.encode()) and got.encode()[rows[5].stream_begin : rows[5].stream_end].decode().startswith("  <page>\n    <title>T194<")


def test_blocks(spark, tmp_path):
    def block(name: str, lines: str, offset: int = 0):
        (tmp_path / name).write_text(lines)
        return tables.read_block(spark, str(tmp_path / name), offset)

    a = block("a", "id\tx\ty\n1\t0.5\t1\n2\t3\t4e-3\n")
    b = block("b", "2\t7\n3\t8\n", -1)
    assert sorted((r.id, r.features) for r in tables.align([a, b]).collect()) == [(1, [0.5, 1.0, 7.0]), (2, [3.0, 0.004, 8.0])]
    for name, lines in (("ragged", "1\t2\n2\t3\t4\n"), ("twice", "1\t2\n1\t3\n"), ("negative", "-1\t2\n")):
        with pytest.raises(ValueError):
            block(name, lines)
    with pytest.raises(ValueError):
        tables.align([a, block("c", "9\t1\n")])
    tables.write_block(a, str(tmp_path / "w"))
    assert sorted((r.id, r.features) for r in tables.read_block(spark, str(tmp_path / "w")).collect()) == [(1, [0.5, 1.0]), (2, [3.0, 0.004])]


def test_traces(spark, tmp_path):
    ship(spark)
    rows = np.zeros(40, tables.TRACE_RECORD)
    rows["byte_pos"], rows["bit_index"], rows["final_p"] = np.arange(40) // 8, np.arange(40) % 8, 60000
    (tmp_path / "t").write_bytes(b"TRACE1\0\0" + rows.tobytes())
    got = tables.read_trace(spark, str(tmp_path / "t"), b"TRACE1\0\0", 2).collect()
    assert len(got) == 24 and got[0].byte_pos == 2 and got[0].final_p == 60000
    (tmp_path / "cut").write_bytes(b"TRACE1\0\0" + rows.tobytes()[:-3])
    for name, magic in (("cut", b"TRACE1\0\0"), ("t", b"OTHER")):
        with pytest.raises(Exception, match="cut off|not a trace"):
            tables.read_trace(spark, str(tmp_path / name), magic).collect()
