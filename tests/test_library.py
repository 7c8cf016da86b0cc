"""The library's own operators on small inputs, against plain Python."""

import math
from collections import Counter

from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions import urls as ur
from quillstone.operators import causal, ordering
from quillstone.plans import QUERIES
from quillstone.runtime import ship


def test_wrt_permutation_is_an_involution(spark):
    row = spark.createDataFrame([("a{b|c}:;<=>?JKX`~PQRS",)], "t string").select(tx.wrt_permute(tx.wrt_permute(F.col("t"))).alias("x"), "t").first()
    assert row.x == row.t


def test_running_sums_over_many_ranges(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "k long, v long")
    got = {r.k: r.s for r in ordering.running(df, "k", {"s": F.col("v")}).collect()}
    total = 0
    for i in range(500):
        total += i % 7
        assert got[i] == total


def test_completion_appends_unknown_ids(spark):
    order = spark.createDataFrame([(0, 5), (1, 2)], "rank long, id long")
    ids = spark.createDataFrame([(i,) for i in range(6)], "id long")
    got = [r.id for r in ordering.complete(order, ids, "id", "rank").orderBy("rank").collect()]
    assert got == [5, 2, 0, 1, 3, 4]


def test_url_classes(spark):
    cases = {"a%20b": "percent_encoded", "2024-01-02": "date_like", "12345": "numeric", "path": "alphabetic", "ab12": "hex", "some-slug": "slug", "deadbeef-0123": "uuid_like", "index.php": "alphabetic", "abcxyz123456": "base64_like", "x_y": "mixed"}
    rows = spark.createDataFrame(list(cases), "string").select("value", ur.component_class(F.col("value")).alias("c")).collect()
    assert {r.value: r.c for r in rows} == cases


def _score(tail: bytes, data: bytes) -> float:
    context, gram, loss = Counter(), Counter(), 0.0
    for i in range(2, len(tail)):
        context[tail[i - 2 : i]] += 1
        gram[tail[i - 2 : i + 1]] += 1
    for i in range(2, len(data)):
        loss -= math.log2((gram[data[i - 2 : i + 1]] + 0.5) / (context[data[i - 2 : i]] + 128.0))
        context[data[i - 2 : i]] += 1
        gram[data[i - 2 : i + 1]] += 1
    return loss


def test_edge_scores_equal_the_loop_and_paths_add_them(spark):
    ship(spark)
    texts = ["abracadabra abracadabra", "abracadabra", "zzz abra", "the cat and the hat", "né café née"]
    docs = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "block long, doc_id long, text string")
    edges = causal.edge_scores(docs)
    got = {(r.source, r.target): r.bits for r in edges.collect()}
    raw = [t.encode() for t in texts]
    assert set(got) == {(a, b) for a in range(5) for b in range(5) if a != b}
    for (a, b), bits in got.items():
        assert abs(bits - _score(raw[a], raw[b])) < 1e-6
    order = docs.select("block", "doc_id", F.col("doc_id").alias("rank"))
    base = causal.path_scores(order, edges).first().bits
    assert abs(base - sum(got[i, i + 1] for i in range(4))) < 1e-6
    best = causal.optimise(order, edges).collect()
    assert sorted(r.doc_id for r in best) == list(range(5)) and best[0].block_bits <= base + 1e-6


def test_blocks_hold_32_consecutive_documents_of_sparse_ids(spark, tmp_path):
    texts = {7 * i + 3: f"abra {i % 5} cadabra {'the cat ' * (i % 3)}hat {i}" for i in range(40)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = sorted(texts)
    raw = [texts[i].encode() for i in ids]
    got = {r.block: r.bits for r in QUERIES["block_path_score"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1]
    for block, (a, b) in enumerate([(0, 32), (32, 40)]):
        assert abs(got[block] - sum(_score(raw[i], raw[i + 1]) for i in range(a, b - 1))) < 1e-3
    best = QUERIES["block_optimise"](spark, str(tmp_path)).collect()
    for block, members in enumerate([ids[:32], ids[32:]]):
        mine = sorted((r for r in best if r.block == block), key=lambda r: r["rank"])
        assert sorted(r.doc_id for r in mine) == members and mine[0].block_bits <= got[block] + 1e-3
        assert abs(mine[0].block_bits - sum(_score(texts[x.doc_id].encode(), texts[y.doc_id].encode()) for x, y in zip(mine, mine[1:], strict=False))) < 1e-3


def test_structural_features_by_hand():
    got = dict(zip(tx.FEATURES, tx.structural_features("Ab 12 x3 [[é]]\n{{".encode()), strict=True))
    size = 18
    assert len(tx.FEATURES) == 151 and got["log2_bytes"] == math.log2(size + 1) and got["digit_ratio"] == 3 / size and got["non_ascii_ratio"] == 2 / size
    assert (got["words_per_kib"], got["average_word_length"], got["number_token_ratio"]) == (2 * 1024 / size, 3 / 2, 1 / 3)  # Ab, x; 12, since x3 is no number
    assert got["link_open_per_kib"] == got["template_open_per_kib"] == got["lines_per_kib"] == 1024 / size and got["ascii_091"] == 2 / 16
    assert not tx.structural_features(b"").any()
    long = b"word 7 " * 400_000
    assert dict(zip(tx.FEATURES, tx.structural_features(long), strict=True))["words_per_kib"] == 400_000 * 1024 / len(long)


def test_features_of_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "i long, text string").mapInArrow(tx.features_of, "i long, " + ", ".join(f"{c} double" for c in tx.FEATURES)).collect()
    assert {r.i: r.ascii_097 for r in rows} == {1: 0.0, 2: 0.0, 3: 1.0}


def test_toggled_runs_come_back(spark):
    cases = {"{a}": "{{a}}", "[[b]] & {{{c": "[b] && {{{c", "": "", "&&amp;[]": "&amp;[[]]", "plain": "plain"}
    rows = spark.createDataFrame(list(cases), "string").select("value", tx.toggle_runs(F.col("value")).alias("t"), tx.toggle_runs(tx.toggle_runs(F.col("value"))).alias("back")).collect()
    assert {r.value: r.t for r in rows} == cases and all(r.back == r.value for r in rows)


def test_causal_losses_by_class(spark):
    ship(spark)
    texts = ["abab ab12, abab", "", "x", "né né né", "a" * 300]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", tx.class_sums(2)("text").alias("s")).collect()
    for r in got:
        raw, contexts, grams = texts[r.i].encode(), Counter(), Counter()
        n, bits = Counter(), Counter()
        for at in range(2, len(raw)):
            c, g = raw[at - 2 : at], raw[at - 2 : at + 1]
            last = raw[at]
            kind = "high" if last > 127 else "digit" if chr(last).isdigit() else "letter" if chr(last).isalpha() else "space" if last in b" \t\n\r" else "punctuation"
            n[kind] += 1
            bits[kind] -= math.log2((grams[g] + 0.5) / (contexts[c] + 128))
            contexts[c] += 1
            grams[g] += 1
        for j, kind in enumerate(tx.CLASSES):
            assert r.s[j] == n[kind] and abs(r.s[5 + j] - bits[kind]) < 1e-9
