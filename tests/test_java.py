"""Functions in Java against the Python that they stand for, on hard values; no byte of theirs passes a Python worker."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.functions import coding, predictor, recurrent
from quillstone.plans import QUERIES, language

HARD = [b"", b"a", b"\0", b"\xff" * 3000, b"ab" * 400, bytes(range(256)) * 3, random.Random(1).randbytes(1500), b"the cat sat on the mat; the cat ate the rat. " * 12, "Ünï ÀÉ öß, İ naïve ".encode() * 20]


def _rows(spark):
    return spark.createDataFrame([(k, x) for k, x in enumerate([*HARD, None])], "k long, x binary").repartition(3)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _in_java(spark, column, expected):
    df = _rows(spark).where("x IS NOT NULL").select("k", column(spark, F.col("x")).alias("bits"))
    assert "EvalPython" not in _plan(df)
    for r in df.collect():
        assert r.bits == pytest.approx(expected(HARD[r.k]), abs=1e-4), r.k


def test_packed_values(spark, tmp_path):
    df = _rows(spark).select("k", "x", coding.packed(spark, "x").alias("p")).select("*", coding.unpacked(spark, "p").alias("y"))
    for r in df.collect():
        assert r.x == r.y and (r.x is None or bytes(r.p) == len(r.x).to_bytes(4, "big") + coding.Coder.encode(bytes(r.x)))
    spark.createDataFrame([(1, "é" * 9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "EvalPython" not in _plan(QUERIES["codec_roundtrip"](spark, str(tmp_path)))


def test_partial_matching(spark):
    _in_java(spark, predictor.matching_bits, predictor.PartialMatch.bits)


def test_context_mixing(spark):
    _in_java(spark, predictor.mixing_bits, predictor.coded_bits)


def test_recurrent_model(spark):
    _in_java(spark, recurrent.recurrent_bits, recurrent.Lstm.bits)


WORDS = ["The dog's the-cat 'tis ''twas the the x the'", "", "the", "É the épée THE KELVIN İx the\nend", "a-b' -c 'd e''f- the 9the 'the g", None]


def test_words_are_counted_in_their_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(WORDS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = Counter()
    for t in WORDS:
        found = re.findall("'?[a-z][a-z'-]*", (t or "").lower())
        expected.update((w, k > 0 and found[k - 1] == "the") for k, w in enumerate(found))
    df = language.words(spark, str(tmp_path))
    assert {(r.word, r.after_the): r.n for r in df.collect()} == expected and "regexp_extract_all" not in _plan(df)


def test_words_are_coded(spark, tmp_path):
    known = ["the", "capital", "international", "abc", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(4500))]
    code, texts = coding.WordCode(known), ["The THE tHe", "internationally INTERNATIONALx xinternational", "é\x06\x07@\x0cABc A Ab wbbb Wzcb", "x" * 40 + "X" * 40 + "Xx", "", "waaA waga WABAa", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", coding.words_coded(spark, F.col("t"), known).alias("c")).select("*", coding.words_restored(spark, F.col("c"), known).alias("r"))
    assert "EvalPython" not in _plan(df)
    for r in df.collect():
        assert r.r == r.t and (r.t is None or bytes(r.c) == code.encode(r.t.encode()))
    spark.createDataFrame(list(enumerate(WORDS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.word: r.n for r in QUERIES["word_dictionary"](spark, str(tmp_path)).collect()} == Counter(w for t in WORDS for w in re.findall("[a-z]+", (t or "").lower()))
