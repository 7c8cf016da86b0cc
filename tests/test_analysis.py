"""Byte classes, events of digits and blocks of text against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest

from quillstone.functions import classes, roles
from quillstone.operators import control
from quillstone.plans.analysis import parse_block, parse_segments
from quillstone.sources import dumps, tables


def test_classes_by_hand():
    assert classes.labels(ord("J")) == ("colon", 5, "colon", "colon", "colon") and classes.labels(ord("a")) == ("letter", 2, "letter", "other", "lower")
    assert classes.labels(0xE9) == ("word_token", 2, "word_token", "other", "high_byte") and classes.labels(ord("-")) == ("dash", 6, "other", "dash", "hyphen")
    assert classes.labels(0) == ("other", 0, "other", "other", "other") and classes.labels(ord("{"))[3:] == ("markup", "open_bracket") and classes.labels(ord("\f")) == ("other", 0, "other", "other", "whitespace")


def _events(text):
    """One byte after the other."""
    out, raw = Counter(), text.encode()
    run = segment = 0
    linked, shape = None, []
    for at, b in enumerate(raw):
        digit, before = chr(b).isdigit() and b < 128, at > 0 and 48 <= raw[at - 1] <= 57
        out["event", "all"] += 1
        out["event", "boundary_active" if before else "boundary_inactive"] += 1
        if digit:
            out["event", "digit"] += 1
            if before:
                out["event", "continue_digit"] += 1
            elif linked:
                out["event", "linked_run_start"] += 1
                out["separator", linked] += 1
                segment, linked = segment + 1, None
            else:
                out["event", "start_digit"] += 1
                segment, shape = 0, []
            run = run + 1 if before else 1
            out["segment", str(min(segment, 5))] += 1
        elif before:
            out["event", "run_ended"] += 1
            out["terminator", classes.labels(b)[3]] += 1
            bucket = classes.run_bucket(min(run, 255))
            out["run_length", str(bucket)] += 1
            mark = classes.SEPARATORS.get(chr(b))
            if mark and (chr(b) != "T" or segment >= 2):
                linked = mark
                out["event", "separator"] += 1
                shape.append(f"{bucket}-{mark}")
                out["shape", "/".join(shape)] += 1
            else:
                out["event", "sequence_end"] += 1
                segment, linked = 0, None
        elif linked:
            out["event", "sequence_end"] += 1
            segment, linked = 0, None
        else:
            out["event", "non_numeric"] += 1
    return dict(out)


def test_numeric_events_equal_a_loop_over_bytes():
    rnd = random.Random(2)
    texts = ["", "12", "a1", "1a", "2024-01-02T03:04:05Z", "1,234.5 1T2", "3-", "3- 4", "3--4", "é1é", *("".join(rnd.choice("0123456789-:.,/+TJ a<é") for _ in range(rnd.randrange(1, 80))) for _ in range(500))]
    for t in texts:
        assert classes.numeric_events(t) == _events(t), t


def _blocks(raw):
    out, at, inside = [], 0, False
    while at < len(raw):
        end, counter, start, run, spaces = len(raw), 0, None, 0, 0
        for i in range(at, len(raw)):
            plain = 9 <= raw[i] <= 13 or 32 <= raw[i] <= 126
            if inside:
                counter = max(0, counter - 2) if plain else counter + 3
                if counter > 300:
                    end = i + 1 - 100
                    break
            elif not plain:
                start = None
            else:
                if start is None:
                    start, run, spaces = i, 0, 0
                run, spaces = run + 1, spaces + (raw[i] == 32)
                if run > 500:
                    if spaces >= 5:
                        end = start
                        break
                    start = None
        if end > at:
            out.append((inside, end - at))
        inside, at = not inside, end
    return out


def test_text_blocks_equal_a_loop_over_bytes():
    rng = np.random.default_rng(4)
    cases = [b"", b"short text", b"a" * 2000, b"word " * 300, bytes(range(128, 256)) * 4 + b"some words here " * 60 + bytes(range(128, 256)) * 4]
    for _ in range(60):
        parts = [rng.integers(*((32, 127) if rng.random() < 0.6 else (0, 256)), size=int(rng.integers(1, 900)), dtype=np.int64).astype(np.uint8).tobytes() for _ in range(6)]
        cases.append(b"".join(p.replace(b"a", b" ") if rng.random() < 0.7 else p for p in parts))
    for raw in cases:
        got = classes.text_blocks(raw)
        assert got == _blocks(raw) and sum(n for _, n in got) == len(raw)


def test_followers_and_grams():
    raw = np.frombuffer(b"abcabcabd", np.uint8)
    assert classes.followers(raw, (1,)) == (5, 4) and classes.followers(raw, (1, 2)) == (4, 3) and classes.followers(raw[:1], (1,)) == (0, 0)


def test_user_specs():
    assert parse_segments("120:15,0:25", 200) == [(0, 25), (120, 135)] and parse_block("a.tsv:0.5:-1") == ("a.tsv", 0.5, -1) and parse_block("a.tsv") == ("a.tsv", 1.0, 0)
    for bad in ("0:5,4:2", "190:20", "3:0"):
        with pytest.raises(ValueError, match="segments"):
            parse_segments(bad, 200)


def test_roles_of_bytes():
    assert roles.byte_roles("http://a.b/c/d.e.f?g=h&i#j") == [("scheme", 7), ("domain", 3), ("path_segment", 2), ("path_segment", 2), ("extension", 4), ("query_key", 2), ("query_value", 2), ("query_key", 2), ("fragment", 2)]
    assert roles.byte_roles("no url") == [] and roles.byte_roles("ftp://é/") == [("scheme", 6), ("domain", 2), ("path_segment", 1)]


def test_corrections_learn_their_roles_only():
    c = roles.Correction()
    others = [0.8, 0.3, 0.9999, 0.5, 0.6]
    before = c.predict(0.4, others, "query_key", 17)
    assert abs(before - 0.4) < 1e-12
    for _ in range(50):
        c.learn(0.4, others, "query_key", 17, 1)
        c.learn(0.4, others, "domain", 17, 0)
    assert c.predict(0.4, others, "query_key", 17) > c.predict(0.4, others, "query_key", 18) > 0.4 and c.predict(0.4, others, "domain", 17) == 0.4
    assert c.features([0.9999999])[1] == 4 and list(c.features([])) == [1, 0, 0, 0, 0, 0]


def test_halves_cost_as_much_as_whole_bytes():
    counts = np.bincount(np.frombuffer(b"abracadabra" * 3 + bytes(range(256)), np.uint8), minlength=256)
    share = counts[counts > 0] / counts.sum()
    assert abs(roles.halved_bits(counts) + float((counts[counts > 0] * np.log2(share)).sum())) < 1e-9 and roles.halved_bits(np.zeros(256, int)) == 0


def test_a_page_inside_another_is_an_error(spark, tmp_path):
    page = dumps.PAGE_OPEN + "    <id>1</id>\n" + dumps.PAGE_CLOSE
    for name, text, fine in (("a", "<head>\n" + page * 2 + dumps.PAGE_OPEN + "cut", True), ("b", page + dumps.PAGE_OPEN + "x\n" + page, False), ("c", page, True)):
        (tmp_path / name).write_text(text)
        if fine:
            assert dumps.read_pages(spark, f"file://{tmp_path}/{name}", strict=True).count() == text.count(dumps.PAGE_CLOSE)
        else:
            with pytest.raises(ValueError, match="inside"):
                dumps.read_pages(spark, f"file://{tmp_path}/{name}", strict=True)


def test_traces_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 65536, 3, k % 8, k % 2, 1, k % 9) for k in range(5000)], tables.TRACE_SCHEMA).repartition(3)
    tables.write_trace(rows, f"file://{tmp_path}/t", b"QSTRACE\0")
    got = tables.read_trace(spark, f"file://{tmp_path}/t", b"QSTRACE\0", warmup=10)
    assert sorted(got.collect()) == sorted(rows.where("byte_pos >= 10").collect())


def test_rules_need_their_support_and_gain(spark):
    cells = [(s, 1, 2, scale, 40_000, 1000.0 - 100 * (scale == 4) + 5 * (scale == 0)) for s in range(8) for scale in range(5)] + [(s, 3, 3, scale, 10, 10.0 - (scale == 1)) for s in range(8) for scale in range(5)]
    df = spark.createDataFrame(cells, "split int, confidence int, disagreement int, scale int, n long, bits double")
    assert [(r.confidence, r.scale, r.support, r.train, r.holdout) for r in control.compile_rules(df).collect()] == [(1, 4, 200_000, 500.0, 100.0)]
    assert control.compile_rules(df, support=30, gain=1.0).count() == 2
