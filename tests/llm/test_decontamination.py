"""FM-index and decontamination against plain search."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tidewell.llm import decontamination, fm_index, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, width=10):
    known = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            known.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in known}
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := known.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_what_a_scan_finds(seed):
    rnd = np.random.default_rng(seed)
    largest = int(rnd.choice([1, 2, 5, 40]))
    sequence = np.concatenate([[0], rnd.integers(0, largest + 1, 400), [0]])
    if seed == 5:
        sequence[1:400] = 1
    order = fm_index.suffix_order(sequence)
    zeros = np.cumsum(sequence == 0)
    shown = [tuple((0, int(zeros[j])) if sequence[j] == 0 else (1, int(sequence[j])) for j in range(i, len(sequence))) for i in range(len(sequence))]
    assert order.tolist() == sorted(range(len(sequence)), key=lambda i: shown[i])
    index = fm_index.FMIndex(sequence, largest)
    sizes = rnd.integers(1, 6, 60)
    patterns = np.zeros((60, 5), np.int64)
    for p, n in zip(patterns, sizes, strict=True):
        p[:n] = rnd.integers(1, largest + 1, n)
    low, high = index.search(patterns, sizes)
    for p, n, a, b in zip(patterns, sizes, low, high, strict=True):
        want = [i for i in range(len(sequence) - n + 1) if (sequence[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_op12(spark, sf_dir):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    want = plain(docs, items)
    assert any(r[2] for r in want)
    assert got(queries.op12_benchmark_decontamination(spark, sf_dir)) == want
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert sorted(duckdb.sql(queries.DECONTAMINATION_SQL).fetchall(), key=str) == want


def odd(seed):
    rnd = random.Random(seed)
    some = ["a", "b", "c", "É", "日", "x1", "z", "q"]

    def text(n):
        return "".join(rnd.choice(some) + rnd.choice([" ", ", ", "\n", "-", "_", "\0"]) for _ in range(n))

    items = [(i, text(rnd.choice([0, 2, 3, 9, 10, 11, 25]))) for i in range(12)] + [(None, "hello there"), (3, "hello"), (7, None), (8, "")]
    items += [(100 + i, items[11][1] or "a b c") for i in range(30)]  # copies of an item
    docs = [(i, text(rnd.choice([0, 1, 5, 40, 300])) + (rnd.choice(items)[1] or "") + text(3)) for i in range(40)]
    docs += [(None, "HELLO there hello"), (1, None), (1, ""), (2, "...!"), (5, "hello"), (5, "hello")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"WINDOWS": 7}, {"INDEXED": 16, "SHARD": 200}])
def test_odd_texts(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(decontamination, name, value)
    docs, items = odd(len(limits))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n_words int")
    found = decontamination.contaminations(frame, spark.createDataFrame(items, "item_id long, text string"))
    want = plain(docs, items)
    assert got(decontamination.report(found)) == want
    left = plain([(r.doc_id, r.text) for r in decontamination.cleaned(found).collect()], [])
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in left) == sorted((r[0] is None, r[0] or 0, r[1] - r[2]) for r in want)


def test_spans_are_the_bytes_of_the_words(spark):
    docs = spark.createDataFrame([(1, "É hello, THERE\nyou  hello there"), (2, "there hello")], "doc_id long, text string")
    found = decontamination.contaminations(docs, spark.createDataFrame([(1, "hello there")], "item_id long, text string"))
    rows = {r.doc_id: r for r in decontamination.cleaned(found).collect()}
    assert [(s.first, s.after, s.from_byte, s.to_byte) for s in rows[1].spans] == [(1, 3, 3, 15), (4, 6, 21, 32)]
    assert rows[1].text == "É \nyou  " and rows[2].text == "there hello" and not rows[2].spans


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{i} long, text string") for i in ("doc_id", "item_id"))
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert got(decontamination.report(decontamination.contaminations(docs, items))) == []
    assert got(decontamination.report(decontamination.contaminations(one, items))) == plain([(1, "a b")], [])
