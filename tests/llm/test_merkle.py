"""The manifest against a plain recursive version."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from tidewell.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def level_up(nodes):
    return [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]


def siblings(nodes, i):
    """Of the leaf i: for each level the digests before and after the node."""
    out = []
    while len(nodes) > 1:
        a = i // 3 * 3
        out.append((nodes[a:i], nodes[i + 1 : a + 3]))
        nodes, i = level_up(nodes), i // 3
    return out, nodes[0]


def manifest(docs):
    groups = {}
    for row in docs:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ways = {}
    for s in order:
        rows = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        leaves = [leaf(r, r[4]) for r in rows]
        ways[s] = [(r, x, *siblings(leaves, i)) for i, (r, x) in enumerate(zip(rows, leaves, strict=True))]
    roots = [ways[s][0][3] for s in order]
    out = []
    for k, s in enumerate(order):
        above, root = siblings(roots, k)
        for row, own, below, subroot in ways[s]:
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded, proof = leaf(row, text), ""
            for left, right in below + above:
                proof += "".join(left + right)
                folded = h(*left, folded, *right)
            out.append((row[0], own, subroot, root, h(proof), folded, folded == root))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, `group` string"


def frame(spark, docs):
    return spark.createDataFrame([(*r, 1, "x") for r in docs], SCHEMA)


def test_op13(spark, sf_dir):
    docs = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{sf_dir}/documents.parquet'").fetchall()
    assert got(queries.op13_merkle_manifest(spark, sf_dir)) == manifest(docs)


@pytest.mark.parametrize("rows, deep", [(20_000, 7), (7, 1), (16, 2)])
def test_odd_rows(spark, monkeypatch, rows, deep):
    """NULLs, repeated rows and ids, one hot group, many small ones, ranges and blocks of a few rows."""
    monkeypatch.setattr(merkle, "ROWS", rows)
    monkeypatch.setattr(merkle, "DEEP", deep)
    rnd = random.Random(rows)
    docs = [(i, "hot", "en", 3, f"a\nb{i}") for i in rnd.sample(range(-50, 1000), 90)] + [(1, "hot", "en", 3, "a\nb")] * 12
    docs += [(i, rnd.choice(["é", "z", "", None, f"s{i % 17}"]), rnd.choice([None, "de"]), rnd.choice([None, 5]), rnd.choice([None, "", "x\ny", "\n", "日本\n"])) for i in range(60)]
    docs += [(None, None, None, None, None), (None, "hot", "en", 1, "q\n"), (4, "hot", None, None, "other")]
    assert got(merkle.manifest(frame(spark, docs))) == manifest(docs)


def test_small_tables(spark):
    assert got(merkle.manifest(frame(spark, []))) == []
    one = [(5, "s", "en", 1, "x\ny")]
    assert got(merkle.manifest(frame(spark, one))) == manifest(one)
    assert manifest(one)[0][1] == manifest(one)[0][3]  # a lone leaf is the root


def test_sql(sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    docs = duckdb.sql("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    assert sorted(duckdb.sql(queries.MERKLE_SQL).fetchall(), key=str) == manifest(docs)


def test_missing_is_minimal():
    """Exactly the siblings on all ways up that do not follow from the leaves."""
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(1, 60)
        some = rnd.sample(range(n), rnd.randint(1, n))
        known, wanted, size, level, want = set(some), set(), n, 0, set()
        while size > 1:
            wanted = {c for i in known for c in range(i // 3 * 3, min(i // 3 * 3 + 3, size))}
            want |= {(level, c) for c in wanted - known}
            known, size, level = {i // 3 for i in known}, -(-size // 3), level + 1
        assert {(at, int(p)) for at, places in merkle.missing(np.array(some), n) for p in places} == want
