"""Near copies, repeated passages, quality rules and licenses against plain versions."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm import brute
from tidewell.llm import licenses, ngram_join, pairing, quality, queries, substrings, words
from tidewell.llm.words import count_words, name_texts, spans

SCHEMA = "doc_id long, text string"
ODD = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (3, "One"), (3, "one"), (None, "x y"), (None, None), (4, "a" * 5000 + " " + "é " * 50)]


def variants(seed, n=150):
    """Texts cut from a few bases, with edits, repeated rows, NULL ids and repeated ids."""
    rnd = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(120)]
    bases = [rnd.choices(vocabulary, k=rnd.choice([3, 8, 40, 90])) for _ in range(8)]
    rows = []
    for i in range(10, n):
        text = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            at = rnd.randrange(len(text) + 1)
            text[at : at + rnd.choice([0, 1])] = [rnd.choice(vocabulary)] * rnd.choice([0, 1, 1])
        if rnd.random() < 0.2:
            text += rnd.choice(bases)
        text = " ".join(text)
        rows.append((None if i % 23 == 0 else i, text.lower() if rnd.random() < 0.2 else text))
    return rows + [rows[3], (rows[4][0], "another text of that id"), *ODD]


def documents(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()


def test_words():
    texts = ["a  b\tc\x0b\x0cd\r\ne", "", "é x y", " lead", "trail "]
    raw = [t.encode() for t in texts]
    names, counts = name_texts(raw)
    assert counts.tolist() == count_words(raw).tolist() == [len(t.split()) for t in raw]
    by_word = dict(zip([w for t in raw for w in t.split()], names.tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word)
    upper, _ = name_texts([b"ABC \xc3\x89 xY"], lower=True)
    assert upper.tolist() == name_texts([b"abc \xc3\x89 xy"])[0].tolist()


def test_words_longer_than_a_block(monkeypatch):
    text = b"x" * 2_500_000 + b" tail " + b"y" * 1_048_576
    names, start, end = spans(text)
    assert [text[a:b] for a, b in zip(start, end, strict=True)] == text.split()
    assert names[1] == spans(b"tail")[0][0] and len(set(names.tolist())) == 3


def test_names_do_not_depend_on_the_block(monkeypatch):
    assert words._UP.nbytes + words._DOWN.nbytes < 1 << 23  # every worker holds these
    text = b" one two\tthree " * 50 + b"z" * 1000 + b" end"
    want = spans(text)
    for block in (7, 64, 1 << 12):
        monkeypatch.setattr(words, "BLOCK", block)
        for got, whole in zip(spans(text), want, strict=True):
            assert got.tolist() == whole.tolist()


@pytest.mark.parametrize("rows", [variants(1), ODD, []], ids=["variants", "odd", "empty"])
def test_near_copies(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS class", "1 AS n", "2L AS component")
    got = Counter(tuple(r) for r in ngram_join.near_copies(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter(brute.near_copies(rows))


def test_near_copies_in_all_orders():
    tokens = sorted({i * 7919 for i in range(1, 60)})
    import numpy as np

    tokens = np.array(tokens, np.uint64)
    orders = ngram_join.Orders(tokens[5:9], np.array([3, 9, 4, 5]))
    for which in range(3):
        assert not set(orders.prefix(tokens, 30, which).tolist()) & set(tokens[5:9].tolist())
    assert orders.prefix(tokens, len(tokens), 0)[-1] == tokens[6]
    for a, b in ((tokens, tokens[:50]), (tokens[:3], tokens), (tokens[:40], tokens[20:])):
        assert ngram_join.least_difference(ngram_join.signature(a), ngram_join.signature(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_op2(spark, sf_dir):
    got = Counter(tuple(r) for r in queries.op2_ngram_jaccard_join(spark, sf_dir).collect())
    assert got == Counter(brute.near_copies(documents(sf_dir)))


PERIODIC = [(500, " ".join("a" for _ in range(70))), (501, " ".join(["a", "b", "c"] * 12)), (502, " ".join(["x", "a", "b", "c"] * 7))]


@pytest.mark.parametrize("rows", [variants(2) + PERIODIC, ODD, []], ids=["variants", "odd", "empty"])
def test_substring_dedup(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "'k' AS kept", "5 AS n_chars", "7 AS copy")
    want = brute.without_repeats(rows)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs).collect())
    assert got == Counter((d, *want[d, t or ""]) for d, t in rows)
    cleaned = substrings.cleaned(docs)
    assert cleaned.columns == docs.columns
    found = cleaned.collect()
    assert all((r.n_chars, r.kept) == (None if r.text is None else len(r.text), "k") for r in found)
    plain = Counter((r.doc_id, b" ".join(brute.words(r.text)).decode()) for r in found)
    assert plain == Counter((d, want[d, t or ""][2]) for d, t in rows)
    untouched = Counter((d, t) for d, t in rows if not want[d, t or ""][1])
    assert untouched <= Counter((r.doc_id, r.text) for r in found)


def test_what_stays_of_a_text_stays_as_it_was(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(1, f"A para.\n\nB para two.\n- item  {passage}\nend"), (2, f"x\n\n  {passage} tail\n\ty"), (3, passage), (4, "- a\n- b\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.cleaned(docs).collect()}
    assert got == {1: rows[0][1], 2: "x\n\n  tail\n\ty", 3: "", 4: rows[3][1]}


def test_op8(spark, sf_dir):
    import hashlib

    rows = documents(sf_dir)
    want = brute.without_repeats(rows)
    got = Counter(tuple(r) for r in queries.op8_substring_dedup(spark, sf_dir).collect())
    assert got == Counter((d, *want[d, t][:2], hashlib.sha256(want[d, t][2].encode()).hexdigest()) for d, t in rows)


def test_quality(spark, sf_dir):
    rows = variants(3) + documents(sf_dir) + [(900, "a b c d e\n" * 9), (901, "##$ %& " + "w " * 30)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_words", "2 AS measures")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality(docs).collect())
    assert got == Counter((d, *brute.measures(t).values()) for d, t in rows)
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    n = quality.quality(docs).filter("kept").count()
    assert kept.count() == n and 0 < n < len(rows)
    assert quality.quality(docs.limit(0)).count() == quality.filtered(docs.limit(0)).count() == 0


def test_quality_keeps_good_and_drops_bad(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id")
    good, bad = (kept.filter(f"quality = {q} AND n_words >= 10 AND NOT base_failed").selectExpr("avg(int(kept))").first()[0] for q in (1, 0))
    assert good > 0.95 and bad < 0.7


def test_licenses(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = Counter(tuple(r) for r in queries.op10_license_scans(spark, sf_dir).collect())
    assert got == Counter(con.execute(queries.LICENSE_SQL).fetchall()) and got


def test_licenses_in_odd_texts(spark):
    mit = licenses.TEMPLATES["mit-grant"]
    cut = " ".join(mit.split()[:-12])  # more than 80 percent of the shingles
    rows = [*ODD, (20, "filler " * 40 + mit.upper().replace(" ", "\n") + " more"), (21, cut), (22, " ".join(mit.split()[::2])), (23, "ALL rights, reserved")]
    docs = spark.createDataFrame(rows + rows[-1:], SCHEMA).selectExpr("*", "1 AS row", "2 AS size", "'t' AS template")
    got = sorted((r.doc_id, r.template, r.share == 1, r.first_word) for r in licenses.scan(docs).collect())
    assert got == [(20, "mit-grant", True, 0), (21, "mit-grant", False, 0), (23, "all-rights-reserved", True, 0), (23, "all-rights-reserved", True, 0)]
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, {}).count() == 0


def test_a_hot_token_is_no_window(spark):
    rows = [(t, c, 10, t, c) for t in (1, 2, 3) for c in range(40) if t < 3 or c == 5]
    found = spark.createDataFrame([(*r, r[0] == 2) for r in rows + rows[:7] + rows[50:60]], f"{ngram_join.MET}, often boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # tokens go on from batch to batch
    try:
        met = spark.createDataFrame(ngram_join.meeting(found).collect(), ngram_join.MET)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(tuple(r) for r in met.collect()) == Counter(r for r in rows if r[0] < 3)
    pairs = ngram_join.hub_pairs(met, 80)
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, c) for c in range(1, 40)}
    assert "Window" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def group_of_copies(n, words, seed, base=True, others=()):
    """Texts that differ from one text in a few words each, which are mostly too far from each other to link."""
    rnd = random.Random(seed)
    start = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(start)] if base else []
    for i in range(n):
        mine = list(start)
        for k in rnd.sample(range(words), 1 + i % 3):
            mine[k] = f"x{i}y{k}"
        out.append(" ".join(mine))
    return [*out, *others]


@pytest.mark.parametrize("base", [True, False])
def test_large_groups_make_few_pairs(spark, monkeypatch, base):
    made = []
    real = ngram_join.linked
    monkeypatch.setattr(ngram_join, "linked", lambda pairs, *rest: made.append(pairs.count()) or real(pairs, *rest))
    rows = list(enumerate(group_of_copies(600, 60, 3, base, [t for _, t in ODD])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.near_copies(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter(brute.near_copies(rows))
    assert sum(made) <= 10 * len(rows)


@pytest.mark.parametrize("most", [4096, 16])
def test_pairs_in_tasks_are_all_that_can_link(spark, monkeypatch, most):
    """Against every two rows of a token, with groups in blocks and in more than one batch."""
    monkeypatch.setattr(pairing, "PAIRS", 100)
    rnd = random.Random(most)
    bases = [rnd.sample(range(10**6), n) for n in (5, 30, 60, 300)]
    sets = {c: np.unique(np.array([x if rnd.random() > 0.1 else rnd.randrange(10**6) for x in bases[c % 4]], np.uint64)) for c in range(150)}
    rows = [
        (t, c, c // 3, len(s), rnd.randrange(3), ngram_join.folded(ngram_join.signature(s), 32)) for c, s in sets.items() for t in {1, 2 + c % 2, 100 + c}
    ]
    want = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] < y[1] and x[2] != y[2]:
                n, rest = x[3] + y[3], min(x[3] - x[4], y[3] - y[4])
                near = 180 * ngram_join.least_difference(x[5], y[5]) <= 20 * n
                if near and 180 * rest >= 80 * n and 10 * x[3] >= 8 * y[3] and 10 * y[3] >= 8 * x[3]:
                    want.add((x[1], y[1]))
    frame = spark.createDataFrame(rows, "token long, class long, label long, n int, i int, small binary")
    hot = pairing.hot_tokens(frame, most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        assert {tuple(r) for r in pairing.as_pairs(pairing.pairs_in_tasks(frame, hot, 80, None)).collect()} == want
        best = {tuple(r) for r in pairing.as_pairs(pairing.pairs_in_tasks(frame, hot, 80, 1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 100 < len(want) and best <= want and len(best) <= len(rows) * (1 if most > 150 else 10)
    assert {c for p in best for c in p} == {c for p in want for c in p}
