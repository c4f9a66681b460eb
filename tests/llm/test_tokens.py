"""Tokens and packing against the libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewell.llm import byte_bpe, packing, queries, token_counts

PIECES = (
    "a b é É İ Σ 's 'LL 1 ２ <|endoftext|> <|startoftext|> !! . , ß 日本 👍🏽 the ª Ⅷ <s> </s> <0x0A> ▁ naïve THE".split()
    + [" ", "  ", "\n", "\t", " \n", "　", " ", "\u0085", "\x1c", "\0", "\r\n", "é", "​", " of", "́"]
)


def fuzz(seed, n=3000):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(PIECES, k=rnd.randint(0, 25))) for _ in range(n)]


def texts(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()


def test_counts_like_the_library(sf_dir):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    some = fuzz(1) + [t for _, t in texts(sf_dir)]
    want = [len(x) for x in model.encode(some, num_threads=1)]
    assert token_counts.Counts(path).of(some) == want
    assert token_counts.Counts(path, kept=16_000).of(some) == want  # the table is emptied on the way


def test_byte_bpe_like_the_library(sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), byte_bpe.Codec(path, kept=500)
    some = fuzz(2) + [t for _, t in texts(sf_dir)] + ["ab" * 5000]
    for text, want in zip(some, library.encode_batch(some, add_special_tokens=False), strict=True):
        ids = np.frombuffer(own.encode(text), "<i4").tolist()
        assert ids == want.ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    cut = [ids for ids in ([50_000, 200], [-1, 99_999], [])]
    assert [own.decode(ids) for ids in cut][1:] == ["", ""]


def test_word_tokens_like_the_library(sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.Tokens(path, kept=300)
    some = fuzz(3) + [t for _, t in texts(sf_dir)]
    for text, want in zip(some, library.encode_batch(some, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.of(text.encode()), "<u4").tolist() == want.ids


def test_byte_pieces_of_a_group_are_merged_once(sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), byte_bpe.Codec(path, kept=2)
    special = next(iter(own.special))
    some = ["", " ", "a", " zqxjk  zqxjk vbnwq ", f"zqxjk vbnwq{special} vbnwq", "x\n\ny \n zqxjk", "vbnwq zqxjk vbnwq zqxjk plmvt qqjzx"] * 3
    for part in (some, [""], [], [" a "]):
        found = own.encode_each(pa.array(part, pa.string()))
        assert [np.frombuffer(x, "<i4").tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in part]
    assert own.encode_each(pa.array(some).slice(2, 9)) == own.encode_each(pa.array(some))[2:11]
    merged, merge = Counter(), own.merge
    own = byte_bpe.Codec(path, kept=2)
    own.merge = lambda piece: merged.update([piece]) or merge(piece)
    own.encode_each(pa.array(["zqxjk vbnwq plmvt", "plmvt qqjzx vbnwq", "zqxjk qqjzx plmvt"]))
    assert merged and max(merged.values()) == 1


def test_words_of_a_group_are_put_together_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.Tokens(path, kept=2)
    made, many = Counter(), own.many
    own.many = lambda letters: made.update(letters) or many(letters)
    some = ["Zqxjk, zqxjk! ZQXJK vbnwq.", "", " \t", "vbnwq;; Éa éA İx x×y a-b zqxjk", "vbnwq\x1cq don't ẞ 1.5, Zqxjk?"]
    found = own.of_each(pa.array(some))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert made["zqxjk"] == made["vbnwq"] == made["éa"] == 1
    assert own.of_each(pa.array(some).slice(1, 3)) == found[1:4] and own.of_each(pa.array([], pa.string())) == []


ODD = [(1, None, 9), (1, None, 9), (2, "", 9), (None, "a b", 9), (3, "  x ", 9), (4, "word " * 9000, 9)]


def test_op5_and_op9(spark, sf_dir):
    import sentencepiece

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = texts(sf_dir)
    got = {r.doc_id: tuple(r) for r in queries.op5_byte_bpe(spark, sf_dir).collect()}
    count = {r.doc_id: tuple(r) for r in queries.op9_token_counts(spark, sf_dir).collect()}
    assert len(got) == len(count) == len(rows)
    for (d, t), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True):
        assert got[d] == (d, len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        n = len(model.encode(t))
        assert count[d] == (d, len(t.encode()), n, n > 4096)


def test_tokens_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, ids int")
    bpe, count = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = byte_bpe.decode(byte_bpe.encode(docs, bpe, into="found"), bpe, "found", "back").collect()
    assert [(r.doc_id, r.back, r.ids) for r in got] == [(d, t or "", x) for d, t, x in ODD]
    assert got[0].found == []
    assert [tuple(r) for r in token_counts.token_report(docs, count).collect()][:3] == [(1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False)]
    for frame in (byte_bpe.encode(docs.limit(0), bpe), token_counts.token_report(docs.limit(0), count)):
        assert frame.count() == 0


def whole(rows, capacity):
    """Checks that every sequence is filled without gaps; the number of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op4(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op4_best_fit_packing(spark, sf_dir).collect()
    by = defaultdict(dict)
    for r in got:
        by[r.doc_id][r.piece] = r
    total = 0
    for d, t in texts(sf_dir):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        assert [by[d][k].ids_crc32 for k in range(len(by[d]))] == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]
        assert [(by[d][k].start, by[d][k].length) for k in range(len(by[d]))] == [(a, min(2048, len(ids) - a)) for a in range(0, len(ids), 2048)]
    assert whole(got, 2048) <= -(-total // 2048) + 1


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, slice int")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(packing.checksums(packing.pieces(docs, path, 64)), 64).collect()
    assert whole(got, 64) and sum(r.length for r in got if r.doc_id == 1) == 2
    assert packing.pack(packing.checksums(packing.pieces(docs.limit(0), path)), 64).count() == 0


def test_numbering_splits_a_common_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 100)
    rows = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 3 = 0, 700L, 300L + id % 7) AS length", "5 AS slice")
    # three lengths of 700 do not fit, nor do seven of about 300: weights of 1/3 and 1/6 bound the number from below
    bound = 1000 / 3 + 2000 / 6
    assert bound <= whole(packing.pack(rows.drop("slice"), 2048).collect(), 2048) <= bound + 10


def test_slices_are_asked_for_once_a_stage(spark):
    rows = spark.createDataFrame([(i, 0, 0, n) for i, n in enumerate([5, 5, 2000, 48, 7])], "doc_id long, piece int, start long, length long")
    packed = packing.pack(rows.repartition(3), 2048)
    # one for the sizes, one for the numbering, and the places; a second call in a stage takes a second Python worker for every core
    assert packed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 3
    assert whole(packed.collect(), 2048) == 2


@pytest.mark.parametrize("seed", range(4))
def test_plan_needs_few_sequences(seed):
    rnd = random.Random(seed)
    counts = defaultdict(int)
    for _ in range(rnd.choice([300, 5000, 40_000])):
        counts[rnd.choice([2048, rnd.randint(1, 2048), rnd.randint(1, 300), 700])] += 1
    rows, n = packing.plan(counts)
    used = defaultdict(int)
    filled = defaultdict(int)
    for length, first, times, sequence, offset in rows:
        assert first == used[length]
        used[length] += times
        filled[sequence] += length
        assert offset + length <= 2048
    assert used == {k: v for k, v in counts.items() if v}
    assert n <= 1.002 * sum(k for _, k in packing.best_fit(dict(counts), 2048)) + 1


def test_program_places_most_pieces():
    rnd = random.Random(5)
    counts = defaultdict(int)
    for _ in range(12_000):
        counts[min(2048, max(1, int(rnd.lognormvariate(6, 1))))] += 1
    out, left = packing.rounded(dict(counts), 2048, 2)
    placed = defaultdict(int)
    for pattern, times in out:
        assert 2046 <= sum(pattern) <= 2048
        for n in pattern:
            placed[n] += times
    assert {n: c for n, c in counts.items() if c} == {n: placed[n] + left.get(n, 0) for n in counts}
    assert sum(left.values()) < 0.1 * sum(counts.values())
    assert packing.plan(counts)[1] <= sum(n * c for n, c in counts.items()) // 2048 + 2
    # lengths of which no pattern fills a sequence are covered too
    uses = packing.fractional(np.array([700, 1100]), np.array([50, 30]), 2048)
    assert [sum(p.get(i, 0) * x for p, x in uses) for i in (0, 1)] == pytest.approx([50, 30])
    assert packing.plan({700: 50, 1100: 30})[1] == 40
