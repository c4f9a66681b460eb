"""Alignment of two tokenizers against a plain version on whole texts."""

import hashlib
from collections import Counter
from types import SimpleNamespace
from unittest.mock import MagicMock

import duckdb
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_tokens import fuzz
from tidewell.llm import alignment, queries
from tidewell.llm.byte_bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Both libraries over whole texts, groups by the ends that both sides have."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.back = {c: b for b, c in byte_letters().items()}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        sides = [[(i, bytes(self.back[c] for c in self.a.id_to_token(i))) for i in a], [(i, self.piece(i)) for i in b]]
        if any(b"".join(s for _, s in side) != (" " + text).encode() for side in sides):
            return []
        ends = [[sum(len(s) for _, s in side[: k + 1]) for k in range(len(side))] for side in sides] if len(text) < 500 else [running(side) for side in sides]
        out, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(end) + 1 for e in ends]
            out.append(tuple([i for i, _ in side[f:t]] for side, f, t in zip(sides, at, to, strict=True)))
            at = to
        return out


def running(side):
    total, out = 0, []
    for _, s in side:
        total += len(s)
        out.append(total)
    return out


def expected(docs):
    plain = Plain()
    found = [(i, plain.groups(t)) for i, t in docs]
    count = Counter((a[-1], b[-1]) for _, groups in found for a, b in groups)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = []
    for i, groups in found:
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return sorted(rows, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_op11(spark, sf_dir):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    assert got(queries.op11_tokenizer_alignment(spark, sf_dir)) == expected(docs)


def test_odd_texts(spark, monkeypatch):
    docs = [*enumerate(fuzz(5, 1200)), (7, "ab\n c"), (7, "ab\n c"), (None, "x y"), (-1, None), (-2, ""), (-3, "a▁b"), (-4, " \t \n  x   y z " * 40)]
    frame = spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id long, text string, links string, pair int")
    want = expected(docs)
    assert got(alignment.alignment_report(frame, A, B)) == want
    both = alignment.Codes(A, B, kept=50)  # generations change on the way
    monkeypatch.setattr(alignment, "BYTES", 64)  # texts fall into blocks
    for i, t in docs:
        (n_a, n_b, groups, links), = both.align([t or ""])
        assert (n_a, n_b, len(links) // 4, hashlib.sha256(groups.encode()).hexdigest() if groups else "") in {(r[1], r[2], r[3], r[7]) for r in want if r[0] == i}


def test_empty_table(spark):
    assert got(alignment.alignment_report(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []


def test_only_suffixes_are_pairs():
    pairs = alignment.suffix_pairs([b"ab", b"b", b"c"], [b"b", b"xab", b"b"])
    assert pairs.tolist() == [0, 1, 2, 3, 4, 5]
    both = alignment.codes(A, B)
    assert len(both.pairs) < 1_000_000


def test_the_second_pass_holds_few_rows_and_no_pieces(spark, monkeypatch):
    links = [[i % 7, 3, i % 7] if i % 5 else [] for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(links, pa.list_(pa.int32()))], names=["doc_id", "links"]).slice(10)
    links = links[10:]
    count = Counter(x for of_text in links for x in of_text)
    found = MagicMock(columns=["doc_id", "links"], schema=[])
    alignment.codes(A, B)
    alignment.link_counts(found)
    counted, = found.select.return_value.mapInArrow.call_args.args[0](iter([batch]))
    assert alignment.codes.cache_info().currsize == 0
    assert dict(zip(*counted.to_pydict().values(), strict=True)) == count

    found.sparkSession.sparkContext.broadcast = lambda value: SimpleNamespace(value=value)
    monkeypatch.setattr(alignment, "link_counts", lambda _: SimpleNamespace(toPandas=lambda: pd.DataFrame({"pair": list(count), "n": list(count.values())})))
    alignment.scored(found, A, B)
    out = list(found.mapInArrow.call_args.args[0](iter([batch])))
    assert alignment.codes.cache_info().currsize == 0
    assert max(b.num_rows for b in out) <= alignment.LOOKED_UP
    rows = pa.Table.from_batches(out).to_pylist()
    assert [(r["doc_id"], r["n_links"], r["count_sum"]) for r in rows] == [(i, len(x), sum(map(count.get, x))) for i, x in enumerate(links, 10)]
