"""The pipeline stage by stage against plain versions, and the package without it."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tidewell.llm import quality


def test_pipeline(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    good = {r.doc_id for r in quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("kept").collect()}
    rows = [r for r in rows if r[0] in good]
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, brute.near_copies(rows), strict=True) if d == c]
    cleaned = brute.without_repeats(rows)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t in rows:
        n = len(library.encode(cleaned[d, t][2], add_special_tokens=False).ids) + 1
        want.update((d, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048)))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == want
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 2048) + 1


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "one two", "y"), (3, "good words " + " ".join(f"w{i}" for i in range(60)), None)]
    docs = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, kept string").selectExpr("*", "1 AS component")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, "")
            assert out.columns == docs.columns
            n = out.count()
            assert n <= given.count()
        docs_out = stage(spark, docs, "").collect()
        assert any(r.doc_id == 3 and r.text.startswith("good") for r in docs_out)


def test_package_imports_without_the_subpackage(tmp_path):
    root = Path(corpus_pipeline.__file__).parent
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tidewell.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries()) and len(e.queries()) > 100
"""
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
