"""Token counts by the whole-token shortcut.

A text is cut before every run of spaces. No string of the vocabulary holds a space after another
character (this is checked when the model is loaded), so no merge crosses such a cut and a text has
as many tokens as its pieces. Loading the model also proves which vocabulary strings encode alone as
one token: a piece among them counts 1 without merging. Only the other pieces are merged, by the
library, and their counts are kept in a table of bounded size.

Result: an empty or NULL text has 0 tokens; repeated rows and extra columns stay as they are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.kept import in_worker

MARK = "▁"
KEPT = 800_000
_PIECE = re.compile(" +[^ ]*")


class Counts:
    """Token counts of pieces of text under one sentencepiece model."""

    def __init__(self, path: str, kept: int = KEPT):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a vocabulary string spans two words")
        words = [p[1:] for p in pieces if len(p) > 1 and p[0] == MARK and p[1] != MARK]
        self.whole = {w: 1 for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1}
        self.kept = kept
        self.table = dict(self.whole)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text, each without the one space that the library puts before it."""
        text = text.replace(MARK, " ")  # the library's own sign for a space
        found = text.split(" ")
        return [p[1:] for p in _PIECE.findall(" " + text)] if "" in found else found

    def of(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            found = self.pieces(text)
            table = self.table
            rest = [p for p in dict.fromkeys(found) if p not in table]
            if rest:
                if len(table) + len(rest) > self.kept:
                    self.table = table = dict(self.whole)
                    rest = [p for p in dict.fromkeys(found) if p not in table]
                for at in range(0, len(rest), 4096):
                    part = rest[at : at + 4096]
                    table.update(zip(part, (self.count(p, ids) for p, ids in zip(part, self.model.encode(part, num_threads=1), strict=True)), strict=True))
            out.append(sum(map(table.__getitem__, found)))
        return out

    @staticmethod
    def count(piece: str, ids: list[int]) -> int:
        return len(ids) if piece else 1  # a space alone at the end


@in_worker
def counts(path: str) -> Counts:
    return Counts(path)


def count_tokens(docs: DataFrame, path: str, column: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``column`` in the new column ``into``; one pass, no shuffle."""

    @F.pandas_udf("long")
    def number(texts: pd.Series) -> pd.Series:
        return pd.Series(counts(path).of(texts.tolist()), dtype="int64")

    return docs.withColumn(into, number(F.coalesce(F.col(column), F.lit(""))))


def token_report(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Bytes, tokens and whether these exceed ``limit``, for each row of ``docs`` (doc_id, text)."""
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return count_tokens(text, path).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
