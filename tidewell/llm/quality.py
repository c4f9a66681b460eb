"""Quality rules by repetition coverage.

For each text, rolling polynomial names of word n-grams of several lengths are sorted in numpy; the
characters of words inside n-grams that occur twice or more are measured, and so are those of
repeated lines. A text passes if it meets the base rule (enough words, few repeated five-word
windows) and no measure exceeds its share of the text's characters.

Result: one row for each input row, in one pass without a shuffle. A NULL text is an empty one: no
words, so the base rule fails. Repeated rows are judged alike; other columns are left as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.kept import give_up, trim
from tidewell.llm.words import STEPS, groups, mix, spans, window_names

#: Largest share of a text's word characters inside repeated n-grams, by n.
GRAM_SHARES = {5: 0.25, 7: 0.22, 10: 0.20}
#: Largest shares of characters in repeated lines, of repeated lines, and of symbols to words.
LINE_CHARS, LINE_SHARE, SYMBOL_SHARE = 0.25, 0.40, 0.10
#: Texts taken out of a batch at once.
ROWS = 512
MIN_WORDS, REPEAT_PERCENT, BASE_GRAM = 10, 20, 5
#: Fixed value: the symbols that count as noise.
SYMBOLS = "#*$%&|<>"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"gram_chars_{n}" for n in GRAM_SHARES)
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def repeated(names: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """For each word, whether it lies in a window of ``width`` words found twice or more in its text."""
    out = np.zeros(len(names), bool)
    windows = window_names(names, width, STEPS[0])
    if not len(windows):
        return out
    at = np.flatnonzero(text[: len(windows)] == text[width - 1 :])
    keys = mix(windows[at] + text[at].astype(np.uint64) * np.uint64(STEPS[1]))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(names) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + width, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_lines(text: bytes) -> tuple[int, int, int]:
    """Lines that hold a word, those equal to an earlier line, and the characters of all repeated ones."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    seen: dict[bytes, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    chars = sum(n * len(b"".join(line.split()).decode("utf-8", "replace")) for line, n in seen.items() if n > 1)
    return len(lines), len(lines) - len(seen), chars


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """MEASURES, one array for each column."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    names, start, end = spans(data.tobytes())
    size = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(size) - size
    text = np.searchsorted(first, start, "right") - 1
    n = len(texts)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = lead[end] - lead[start]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    last = np.minimum(first + size - 1, len(data))
    by_text = lambda weights=None: np.bincount(text, weights, n).astype(np.int64)
    lines = np.array([repeated_lines(t) for t in texts], np.int64).reshape(n, 3)
    marks = {w: repeated(names, text, w) for w in {*GRAM_SHARES, BASE_GRAM}}
    return [
        by_text(),
        by_text(chars),
        (symbols[last] - symbols[np.minimum(first, len(data))]).astype(np.int64),
        *lines.T,
        by_text(marks[BASE_GRAM]),
        *(by_text(chars * marks[w]) for w in GRAM_SHARES),
    ]


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def measured(texts: pa.Array) -> pa.Array:
    """The measures of each text as a struct."""
    give_up()
    parts = []
    for at in range(0, len(texts), ROWS):  # a part of the batch at a time, so that its copies are small
        given = [t.as_buffer().to_pybytes() for t in texts.slice(at, ROWS)]
        parts += [measure(given[a:b]) for a, b in groups(given)]
    trim()
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names=MEASURES)


def verdict(prefix: str = "") -> tuple[Column, Column]:
    """Whether the base rule fails and whether the text is kept, from the measures in columns with this prefix."""
    of = lambda name: F.col(prefix + name)
    base_failed = (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > REPEAT_PERCENT * of("n_words"))
    clean = (
        (of("dup_line_chars") <= LINE_CHARS * of("word_chars"))
        & (of("n_dup_lines") <= LINE_SHARE * of("n_lines"))
        & (of("n_symbols") <= SYMBOL_SHARE * of("n_words"))
    )
    for n, share in GRAM_SHARES.items():
        clean &= of(f"gram_chars_{n}") <= share * of("word_chars")
    return base_failed, ~base_failed & clean


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, measures and verdict of every row of ``docs`` (doc_id, text)."""
    found = docs.select("doc_id", measured(F.coalesce("text", F.lit(""))).alias("m")).select("doc_id", "m.*")
    base_failed, kept = verdict()
    return found.select("*", base_failed.alias("base_failed"), kept.alias("kept"))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    _, kept = verdict("measures__.")
    return docs.withColumn("measures__", measured(F.coalesce("text", F.lit("")))).filter(kept).drop("measures__")
