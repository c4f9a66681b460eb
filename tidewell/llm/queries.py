"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import alignment, byte_bpe, chat, decontamination, licenses, main_text, merkle, neighbours, ngram_join, packing, quality, substrings, token_counts
from tidewell.llm.stored import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(text).alias("text"))
    chats = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))
    read = chat.masked(chat.read_chats(chats))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(stored(packing.checksums(cut)))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment_report(table(spark, sf_dir, "documents"), *paths)


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_html_extraction": op3_html_extraction,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_license_scans": op10_license_scans,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_benchmark_decontamination": op12_benchmark_decontamination,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: The exact containment in every window, without MinHash retrieval.
LICENSE_SQL = f"""
WITH known(template, size, width, shingle) AS (
    VALUES {", ".join(f"('{t}', {n}, {w}, '{s}')" for t, n, w, s in licenses.template_shingles(licenses.TEMPLATES))}
),
totals AS (SELECT template, count(*) AS wanted FROM known GROUP BY template),
docs AS (
    SELECT doc_id, row_number() OVER () AS row,
           list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words
    FROM documents
),
places AS (SELECT doc_id, row, words, unnest(range(len(words))) AS i FROM docs),
shingles AS (
    SELECT doc_id, row, i, w.width, array_to_string(words[i + 1 : i + w.width], ' ') AS shingle
    FROM places, (SELECT DISTINCT width FROM known) AS w
    WHERE i + w.width <= len(words) AND words[i + 1] IN (SELECT DISTINCT split_part(shingle, ' ', 1) FROM known)
),
hits AS (SELECT s.*, k.template, k.size FROM shingles AS s JOIN known AS k ON s.width = k.width AND s.shingle = k.shingle),
windows AS (
    SELECT doc_id, row, template, shingle, (i // size - back) * size AS first_word
    FROM hits, (VALUES (0), (1)) AS b(back)
    WHERE i // size >= back AND i + width <= (i // size - back) * size + 2 * size
),
held AS (SELECT doc_id, row, template, first_word, count(DISTINCT shingle) AS n FROM windows GROUP BY ALL)
SELECT doc_id, template, max(n / wanted) AS share, CAST(min(first_word) AS INTEGER) AS first_word
FROM held JOIN totals USING (template)
WHERE 100 * n >= {licenses.PERCENT} * wanted
GROUP BY doc_id, row, template
"""

def plain_words_sql(table: str) -> str:
    """Words of letters, digits and characters beyond ASCII, A-Z as a-z."""
    return f"""
    SELECT row_number() OVER () AS row, *, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM {table}"""


#: Every window of every size looked up in every document.
DECONTAMINATION_SQL = f"""
WITH docs AS ({plain_words_sql("documents")}), items AS ({plain_words_sql("benchmark")}),
windows AS (
    SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(len(words), {decontamination.WIDTH}) AS size,
           array_to_string(words[i + 1 : i + {decontamination.WIDTH}], ' ') AS phrase
    FROM (SELECT *, unnest(range(greatest(len(words) - {decontamination.WIDTH}, 0) + 1)) AS i FROM items WHERE len(words) > 0)
),
places AS (
    SELECT row, i, size, array_to_string(words[i + 1 : i + size], ' ') AS phrase
    FROM (SELECT *, unnest(range(len(words))) AS i FROM docs), (SELECT DISTINCT size FROM windows)
    WHERE i + size <= len(words) AND words[i + 1] IN (SELECT split_part(phrase, ' ', 1) FROM windows)
),
found AS (SELECT row, i, p.size, item FROM places AS p JOIN windows AS w ON p.size = w.size AND p.phrase = w.phrase),
hits AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT row, i, size FROM found)) GROUP BY row),
held AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN held USING (row)
"""


def leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    each = [f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || {f} END" for f in fields]
    return f"sha256({' || '.join(each)})"


def walk_sql(nodes: str, group: str) -> str:
    """One step up a tree: the siblings joined to the proof, the node folded with them."""
    return f"""
    SELECT w.row, w.rank, w.level + 1, w.place // 3,
           w.proof || coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place <> w.place), ''),
           sha256(string_agg(CASE WHEN x.place = w.place THEN w.folded ELSE x.digest END, '' ORDER BY x.place))
    FROM walk_{nodes} AS w JOIN {nodes} AS x ON {group} AND x.level = w.level AND x.place // 3 = w.place // 3
    WHERE x.n > 1
    GROUP BY w.row, w.rank, w.level, w.place, w.proof, w.folded"""


#: The CRC-32 of the decimal doc_id, bit by bit (fixed values: the polynomial and the mask of 32 bits).
CRC_SQL = """xor(4294967295, list_reduce(
    list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT for c in string_split(doc_id::VARCHAR, '')]),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)::UBIGINT[]),
        lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)))"""

#: The two trees level by level, and every row's way up.
MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {leaf_sql("text")} AS leaf,
           CASE WHEN {CRC_SQL} % 2 = 0 THEN {leaf_sql("replace(text, chr(10), '')")} END AS changed
    FROM documents
),
placed AS (
    SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS rank,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
    FROM leaves
),
below AS (
    SELECT rank, 0 AS level, place, leaf AS digest, n FROM placed
    UNION ALL
    SELECT rank, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3
    FROM below WHERE n > 1 GROUP BY rank, level, place // 3, n
),
subroots AS (SELECT rank, digest AS subroot FROM below WHERE n = 1),
above AS (
    SELECT 0 AS level, rank AS place, subroot AS digest, (SELECT count(*) FROM subroots) AS n FROM subroots
    UNION ALL
    SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM above WHERE n > 1 GROUP BY level, place // 3, n
),
walk_below AS (
    SELECT row, rank, 0 AS level, place, '' AS proof, coalesce(changed, leaf) AS folded FROM placed
    UNION ALL{walk_sql("below", "x.rank = w.rank")}
),
walk_above AS (
    SELECT row, rank, 0 AS level, rank AS place, proof, folded FROM walk_below
    WHERE (rank, level) IN (SELECT (rank, level) FROM below WHERE n = 1)
    UNION ALL{walk_sql("above", "true")}
)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM placed JOIN walk_above AS w USING (row) JOIN above AS a ON a.n = 1 AND a.level = w.level JOIN subroots ON subroots.rank = placed.rank
"""

ORACLES: dict[str, str] = {"op10_license_scans": LICENSE_SQL, "op12_benchmark_decontamination": DECONTAMINATION_SQL, "op13_merkle_manifest": MERKLE_SQL}
