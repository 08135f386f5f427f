"""Queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.llm import lines, mixing, names, pairs, quality, splitting, tokens
from quarrylight.session import table as T

_WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def _fold(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{_WHITE}', ' ', 'g')))"


QUERIES = {
    "p1_found": lambda s, d: splitting.split_ids(T(s, d, "chunks"), T(s, d, "chunk_limits"), T(s, d, "common_words")),
    "p1_pieces": lambda s, d: splitting.split_chunks(T(s, d, "chunks"), T(s, d, "chunk_limits"), T(s, d, "common_words")),
    "p1_reassembled": lambda s, d: splitting.reassembled(T(s, d, "chunks"), T(s, d, "chunk_limits"), T(s, d, "common_words")),
    "p3_found": lambda s, d: names.same_pairs(T(s, d, "entities")),
    "p3_classes": lambda s, d: names.classes(T(s, d, "entities")),
    "p4_found": lambda s, d: pairs.defects(T(s, d, "eval_samples"), T(s, d, "eval_results"), T(s, d, "common_words")),
    "p6_found": lambda s, d: lines.repeated_line_numbers(T(s, d, "chunks")),
    "p6_lines": lambda s, d: lines.repeated_lines(T(s, d, "chunks")),
    "p6_boilerplate": lambda s, d: lines.boilerplate(T(s, d, "chunks")),
    "p6_cleaned": lambda s, d: lines.without_repeated_lines(T(s, d, "chunks")),
    "p7_ids": lambda s, d: tokens.encode_documents(T(s, d, "documents")),
    "p7_decoded": lambda s, d: tokens.decode_documents(tokens.encode_documents(T(s, d, "documents"))).select("doc_id", F.md5("text").alias("text_md5")),
    "p8_mix": lambda s, d: mixing.mix(T(s, d, "documents"), T(s, d, "mix_targets"))[0],
    "p8_shares": lambda s, d: mixing.mix(T(s, d, "documents"), T(s, d, "mix_targets"))[1],
    "p8_balance": lambda s, d: mixing.balance(T(s, d, "documents"), T(s, d, "mix_targets")),
    "p8_tempered": lambda s, d: mixing.mix(T(s, d, "documents"), T(s, d, "mix_targets"), of_all=1.0)[0],
    "p8_tempered_shares": lambda s, d: mixing.mix(T(s, d, "documents"), T(s, d, "mix_targets"), of_all=1.0)[1],
    "p9_found": lambda s, d: quality.not_prose(T(s, d, "documents"), T(s, d, "common_words")),
    "p9_stats": lambda s, d: quality.typed(T(s, d, "documents"), T(s, d, "common_words")),
    "p9_figures": lambda s, d: quality.typed(T(s, d, "documents"), T(s, d, "common_words")).select("doc_id", "n_words", F.round("mean_word_length", 6).alias("mean_word_length")),
}

_LINES = f"""lines AS (
  SELECT chunk_id, ticker, "date", text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
  FROM chunks WHERE chunk_id IS NOT NULL AND ticker IS NOT NULL AND text IS NOT NULL
), folded AS (
  SELECT chunk_id, ticker, "date", text, line_no, {_fold("line")} AS line FROM lines WHERE regexp_matches(line, '\\p{{L}}')
)"""

ORACLES = {
    "p1_found": "SELECT DISTINCT chunk_id FROM chunks JOIN chunk_limits USING (chunk_type) WHERE length(text) > max_chars",
    "p1_reassembled": "SELECT DISTINCT chunk_id, md5(text) AS text_md5, length(text) AS n_chars, TRUE AS within_limit, TRUE AS overlap_kept FROM chunks JOIN chunk_limits USING (chunk_type) WHERE length(text) > max_chars",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p8_balance": "SELECT source, TRUE AS within_repeats, TRUE AS near_target FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE text <> '')",
    "p9_figures": f"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^{_WHITE[1:-2]}]+')), 0) AS n_words, round(list_avg(list_transform(regexp_extract_all(text, '[^{_WHITE[1:-2]}]+'), lambda x: length(x))), 6) AS mean_word_length FROM documents",
    "p6_found": f"""WITH {_LINES}, hit AS (SELECT ticker, line FROM folded GROUP BY ALL HAVING count(DISTINCT chunk_id) >= 5)
        SELECT DISTINCT chunk_id, line_no FROM folded JOIN hit USING (ticker, line)""",
    "p6_lines": f"""WITH {_LINES}, one AS (
          SELECT ticker, line, chunk_id, count(*) AS n FROM folded GROUP BY ALL)
        SELECT f.ticker, f.line, count(DISTINCT f.chunk_id) AS n_chunks, count(DISTINCT {_fold("f.text")}) AS n_clusters, count(DISTINCT f."date") AS n_dates
        FROM folded f GROUP BY ALL HAVING count(DISTINCT f.chunk_id) >= 5""",
    "p6_boilerplate": f"""WITH {_LINES} SELECT ticker, line, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT {_fold("text")}) AS n_clusters, count(DISTINCT "date") AS n_dates
        FROM folded GROUP BY ALL HAVING n_clusters >= 5 AND n_dates >= 2""",
    "p6_cleaned": f"""WITH {_LINES}, hit AS (SELECT ticker, line FROM folded GROUP BY ALL HAVING count(DISTINCT chunk_id) >= 5),
        gone AS (SELECT chunk_id, list(DISTINCT line_no) AS nos FROM folded JOIN hit USING (ticker, line) GROUP BY ALL),
        latest AS (SELECT chunk_id, arg_max({{'ticker': ticker, 'text': text}}, coalesce(epoch_us(ingested_at), 0)) AS r FROM chunks WHERE chunk_id IS NOT NULL GROUP BY ALL)
        SELECT chunk_id, r.ticker AS ticker, CASE WHEN nos IS NULL THEN r.text ELSE array_to_string(list_filter(string_split(r.text, chr(10)), lambda x, i: NOT list_contains(nos, i)), chr(10)) END AS clean_text,
          CAST(CASE WHEN nos IS NULL OR r.text IS NULL THEN 0 ELSE len(nos) END AS INTEGER) AS n_removed
        FROM latest LEFT JOIN gone USING (chunk_id)""",
}
