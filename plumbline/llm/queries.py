"""The registered queries of the training-data operators and the SQL that some have."""

from __future__ import annotations

from .chat_format import op9_chat_format
from .decontaminate import op6_decontaminate
from .html_extract import op8_html_extract
from .language_model import op2_lm_score
from .license_scan import op5_license_scan
from .packing import op4_best_fit_packing
from .quality_classifier import op1_quality_classifier
from .quality_rules import op7_quality_rules
from .sharding import op10_sharding
from .simhash import op3_simhash_near_dedup

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_lm_score": op2_lm_score,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_license_scan": op5_license_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extract": op8_html_extract,
    "op9_chat_format": op9_chat_format,
    "op10_sharding": op10_sharding,
}

#: DuckDB SQL for what SQL can express on whole tables.
ORACLE = {
    "op9_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), one AS (
            SELECT *, length(role) + length(text)
                + length(role) - length(replace(role, chr(10), '')) + length(role) - length(replace(role, chr(10), ''))
                + len(regexp_extract_all(role, '<\\*n?\|')) + len(regexp_extract_all(text, '<\\*n?\|'))
                + length('<|im_start|>') + length('<|im_end|>') + 2 AS chars
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM one GROUP BY conv_id
    """,
}
