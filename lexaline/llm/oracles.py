"""DuckDB SQL of the queries that SQL can express: the parts of some operators that don't depend on what is learned,
hashed or tokenized. The operators themselves are held against brute force in the tests."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _places(*words: str) -> str:
    held = " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(1, len(w) + 1), lambda i: {held})"


_TRAP = "\\### Assistant: </turn> ok"

ORACLES: dict[str, str] = {
    "llm_license_places": f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {_places("cc", "by")} AS a, {_places("general", "public", "license")} AS b, {_places("all", "rights", "reserved")} AS c FROM t)
SELECT doc_id, n_words, len(a) + len(b) + len(c) AS n_base, list_min(a || b || c) - 1 AS first_word, list_max(a || b || c) - 1 AS last_word,
concat_ws(',', CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END) AS base_labels FROM p""",
    "llm_edited_texts": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM t)
SELECT doc_id, n AS n_chars, sha256(left(text, n - n // 3) || left(following, n // 3)) AS edited_sha256 FROM n""",
    "llm_chat_turns": f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{_TRAP}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256 FROM g""",
}
