"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = "list_filter(string_split(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '')"


def _fingerprints() -> str:
    hashes = lambda w: f"list_sort(list_distinct([left(md5(array_to_string({w}[i:i + 4], ' ')), 13) for i in range(1, greatest(len({w}) - 3, 2)) if len({w}) > 0]))[1:128]"
    near = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect(list_sort(list_distinct({a} || {b}))[1:128], {a}), {b})) / greatest(len(list_sort(list_distinct({a} || {b}))[1:128]), 1) END"
    number = lambda a: f"CASE WHEN len({a}) < 128 THEN CAST(len({a}) AS DOUBLE) ELSE 127.0::DOUBLE / (CAST(CAST('0x' || {a}[128] AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS following,
  row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS place FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 4) || left(following, length(text) // 4) AS edited FROM o),
w AS (SELECT *, {_WORDS.format("text")} AS w, {_WORDS.format("edited")} AS v FROM e),
s AS (SELECT *, {hashes("w")} AS a, {hashes("v")} AS b FROM w),
n AS (SELECT *, coalesce(lead(a) OVER (ORDER BY place), first_value(a) OVER (ORDER BY place)) AS c FROM s),
r AS (SELECT *, list_sort(list_distinct(a || b))[1:128] AS ab, {near("a", "b")} AS near_edited, {near("a", "c")} AS near_next FROM n)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CAST(near_edited AS DOUBLE) AS near_edited, CAST(near_next AS DOUBLE) AS near_next,
  CASE WHEN len(a) = 0 THEN 1.0 ELSE least(CAST(near_edited AS DOUBLE) * ({number("ab")}) / ({number("a")}), 1.0) END AS edited_kept, {number("a")} AS n_shingles
FROM r
"""


def _vector_codes() -> str:
    steps = ["""k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS x FROM k, range(8) AS r(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16))"""]
    for r in range(7):
        steps.append(f"""a{r} AS (SELECT vec_id, part, min(list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)]) * 16 + entry) AS best
  FROM p JOIN b{r} USING (part) GROUP BY vec_id, part)""")
        if r < 6:
            steps.append(f"""m{r} AS (SELECT part, entry, list(c ORDER BY i) AS c FROM (SELECT part, CAST(best % 16 AS BIGINT) AS entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS c
  FROM a{r} JOIN p USING (vec_id, part), range(1, 129) AS u(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY part, entry),
b{r + 1} AS (SELECT part, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry))""")
    return f"""WITH {", ".join(steps)},
e AS (SELECT vec_id, string_agg(lpad(to_hex(CAST(best % 16 AS BIGINT)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM a6 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), h
"""


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_RANKED = f"""
WITH t AS (SELECT doc_id, {_TERMS.format("text")} AS own FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, len(own) AS n, own FROM t WHERE len(own) > 0),
s AS (SELECT count(*) AS docs_n, CAST(sum(n) AS BIGINT) AS terms_n FROM d),
i AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
o AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(own) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM o, s GROUP BY term),
c AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs_n) // terms_n)))) AS BIGINT) AS score
  FROM i JOIN o USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

ORACLES: dict[str, str] = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
""",
    "op4_tool_calls": """
WITH u AS (SELECT conv_id, turn, text, length(text) > 200 AS long FROM conversations WHERE role = 'user'),
i AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM u),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM i),
c AS (SELECT l.conv_id, l.turn, 'call-' || l.conv_id || '-' || l.turn AS call_id, CASE WHEN long THEN 'summarise' ELSE 'lookup' END AS name, level,
    CASE WHEN long AND l.turn > 5 THEN ['$.turn: above 5'] WHEN NOT long AND l.text = '' THEN ['$.query: shorter than 1'] ELSE CAST([] AS VARCHAR[]) END AS errors,
    r.turn AS result_turn, l.text, long, r.text AS result
  FROM l LEFT JOIN conversations r ON r.role = 'assistant' AND r.conv_id = l.conv_id AND r.turn = l.turn + 1)
SELECT conv_id, turn, call_id, name, CAST(level AS INTEGER) AS level,
  CASE WHEN result_turn IS NULL THEN 'unlinked' WHEN len(errors) > 0 THEN 'invalid' ELSE 'ok' END AS status, errors, result_turn,
  '{"arguments":{' || CASE WHEN long THEN '"text":' ELSE '"query":' END || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '},"id":"' || call_id
    || '","name":"' || name || '","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS canonical
FROM c
""",
    "op11_vector_codes": _vector_codes(),
    "op12_fingerprints": _fingerprints(),
    "op13_ranked_search": _RANKED,
}
