"""DuckDB SQL of the registered queries on the same tables."""

from __future__ import annotations

import re

from medloom.operators import zones
from medloom.operators.consult import CONSULT_PROMPT, DISCLAIMER, FOOTER, HEADER, STOP_WORDS
from medloom.operators.extract import EXTRACTION_PROMPT
from medloom.operators.textprep import ADDRESS, EMAIL, PHONE, RESULT_LINE
from medloom.operators.textprep import STOP_WORDS as LANGUAGE_WORDS
from medloom.sources.strings import TEXTS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


VIEWS = {
    "lab_tests": "SELECT o_orderkey::VARCHAR AS test_id, o_custkey AS user_id, o_orderdate AS date, o_orderstatus AS provider, o_orderpriority AS test_name FROM orders",
    "lab_markers": """
        SELECT l_orderkey::VARCHAR AS test_id, pos, p_name AS name, l_quantity::VARCHAR AS value,
               CASE WHEN l_linestatus = 'F' THEN p_type END AS unit, CASE WHEN l_returnflag <> 'N' THEN '1-50' END AS reference_range,
               CASE l_returnflag WHEN 'R' THEN 'High' WHEN 'A' THEN 'LOW' END AS flag
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                           l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::INT AS pos FROM lineitem)
        JOIN part ON l_partkey = p_partkey""",
    "profiles": """
        SELECT c_custkey AS user_id, c_name AS full_name, (DATE '1950-01-01' + (c_custkey % 9000)::INT)::TIMESTAMP AS birth_date,
               CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS gender,
               CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS blood_type,
               CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 60 + 140)::DOUBLE END AS height,
               CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 70 + 40)::DOUBLE END AS weight,
               CASE WHEN c_custkey % 3 = 0 THEN 'English' WHEN c_custkey % 3 = 1 THEN 'Русский' WHEN c_custkey % 2 = 0 THEN 'Deutsch' END AS preferred_language
        FROM customer""",
    "questions": "SELECT conv_id * 1000 + turn AS question_id, conv_id AS user_id, text FROM conversations WHERE role = 'user'",
    "ocr_pages": """
        SELECT conv_id::VARCHAR AS doc_id, conv_id AS user_id, turn AS page_index, CASE WHEN turn % 4 <> 3 THEN text END AS text,
               turn % 3 <> 2 AS readable FROM conversations""",
    "best_lines": """
        SELECT doc_id, page_index, line_no, arg_max(text, {'c': confidence, 'r': -rank}) AS text, max(confidence) AS confidence
        FROM (SELECT user_id::VARCHAR AS doc_id, event_id % 2 AS page_index, event_type AS line_no, event_id AS rank,
                     CASE WHEN event_id % 11 <> 0 THEN props END AS text, value AS confidence FROM events)
        WHERE text IS NOT NULL GROUP BY ALL""",
    "ocr_text": "SELECT doc_id::VARCHAR AS doc_id, doc_id % 97 AS user_id, text FROM documents",
    "patients": """
        SELECT user_id, upper(w[1][1]) || w[1][2:] || ' ' || upper(w[2][1]) || w[2][2:] AS full_name
        FROM (SELECT c_custkey AS user_id, c_custkey AS k FROM customer UNION ALL SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 10 = 0)
        JOIN (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) ON k = p_partkey""",
    "staff": """
        SELECT upper(w[1][1]) || w[1][2:] || ' ' || upper(w[2][1]) || w[2][2:] AS full_name
        FROM supplier JOIN (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) ON s_suppkey = p_partkey - 50""",
    "letters": """
        SELECT doc_id, user_id, text || ' ' || CASE k % 7 WHEN 0 THEN f || ' ' || l WHEN 1 THEN upper(l) || ', ' || f WHEN 2 THEN lower(f || '-' || l) WHEN 3 THEN 'dear ' || l || ':'
               WHEN 4 THEN l || ' writes. ' || f WHEN 5 THEN 'Dr. ' || f || ' ' || l ELSE f[1] || '. ' || l END || '.' AS text
        FROM (SELECT *, doc_id::BIGINT AS k, CASE WHEN doc_id::BIGINT % 7 > 4 THEN 50 + doc_id::BIGINT % 10 ELSE user_id END AS p FROM ocr_text)
        JOIN (SELECT p_partkey, upper(w[1][1]) || w[1][2:] AS f, upper(w[2][1]) || w[2][2:] AS l FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)) ON p = p_partkey""",
    "reports": """
        SELECT doc_id, CASE WHEN k % 3 = 0 THEN text || chr(10) || p_name || ' 5.2 mmol/l' ELSE text END AS text, k % 3 = 0 AS target
        FROM (SELECT *, doc_id::BIGINT AS k FROM ocr_text) JOIN part ON p_partkey = k % 150""",
    "report_terms": r"SELECT doc_id, target, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS term FROM reports",
    "term_weights": """
        SELECT term, weight FROM (
            SELECT term, ln((d1 + 0.5) / (n1 + 1)) - ln((d0 + 0.5) / (n0 + 1)) AS weight, round(abs(weight / sqrt(1 / (d1 + 0.5) + 1 / (d0 + 0.5))), 9) AS z
            FROM (SELECT term, count(*) FILTER (target) AS d1, count(*) FILTER (NOT target) AS d0 FROM report_terms GROUP BY term HAVING count(*) >= 5),
                 (SELECT count(*) FILTER (target) AS n1, count(*) FILTER (NOT target) AS n0 FROM reports))
        WHERE z >= 3 ORDER BY z DESC, term LIMIT 1000""",
    "doc_grams": r"""
        SELECT doc_id, lang, f[i:i + 2] AS gram
        FROM (SELECT doc_id, lang, f, unnest(range(1, length(f) - 1)) AS i
              FROM (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS f FROM documents))""",
    # Segments of the letters, matches as rows, islands by running sums.
    "segs": r"""
        SELECT doc_id, user_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS k
        FROM (SELECT doc_id, user_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+') AS ss FROM contacts)""",
    "own_words": r"SELECT DISTINCT user_id, lower(unnest(regexp_extract_all(full_name, '[\p{L}\p{M}\p{N}]+'))) AS w FROM patients",
    "staff_pairs": r"""
        SELECT DISTINCT a, b FROM (
            SELECT unnest([x, x[1], x]) AS a, unnest([y, y, y[1]]) AS b FROM (
                SELECT DISTINCT lower(w[1]) AS x, lower(w[2]) AS y FROM (SELECT regexp_extract_all(full_name, '[\p{L}\p{M}\p{N}]+') AS w FROM staff)
                UNION SELECT DISTINCT lower(w[2]), lower(w[1]) FROM (SELECT regexp_extract_all(full_name, '[\p{L}\p{M}\p{N}]+') AS w FROM staff)))
        WHERE greatest(length(a), length(b)) >= 3""",
    "name_hits": r"""
        SELECT doc_id, k FROM segs JOIN own_words ON segs.user_id = own_words.user_id AND lower(s) = w
        UNION SELECT doc_id, unnest([k, k + 2]) FROM (
            SELECT *, lead(s) OVER o AS gap, lead(s, 2) OVER o AS s2 FROM segs WINDOW o AS (PARTITION BY doc_id ORDER BY k)
        ) JOIN staff_pairs ON a = lower(s) AND b = lower(s2)
        WHERE regexp_matches(s, '^\p{Lu}') AND regexp_matches(s2, '^\p{Lu}') AND regexp_matches(gap, '^[ \t\n\r]{0,4}[,.''’-]?[ \t\n\r]{0,4}$')""",
    "islands": r"""
        SELECT doc_id, min(k) AS first, max(k) AS last FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM (
                SELECT h.doc_id, h.k, segs.s,
                       (h.k - lag(h.k) OVER (PARTITION BY h.doc_id ORDER BY h.k) IS DISTINCT FROM 2 OR NOT regexp_matches(g.s, '^[ \t\n\r]{0,4}[,.''’-]?[ \t\n\r]{0,4}$'))::INT AS fresh
                FROM name_hits h JOIN segs ON h.doc_id = segs.doc_id AND h.k = segs.k LEFT JOIN segs g ON h.doc_id = g.doc_id AND g.k = h.k - 1))
        GROUP BY doc_id, island HAVING max(length(s)) >= 3""",
    "llm_responses": """
        SELECT 'r' || test_id AS request_id, test_id AS doc_id,
               CASE test_id::BIGINT % 20 WHEN 0 THEN 401 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 500 ELSE 200 END AS http_status,
               CASE test_id::BIGINT % 20 WHEN 4 THEN 'oops' WHEN 5 THEN '{"choices":[]}'
                    ELSE '{"choices":[{"message":{"content":"' || replace(content, '"', chr(92) || '"') || '"}}]}' END AS body
        FROM (
            SELECT test_id, CASE test_id::BIGINT % 7 WHEN 1 THEN left(c, length(c) - 3) WHEN 3 THEN c || ' Done.' ELSE c END AS content
            FROM (
                SELECT test_id, '{"markers":[' || coalesce(items, '') || ']}' AS c
                FROM (SELECT test_id FROM lab_tests WHERE test_id::BIGINT % 11 <> 0) LEFT JOIN (
                    SELECT test_id, string_agg('{' || CASE WHEN test_id::BIGINT % 7 = 4 THEN '' ELSE '"name":"' || name || '",' END || '"value":'
                        || CASE WHEN test_id::BIGINT % 7 = 2 THEN value ELSE '"' || value || '"' END
                        || ',"unit":' || coalesce('"' || unit || '"', 'null') || ',"referenceRange":' || coalesce('"' || reference_range || '"', 'null')
                        || coalesce(',"flag":"' || flag || '"', '') || '}', ',' ORDER BY pos) AS items
                    FROM lab_markers GROUP BY test_id
                ) USING (test_id)
            )
        )""",
    "choices": """
        SELECT *, CASE WHEN json_valid(body) THEN json_type(body, '$.choices[0].message.content') END = 'VARCHAR' AS shaped,
               CASE WHEN json_valid(body) THEN json_extract_string(body, '$.choices[0].message.content') END AS content
        FROM llm_responses""",
    "statuses": """
        SELECT *, CASE WHEN http_status <> 200 THEN 'http_error' WHEN NOT coalesce(shaped, false) THEN 'unparseable' ELSE 'ok' END AS status0,
               CASE http_status WHEN 401 THEN '401 Unauthorized — check your API key.' WHEN 404 THEN '404 Not Found — check your Base URL.'
                    WHEN 429 THEN '429 Too Many Requests — slow down.' WHEN 200 THEN CASE WHEN NOT coalesce(shaped, false) THEN 'Could not parse API response.' END
                    ELSE 'Server returned ' || http_status || '.' END AS error0
        FROM choices""",
    "decoded": """
        SELECT *, CASE WHEN status0 = 'ok' AND good IS NULL THEN 'undecodable' ELSE status0 END AS status,
               CASE WHEN status0 = 'ok' AND good IS NULL THEN 'The data couldn’t be read because it isn’t in the correct format.' ELSE error0 END AS error_text
        FROM (
            SELECT *, CASE WHEN status0 = 'ok' AND json_valid(content) THEN CASE
                WHEN json_type(content) = 'OBJECT' AND json_type(content, '$.markers') = 'ARRAY'
                 AND len(list_filter(json_extract(content, '$.markers[*]'), lambda m: NOT (
                     coalesce(json_type(m, '$.name') = 'VARCHAR', false) AND coalesce(json_type(m, '$.value') = 'VARCHAR', false)
                     AND coalesce(json_type(m, '$.unit'), 'NULL') IN ('VARCHAR', 'NULL')
                     AND coalesce(json_type(m, '$.referenceRange'), 'NULL') IN ('VARCHAR', 'NULL')
                     AND coalesce(json_type(m, '$.flag'), 'NULL') IN ('VARCHAR', 'NULL')))) = 0
                THEN json_extract(content, '$.markers[*]') END END AS good
            FROM statuses
        )""",
    "marker_rows": """
        SELECT doc_id, i - 1 AS pos, json_extract_string(m, '$.name') AS name, json_extract_string(m, '$.value') AS value,
               json_extract_string(m, '$.unit') AS unit, json_extract_string(m, '$.referenceRange') AS reference_range,
               json_extract_string(m, '$.flag') AS flag
        FROM (SELECT doc_id, unnest(good) AS m, generate_subscripts(good, 1) AS i FROM decoded WHERE good IS NOT NULL)""",
    "corrections": """
        SELECT test_id AS doc_id, CASE pick WHEN 2 THEN pos + 1000 ELSE pos END AS pos,
               CASE pick WHEN 0 THEN 'edit' WHEN 1 THEN 'remove' ELSE 'add' END AS action, CASE pick WHEN 0 THEN name || ' x' ELSE '' END AS name,
               '' AS value, NULL::VARCHAR AS unit
        FROM (SELECT *, (test_id::BIGINT + pos) % 9 AS pick FROM lab_markers) WHERE pick < 3""",
    "corrected": """
        SELECT m.test_id AS doc_id, m.pos, CASE WHEN c.action = 'edit' THEN c.name ELSE m.name END AS name,
               CASE WHEN c.action = 'edit' THEN c.value ELSE m.value END AS value, CASE WHEN c.action = 'edit' THEN c.unit ELSE m.unit END AS unit,
               m.reference_range, m.flag
        FROM lab_markers m LEFT JOIN corrections c ON m.test_id = c.doc_id AND m.pos = c.pos AND c.action IN ('edit', 'remove')
        WHERE c.action IS NULL OR c.action = 'edit'
        UNION ALL SELECT doc_id, pos, name, value, unit, NULL, NULL FROM corrections WHERE action = 'add'""",
    "loinc_dict": """
        SELECT name_norm, 'L-' || upper(name_norm[1:3]) || length(name_norm)::VARCHAR AS loinc_code
        FROM (SELECT DISTINCT lower(p_name) AS name_norm FROM part) WHERE length(name_norm) % 3 <> 0""",
    "spelt": """
        SELECT * REPLACE (CASE pos % 4 WHEN 1 THEN upper(name) || ' ' WHEN 2 THEN name[1] || name[3:] WHEN 3 THEN name || 'x' ELSE name END AS name) FROM lab_markers""",
    # Every unknown name with every known one.
    "name_pairs": """
        SELECT n, code, max(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h)))) AS sim FROM (
            SELECT n, list_distinct(list_transform(range(1, length(n) + 2), lambda i: (chr(1) || n || chr(1))[i:i + 1])) AS g
            FROM (SELECT DISTINCT lower(trim(name)) AS n FROM spelt WHERE lower(trim(name)) NOT IN (SELECT name_norm FROM loinc_dict) AND trim(name) <> '')
        ), (SELECT loinc_code AS code, list_distinct(list_transform(range(1, length(name_norm) + 2), lambda i: (chr(1) || name_norm || chr(1))[i:i + 1])) AS h FROM loinc_dict)
        WHERE len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) >= 0.7 GROUP BY ALL""",
    "name_codes": """
        SELECT name_norm, loinc_code, 'exact' AS loinc_match FROM loinc_dict
        UNION ALL SELECT n, CASE WHEN close THEN NULL ELSE code END, CASE WHEN close THEN 'ambiguous' ELSE 'similar' END FROM (
            SELECT n, code, coalesce(lead(sim) OVER w >= sim - 0.05, false) AS close, row_number() OVER w AS r FROM name_pairs WINDOW w AS (PARTITION BY n ORDER BY sim DESC, code)
        ) WHERE r = 1""",
    "measured": """
        SELECT m.*, CASE WHEN (test_id::BIGINT + pos) % 97 = 0 THEN '99' || value ELSE value END AS v, loinc_code
        FROM lab_markers m LEFT JOIN loinc_dict ON lower(trim(name)) = name_norm""",
    "links": """
        SELECT '{"k":"name","p":"' || (['O', 'F', 'P'])[p_partkey % 3 + 1] || '","n":"' || p_name || '"}' AS a, '{"k":"code","c":"C' || (p_partkey // 16) % 60 || '"}' AS b FROM part WHERE p_partkey % 16 = 0
        UNION SELECT '{"k":"name","p":"O","n":"' || p_name || '"}', '{"k":"name","p":"F","n":"' || p_name || '"}' FROM part WHERE p_partkey % 16 = 1""",
    "reached": """
        SELECT a AS node, a AS other FROM (SELECT a FROM links UNION SELECT b FROM links)
        UNION SELECT r.node, l.b FROM reached r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON r.other = l.a""",
    "winners": """
        SELECT user_id, test_name, name, value, unit, reference_range, date, test_id, pos
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, test_name, name ORDER BY date, test_id DESC, pos DESC) AS rn
              FROM lab_markers JOIN lab_tests USING (test_id)) WHERE rn = 1""",
    "matched": """
        SELECT question_id, q.user_id, w.test_name, w.name, w.value, w.unit, w.reference_range, w.date, w.test_id, w.pos
        FROM questions q JOIN winners w ON q.user_id = w.user_id
         AND len(list_filter(string_split(lower(w.name), ' '), lambda t: t <> '' AND contains(lower(q.text), t))) > 0""",
    "frags": """
        SELECT question_id, key, value
        FROM (SELECT *, row_number() OVER (PARTITION BY question_id, key ORDER BY date, test_id DESC, pos DESC) AS rn
              FROM (SELECT question_id, coalesce(test_name, '') || ' — ' || coalesce(name, '') AS key, date, test_id, pos,
                           coalesce(value, '') || ' ' || coalesce(unit, '') || ' (ref: ' || coalesce(reference_range, 'n/a') || ')' AS value FROM matched))
        WHERE rn = 1""",
    "prompts": f"""
        SELECT question_id, user_id, text, coalesce(n, 0)::INT AS n_fragments,
               CASE WHEN n > 0 THEN {_q(CONSULT_PROMPT)} || chr(10) || chr(10) || {_q(HEADER)} || chr(10) || lines || chr(10) || {_q(FOOTER)}
                    ELSE {_q(CONSULT_PROMPT)} END AS prompt
        FROM questions LEFT JOIN (SELECT question_id, count(*) AS n, string_agg('• ' || key || ': ' || value, chr(10) ORDER BY '• ' || key || ': ' || value) AS lines
                                  FROM frags GROUP BY question_id) USING (question_id)""",
    "assembled": """
        SELECT doc_id, string_agg('--- Page ' || (page_index + 1) || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY page_index) AS text
        FROM ocr_pages GROUP BY doc_id""",
    "strings": "SELECT * FROM (VALUES "
    + ", ".join(f"({_q(lang)}, {_q(key)}, {_q(text.replace('{app}', 'Health'))})" for key, *texts in TEXTS for lang, text in zip(("English", "Русский"), texts))
    + ") AS t(lang, key, text)",
}
_NEEDS = {
    "llm_responses": ["lab_tests", "lab_markers"], "choices": ["llm_responses"], "statuses": ["choices"], "decoded": ["statuses"], "marker_rows": ["decoded"],
    "corrections": ["lab_markers"], "corrected": ["corrections"], "measured": ["lab_markers", "loinc_dict"], "reached": ["links"], "spelt": ["lab_markers"], "name_pairs": ["spelt", "loinc_dict"], "name_codes": ["name_pairs"], "winners": ["lab_tests", "lab_markers"], "matched": ["questions", "winners"],
    "letters": ["ocr_text"], "reports": ["ocr_text"], "report_terms": ["reports"], "term_weights": ["report_terms"], "segs": ["contacts"], "own_words": ["patients"], "staff_pairs": ["staff"], "name_hits": ["segs", "own_words", "staff_pairs"], "islands": ["name_hits"],
    "frags": ["matched"], "prompts": ["questions", "frags"], "assembled": ["ocr_pages"],
}


def sql(query: str, *views: str) -> str:
    """``query`` after the views that it names and those that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for view in views:
        need(view)
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order) + "\n" + query if order else query


#: normalize_ocr of the column text.
NORMALIZED = r"""
    (SELECT doc_id, text, coalesce(m[1:length(m) - 1], '') AS normalized FROM (
        SELECT doc_id, text, array_to_string(list_transform(
            list_filter(list_transform(regexp_split_to_array(text, '[\n\x0B\f\r\x{85}\x{2028}\x{2029}]'),
                        lambda x: regexp_replace(x, '^[\p{Zs}\t]+|[\p{Zs}\t]+$', '', 'g')), lambda x: x <> ''),
            lambda x: x || CASE WHEN length(x) < 30 AND (suffix(x, ':') OR suffix(x, '-') OR NOT regexp_matches(x, '\p{N}')) THEN ' ' ELSE chr(10) END), '') AS m
        FROM ocr_text))
"""


def _hits(words: list[str]) -> str:
    return f"len(list_filter(toks, lambda t: list_contains({_list(words)}, t)))"


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"
_RATED = ", ".join(f"{_hits(words)} * 10 + {len(LANGUAGE_WORDS) - k}" for k, words in enumerate(LANGUAGE_WORDS.values()))
_LANG = " ".join(f"WHEN {len(LANGUAGE_WORDS) - k} THEN '{lang}'" for k, lang in enumerate(LANGUAGE_WORDS))


def _re(pattern: str) -> str:
    return _q(pattern)


def _redacted(column: str) -> str:
    out = f"regexp_replace({column}, {_re(EMAIL)}, '[EMAIL]', 'g')"
    out = f"regexp_replace({out}, {_re(ADDRESS)}, '[ADDRESS]', 'g')"
    return rf"regexp_replace({out}, {_re(PHONE)}, '\1[PHONE]\3', 'g')"


_PII = " + ".join(f"len(regexp_extract_all(text, {_re(p)}))" for p in (EMAIL, PHONE, ADDRESS))
_MEASURE = "CASE WHEN regexp_matches({0}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST({0} AS DOUBLE) END"
_EDITS = """
    (SELECT CASE WHEN c_custkey % 10 = 1 THEN c_custkey + 1000000 ELSE c_custkey END AS user_id, c_name || ' II' AS full_name,
            TIMESTAMP '1980-05-06' AS birth_date, 'Other' AS gender, '' AS blood_type,
            CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 60 + 141)::VARCHAR WHEN 1 THEN (c_custkey % 60 + 141)::VARCHAR || '.5' WHEN 2 THEN ' 72' ELSE '72,5' END AS height_text,
            '1e2' AS weight_text, 'Русский' AS preferred_language
     FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 10 = 1)
"""
_PAYLOAD = "'{{\"model\":\"default\",\"messages\":[{{\"role\":\"system\",\"content\":' || to_json({0}) || '}},{{\"role\":\"user\",\"content\":' || to_json({1}) || '}}],\"temperature\":{2}}}'"
_LINE = _re(RESULT_LINE)
VIEWS["sheet_lines"] = """
        SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
            SELECT test_id AS doc_id, string_split('Results of the laboratory, 2020' || chr(10) || string_agg(
                CASE pos % 3 WHEN 1 THEN name || ': ' || value || coalesce(' ' || reference_range, '') WHEN 2 THEN name || chr(10) || value
                             ELSE name || chr(10) || value || chr(10) || coalesce(reference_range, 'no range, 1 of 2') END, chr(10) ORDER BY pos), chr(10)) AS ls
            FROM lab_markers GROUP BY test_id)"""
_FORMS = ["true", *[f"regexp_matches(line, {_re(p)})" for p in (RESULT_LINE, zones.NAME_LINE, zones.VALUE_LINE, zones.RANGE_LINE)]]
_BEST = [
    "list_max([" + ", ".join(f"{{'s': s{i} + {zones.FOLLOWS.get((a, b), 0)}, 'k': {-i}}}" for i, a in enumerate(zones.LABELS)) + "])" for b in zones.LABELS
]
# Points and way of each label, line by line.
VIEWS["ways"] = f"""
        SELECT DISTINCT doc_id, 0::BIGINT AS i, 0 AS s0, {', '.join(f'-1000000 AS s{j}' for j in range(1, 5))}, {', '.join(f"'' AS p{j}" for j in range(5))} FROM sheet_lines
        UNION ALL SELECT doc_id, i, {', '.join(f'b{j}.s + e{j}' for j in range(5))}, {', '.join(f"([p0, p1, p2, p3, p4])[1 - b{j}.k] || '{j}'" for j in range(5))}
        FROM (SELECT w.doc_id, l.i, p0, p1, p2, p3, p4, {', '.join(f'{b} AS b{j}' for j, b in enumerate(_BEST))},
                     {', '.join(f'CASE WHEN {form} THEN {zones.FITS[label]} ELSE {zones.MISSES} END AS e{j}' for j, (label, form) in enumerate(zip(zones.LABELS, _FORMS)))}
              FROM ways w JOIN sheet_lines l ON l.doc_id = w.doc_id AND l.i = w.i + 1)"""
VIEWS["labelled"] = f"""
        SELECT l.doc_id, i, line, substr(way, i, 1)::INT AS label FROM sheet_lines l JOIN (
            SELECT doc_id, ([p0, p1, p2, p3, p4])[1 - list_max([{', '.join(f"{{'s': s{j}, 'k': {-j}}}" for j in range(5))}]).k] AS way
            FROM ways QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) b ON l.doc_id = b.doc_id"""
_NEEDS |= {"sheet_lines": ["lab_markers"], "ways": ["sheet_lines"], "labelled": ["ways"]}
VIEWS["contacts"] = f"SELECT doc_id, user_id, {_redacted('text')} AS text FROM letters"
_NEEDS["contacts"] = ["letters"]
for _view in ("segs", "name_hits", "islands"):
    VIEWS[f"raw_{_view}"] = re.sub(r"\b(segs|name_hits)\b", r"raw_\1", VIEWS[_view]).replace("contacts", "letters")
VIEWS["scans"] = """
        SELECT doc_id, string_agg('--- Page ' || (page_index + 1) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_index) AS text
        FROM (SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY line_no) AS text FROM best_lines GROUP BY ALL) GROUP BY doc_id"""
VIEWS["scan_markers"] = """
        SELECT m.doc_id, m.pos, CASE WHEN c.action = 'edit' THEN c.name ELSE m.name END AS name, CASE WHEN c.action = 'edit' THEN c.value ELSE m.value END AS value,
               CASE WHEN c.action = 'edit' THEN c.unit ELSE m.unit END AS unit, m.reference_range, m.flag
        FROM marker_rows m LEFT JOIN corrections c ON m.doc_id = c.doc_id AND m.pos = c.pos AND c.action IN ('edit', 'remove') WHERE c.action IS NULL OR c.action = 'edit'
        UNION ALL SELECT doc_id, pos, name, value, unit, NULL, NULL FROM corrections WHERE action = 'add'"""
VIEWS["scan_names"] = re.sub(r"\bspelt\b", "scan_markers", VIEWS["name_pairs"])
VIEWS["scan_dict"] = VIEWS["name_codes"].replace("name_pairs", "scan_names")
VIEWS["scan_codes"] = "SELECT m.*, loinc_code FROM scan_markers m LEFT JOIN scan_dict ON lower(trim(name)) = name_norm"
_NEEDS |= {"scans": ["best_lines"], "scan_markers": ["marker_rows", "corrections"], "scan_names": ["scan_markers", "loinc_dict"], "scan_dict": ["scan_names"], "scan_codes": ["scan_dict"]}
_NEEDS |= {"raw_segs": ["letters"], "raw_name_hits": ["raw_segs", "own_words", "staff_pairs"], "raw_islands": ["raw_name_hits"]}

ORACLES = {
    "read_ocr_pages": sql("SELECT doc_id, user_id, page_index, coalesce(text, '') AS text, readable FROM ocr_pages", "ocr_pages"),
    "read_llm_responses": sql("SELECT * FROM llm_responses", "llm_responses"),
    "save_tests": sql(
        """SELECT sha256(m.test_id) AS test_id, pos, name, NULL::VARCHAR AS loinc_code, value, unit, reference_range, flag, false AS is_critical,
                  NULL::VARCHAR AS lab_standard_id, year(date)::INT AS year FROM lab_markers m JOIN lab_tests t ON m.test_id = t.test_id""",
        "lab_markers", "lab_tests",
    ),
    "delete_saved_tests": sql(
        """SELECT sha256(t.test_id) AS test_id, year(date)::INT AS year, pos, name FROM lab_tests t LEFT JOIN lab_markers m ON t.test_id = m.test_id
           WHERE t.test_id::BIGINT % 11 <> 0""", "lab_tests", "lab_markers"
    ),
    "scan_requests": sql(
        f"""SELECT doc_id, sha256({_PAYLOAD.format(_q(EXTRACTION_PROMPT), _redacted('normalized'), '0.1')}) AS payload_sha256
            FROM {NORMALIZED.replace('ocr_text', 'scans')} JOIN lab_tests ON doc_id = test_id""", "scans", "lab_tests"
    ),
    "scan_to_saved": sql(
        """SELECT sha256(d.doc_id) AS test_id, user_id, test_name, year(date)::INT AS year, pos, name, loinc_code, value, unit, reference_range, flag
           FROM scans d JOIN lab_tests t ON d.doc_id = t.test_id LEFT JOIN scan_codes m ON d.doc_id = m.doc_id WHERE d.doc_id::BIGINT % 3 <> 0""", "scans", "lab_tests", "scan_codes"
    ),
    "extraction_requests": sql(f"SELECT doc_id, {_PAYLOAD.format(_q(EXTRACTION_PROMPT), 'text', '0.1')} AS payload FROM ocr_text", "ocr_text"),
    "consult_requests": sql(f"SELECT question_id, {_PAYLOAD.format('prompt', 'text', '0.2')} AS payload FROM prompts", "prompts"),
    "nonempty_docs": sql("SELECT doc_id, length(text) AS n FROM ocr_text WHERE length(text) > 0", "ocr_text"),
    "nonblank_questions": sql(
        r"SELECT * FROM (SELECT question_id, user_id, regexp_replace(text, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') AS text FROM questions) WHERE text <> ''", "questions"
    ),
    "flag_bucket": sql("SELECT test_id, pos, lower(flag) AS bucket, CASE lower(flag) WHEN 'high' THEN 'red' WHEN 'low' THEN 'orange' END AS colour FROM lab_markers", "lab_markers"),
    "reference_label": sql("SELECT test_id, pos, 'Reference: ' || reference_range AS reference_label FROM lab_markers", "lab_markers"),
    "marker_display": sql("SELECT test_id, pos, value, coalesce(unit, '') AS unit_text FROM lab_markers", "lab_markers"),
    "response_status": sql("SELECT doc_id, http_status, status0 AS status, error0 AS error_text FROM statuses", "statuses"),
    "chat_source_label": """
        SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'You' WHEN turn % 2 = 1 THEN 'Brain ☁️' ELSE 'Brain 📱' END AS label
        FROM conversations WHERE role IN ('user', 'assistant')""",
    "medical_doc_gate": sql(
        f"""SELECT doc_id, len(list_distinct(list_filter({_TOKENS}, lambda t: list_contains(['the', 'with', 'und', 'les', 'para'], t)))) AS medical_hits,
                   medical_hits >= 2 AS is_medical FROM ocr_text""", "ocr_text"
    ),
    "needs_review": sql(
        """SELECT test_id, pos, loinc_code, loinc_code IS NULL OR trim(name) = '' OR trim(value) = '' OR coalesce(flag NOT IN ('High', 'Low', 'Normal'), false) AS needs_review
           FROM lab_markers LEFT JOIN loinc_dict ON lower(trim(name)) = name_norm""", "lab_markers", "loinc_dict"
    ),
    "sensitive_routing": sql(
        f"""SELECT doc_id, pii_hits, CASE WHEN pii_hits >= 1 THEN 'SENSITIVE_HIGH' ELSE 'NORMAL' END AS sensitivity,
                   CASE WHEN pii_hits >= 1 THEN 'manual' ELSE 'auto' END AS route FROM (SELECT doc_id, {_PII} AS pii_hits FROM ocr_text)""", "ocr_text"
    ),
    "reply_compliance": f"""
        SELECT *, NOT has_stop_word AND has_disclaimer AND careful AS compliant FROM (
            SELECT conv_id, turn, len(list_filter({_list(STOP_WORDS)}, lambda w: contains(lower(t), w))) > 0 AS has_stop_word, contains(t, {_q(DISCLAIMER)}) AS has_disclaimer,
                   len(regexp_extract_all(lower(t), 'cause|причин')) <= len(regexp_extract_all(lower(t), 'possible cause|возможн(ые|ых|ая|ой) причин')) AS careful
            FROM (SELECT *, text || CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' Possible causes: rest.' ELSE ' The cause of possible causes.' END
                         || CASE WHEN turn % 3 = 0 THEN ' ' || {_q(DISCLAIMER)} ELSE ' you have' END AS t FROM conversations WHERE role = 'assistant'))""",
    "test_markers": sql("SELECT t.test_id, user_id, test_name, pos, name, value, unit, reference_range, flag FROM lab_tests t LEFT JOIN lab_markers m ON t.test_id = m.test_id", "lab_tests", "lab_markers"),
    "context_match": sql("SELECT question_id, user_id, test_name, name FROM matched", "matched"),
    "match_report": sql(
        """SELECT part, count(*) AS n_matches
           FROM questions q JOIN (SELECT DISTINCT user_id, name, unnest(string_split(lower(name), ' ')) AS part FROM winners) w ON q.user_id = w.user_id AND contains(lower(q.text), part)
           WHERE part <> '' GROUP BY part""", "questions", "winners"
    ),
    "page_report": sql(
        "SELECT doc_id, count(*) AS n_pages, sum(length(coalesce(text, '')))::BIGINT AS n_chars, n_pages > 8 OR n_chars > 5000000 AS oversize FROM ocr_pages GROUP BY doc_id", "ocr_pages"
    ),
    "unusual_values": sql(
        """SELECT test_id, pos, v AS value, coalesce(v::DOUBLE NOT BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1), false) AS unusual
           FROM measured LEFT JOIN (SELECT loinc_code, quantile_disc(v::DOUBLE, 0.25) AS q1, quantile_disc(v::DOUBLE, 0.75) AS q3 FROM measured GROUP BY ALL HAVING count(*) >= 50) USING (loinc_code)""", "measured"
    ),
    # Reachable nodes of each node, then the smallest of them.
    "standard_markers": sql(
        """SELECT test_id, pos, provider, name, 'S-' || sha256(root)[1:16] AS lab_standard_id
           FROM (SELECT m.*, provider FROM lab_markers m JOIN lab_tests t ON m.test_id = t.test_id)
           LEFT JOIN (SELECT node, min(other) AS root FROM reached GROUP BY node) ON node = '{"k":"name","p":"' || provider || '","n":"' || lower(trim(name)) || '"}'""",
        "lab_markers", "lab_tests", "reached",
    ),
    "extraction_outcome": sql(
        """SELECT t.doc_id, coalesce(len(good), 0)::INT AS n_markers, error, CASE WHEN error IS NULL THEN text ELSE
                  '--- SERVER ERROR ---' || chr(10) || 'API Error: ' || error || chr(10) || chr(10) || '--- ORIGINAL OCR ---' || chr(10) || text END AS text
           FROM (SELECT test_id AS doc_id, test_name || ' ' || provider AS text, CASE WHEN d.doc_id IS NULL THEN 'Invalid response from server.' ELSE error_text END AS error, good
                 FROM lab_tests LEFT JOIN decoded d ON test_id = d.doc_id) t""", "lab_tests", "decoded"
    ),
    "confirmed_only": sql("SELECT test_id AS doc_id, pos, name FROM lab_markers WHERE test_id::BIGINT % 3 <> 0", "lab_markers"),
    "apply_corrections": sql("SELECT * FROM corrected", "corrected"),
    "delete_tests_cascade": sql(
        "SELECT t.test_id, pos, name FROM lab_tests t LEFT JOIN lab_markers m ON t.test_id = m.test_id WHERE t.test_id::BIGINT % 11 <> 0", "lab_tests", "lab_markers"
    ),
    "delete_profiles_cascade": """
        SELECT 'profiles' AS table_name, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer WHERE c_custkey % 4 <> 1
        UNION ALL SELECT 'weight_history', count(*), sum(user_id)::BIGINT FROM events WHERE NOT (user_id % 4 = 1 AND user_id IN (SELECT c_custkey FROM customer))
        UNION ALL SELECT 'lab_tests', count(*), sum(o_custkey)::BIGINT FROM orders""",
    "localize": sql(
        """SELECT user_id, k AS key, coalesce(s.text, k) AS label
           FROM (SELECT user_id, 'gender_' || lower(gender) AS k, preferred_language AS l FROM profiles
                 UNION ALL SELECT user_id, 'tab_vault', preferred_language FROM profiles)
           LEFT JOIN strings s ON s.key = k AND s.lang = CASE WHEN l IN ('English', 'Русский') THEN l ELSE 'English' END""", "profiles", "strings"
    ),
    "loinc_map": sql(
        "SELECT test_id, pos, name, loinc_code, coalesce(loinc_match, 'none') AS loinc_match FROM spelt LEFT JOIN name_codes ON lower(trim(name)) = name_norm", "spelt", "name_codes"
    ),
    "lab_standard_map": sql(
        "SELECT m.test_id, pos, provider, name, CASE WHEN length(name) % 2 = 0 THEN 'S-' || lower(name) END AS lab_standard_id FROM lab_markers m JOIN lab_tests t ON m.test_id = t.test_id", "lab_markers", "lab_tests"
    ),
    "assemble_pages": sql("SELECT * FROM assembled", "assembled"),
    "assemble_pdf_pages": sql(
        """SELECT doc_id, string_agg('--- PDF Page ' || n || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY n) AS text
           FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS n FROM ocr_pages WHERE readable) GROUP BY doc_id""", "ocr_pages"
    ),
    "join_ocr_lines": sql("SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY line_no) AS text FROM best_lines GROUP BY ALL", "best_lines"),
    "fragments": sql("SELECT * FROM frags", "frags"),
    "fragment_prompt": sql("SELECT * FROM prompts", "prompts"),
    "page_numbers": sql("SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id ORDER BY page_index)::INT AS page_number FROM ocr_pages", "ocr_pages"),
    "vault_listing": sql(
        "SELECT user_id, test_id, test_name, date::DATE::VARCHAR AS day, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, test_id)::INT AS rank FROM lab_tests", "lab_tests"
    ),
    "top_candidate": sql("SELECT * FROM best_lines", "best_lines"),
    "current_profile": sql("SELECT user_id, full_name, coalesce(preferred_language, 'English') AS preferred_language FROM profiles", "profiles"),
    "first_choice": sql("SELECT doc_id, CASE WHEN shaped THEN content END AS content FROM choices", "choices"),
    "chat_log": """
        SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'local' ELSE 'cloud' END AS source FROM conversations WHERE role = 'user' OR (role = 'assistant' AND turn % 5 <> 1)
        UNION ALL SELECT c_custkey, 0, 'assistant', 'Welcome', 'local' FROM customer
        WHERE c_custkey NOT IN (SELECT conv_id FROM conversations WHERE role = 'user' OR (role = 'assistant' AND turn % 5 <> 1))""",
    "profile_upsert": sql(
        f"""SELECT coalesce(p.user_id, e.user_id) AS user_id, CASE WHEN e.user_id IS NULL THEN p.full_name ELSE e.full_name END AS full_name,
                   CASE WHEN e.user_id IS NULL THEN p.birth_date ELSE e.birth_date END AS birth_date, CASE WHEN e.user_id IS NULL THEN p.gender ELSE e.gender END AS gender,
                   CASE WHEN e.user_id IS NULL THEN p.blood_type ELSE e.blood_type END AS blood_type,
                   CASE WHEN e.user_id IS NULL THEN p.height ELSE {_MEASURE.format('e.height_text')} END AS height,
                   CASE WHEN e.user_id IS NULL THEN p.weight ELSE {_MEASURE.format('e.weight_text')} END AS weight,
                   CASE WHEN e.user_id IS NULL THEN p.preferred_language ELSE e.preferred_language END AS preferred_language
            FROM profiles p FULL JOIN {_EDITS} e ON p.user_id = e.user_id""", "profiles"
    ),
    "stored_upsert": sql(
        f"""SELECT coalesce(p.user_id, e.user_id) AS user_id, CASE WHEN e.user_id IS NULL THEN p.full_name WHEN e.user_id % 2 = 0 THEN 'A later name' ELSE e.full_name END AS full_name,
                   CASE WHEN e.user_id IS NULL THEN p.birth_date ELSE e.birth_date END AS birth_date, CASE WHEN e.user_id IS NULL THEN p.gender ELSE e.gender END AS gender,
                   CASE WHEN e.user_id IS NULL THEN p.blood_type ELSE e.blood_type END AS blood_type,
                   CASE WHEN e.user_id IS NULL THEN p.height ELSE {_MEASURE.format('e.height_text')} END AS height,
                   CASE WHEN e.user_id IS NULL THEN p.weight ELSE {_MEASURE.format('e.weight_text')} END AS weight,
                   CASE WHEN e.user_id IS NULL THEN p.preferred_language ELSE e.preferred_language END AS preferred_language
            FROM profiles p FULL JOIN {_EDITS} e ON p.user_id = e.user_id""", "profiles"
    ),
    "normalize_ocr": sql(f"SELECT doc_id, sha256(normalized) AS text_sha256, length(normalized) AS n FROM {NORMALIZED}", "ocr_text"),
    "parse_markers": sql("SELECT d.doc_id, status, error_text, pos, name, value, unit, reference_range, flag FROM decoded d LEFT JOIN marker_rows m ON d.doc_id = m.doc_id", "decoded", "marker_rows"),
    "parse_reply": sql("SELECT doc_id, status0 AS status, CASE WHEN status0 = 'ok' THEN content END AS reply FROM statuses", "statuses"),
    "marker_identity": sql("SELECT test_id, pos, name || coalesce(unit, '') AS identity FROM lab_markers", "lab_markers"),
    "fragment_text": sql(
        """SELECT m.test_id, pos, test_name || ' — ' || name AS key, value || ' ' || coalesce(unit, '') || ' (ref: ' || coalesce(reference_range, 'n/a') || ')' AS value
           FROM lab_markers m JOIN lab_tests t ON m.test_id = t.test_id""", "lab_markers", "lab_tests"
    ),
    "lowercase_tokens": "SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: x <> ''), '|') AS tokens FROM part",
    "parse_measure": f"""
        SELECT c_custkey AS user_id, t AS measure_text, {_MEASURE.format('t')} AS measure FROM (
            SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '72' WHEN 1 THEN '72.5' WHEN 2 THEN '72,5' WHEN 3 THEN ' 72' WHEN 4 THEN '1d' ELSE (c_custkey % 100)::VARCHAR || 'e2' END AS t
            FROM customer)""",
    "profile_form": sql(
        "SELECT user_id, full_name, birth_date, gender, coalesce(blood_type, '') AS blood_type, coalesce(height::VARCHAR, '') AS height, coalesce(weight::VARCHAR, '') AS weight, preferred_language AS language FROM profiles", "profiles"
    ),
    "display_day": sql("SELECT test_id, date::DATE::VARCHAR AS day FROM lab_tests", "lab_tests"),
    "detect_language": sql(
        f"SELECT doc_id, CASE WHEN best < 10 THEN 'und' ELSE CASE best % 10 {_LANG} END END AS language FROM (SELECT doc_id, greatest({_RATED}) AS best FROM (SELECT doc_id, {_TOKENS} AS toks FROM ocr_text))", "ocr_text"
    ),
    "profile_languages": sql(
        """SELECT d.doc_id::VARCHAR AS doc_id, coalesce(language, 'und') AS language FROM documents d LEFT JOIN (
               SELECT doc_id, arg_min(lang, {'n': -near, 'l': lang}) AS language FROM (
                   SELECT o.doc_id, p.lang, sum(300 - abs(o.r - p.r)) AS near
                   FROM (SELECT * FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) AS r FROM doc_grams GROUP BY doc_id, gram) WHERE r <= 300) o
                   JOIN (SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS r FROM doc_grams WHERE lang IS NOT NULL GROUP BY lang, gram)
                         WHERE r <= 300) p ON o.gram = p.gram
                   GROUP BY o.doc_id, p.lang) GROUP BY doc_id) b ON d.doc_id = b.doc_id""", "doc_grams"
    ),
    "weighted_gate": sql(
        """SELECT r.doc_id, coalesce(n, 0)::BIGINT AS n_terms, coalesce(score, 0) > 0 AS is_medical FROM reports r LEFT JOIN (
               SELECT doc_id, count(*) AS n, sum(weight) AS score FROM report_terms JOIN term_weights USING (term) GROUP BY doc_id) t ON r.doc_id = t.doc_id""", "reports", "report_terms", "term_weights"
    ),
    "key_zones": sql(
        f"""SELECT doc_id, i - 1 AS line_no, nullif(regexp_extract(line, {_LINE}, 1), '') AS name, nullif(regexp_extract(line, {_LINE}, 2), '') AS value,
                   nullif(regexp_extract(line, {_LINE}, 3), '') AS unit, nullif(regexp_extract(line, {_LINE}, 4), '') AS reference_range
            FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT test_id AS doc_id, string_split(string_agg(name || ': ' || value || coalesce(' ' || reference_range, ''), chr(10) ORDER BY pos), chr(10)) AS ls FROM lab_markers GROUP BY test_id))
            WHERE regexp_matches(line, {_LINE})""", "lab_markers"
    ),
    "line_zones": sql(f"SELECT doc_id, (i - 1)::INT AS line_no, ({_list(zones.LABELS)})[label + 1] AS label FROM labelled", "labelled"),
    "result_zones": sql(
        f"""SELECT doc_id, (i - 1)::INT AS line_no, CASE WHEN label = 1 THEN 1 WHEN third = 4 AND g3 = '' THEN 3 ELSE 2 END AS n_lines,
                   nullif(CASE WHEN label = 1 THEN regexp_extract(line, {_LINE}, 1) ELSE regexp_extract(line, {_re(zones.NAME_LINE)}, 1) END, '') AS name,
                   nullif(CASE WHEN label = 1 THEN regexp_extract(line, {_LINE}, 2) ELSE regexp_extract(l2, {_re(zones.VALUE_LINE)}, 1) END, '') AS value,
                   nullif(CASE WHEN label = 1 THEN regexp_extract(line, {_LINE}, 3) ELSE regexp_extract(l2, {_re(zones.VALUE_LINE)}, 2) END, '') AS unit,
                   nullif(CASE WHEN label = 1 THEN regexp_extract(line, {_LINE}, 4) WHEN g3 <> '' THEN g3 WHEN third = 4 THEN regexp_extract(l3, {_re(zones.RANGE_LINE)}, 1) END, '') AS reference_range
            FROM (SELECT *, lead(label) OVER w AS second, lead(label, 2) OVER w AS third, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3,
                         coalesce(regexp_extract(lead(line) OVER w, {_re(zones.VALUE_LINE)}, 3), '') AS g3
                  FROM labelled WINDOW w AS (PARTITION BY doc_id ORDER BY i))
            WHERE label = 1 OR label = 2 AND second = 3""", "labelled"
    ),
    "redact_pii": sql(
        """SELECT segs.doc_id, user_id, sha256(coalesce(string_agg(CASE WHEN first IS NULL THEN s WHEN k = first THEN '[NAME]' ELSE '' END, '' ORDER BY k), '')) AS text_sha256
           FROM segs LEFT JOIN islands ON segs.doc_id = islands.doc_id AND k BETWEEN first AND last GROUP BY ALL""", "islands"
    ),
    "name_spans": sql(
        """SELECT i.doc_id, row_number() OVER (PARTITION BY i.doc_id ORDER BY first)::INT - 1 AS span,
                  coalesce(sum(length(s)) FILTER (k < first), 0)::INT AS start, string_agg(s, '' ORDER BY k) FILTER (k >= first) AS name
           FROM raw_islands i JOIN raw_segs ON i.doc_id = raw_segs.doc_id AND k <= last GROUP BY i.doc_id, first""", "raw_islands"
    ),
}
