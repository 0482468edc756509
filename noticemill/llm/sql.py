"""SQL over the same tables whose rows the queries must return."""

EXACT = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS size,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal
    FROM documents
), r AS (
    SELECT *, count(*) OVER (PARTITION BY normal) AS group_size,
           first_value(doc_id) OVER (PARTITION BY normal ORDER BY size DESC, doc_id NULLS LAST) AS keep_id
    FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(normal) AS text_sha256
FROM r
"""

NEAR = r"""
WITH RECURSIVE w AS (
    SELECT doc_id,
           list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5
        THEN [list_aggregate(words, 'string_agg', ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' '))
        END) AS shingles
    FROM w
), c AS (
    SELECT shingles, min(doc_id) AS rep, len(shingles) AS n
    FROM (SELECT doc_id, list_sort(shingles) AS shingles FROM s) GROUP BY shingles
), g AS (
    SELECT rep, n, unnest(shingles) AS shingle FROM c
), p AS (
    SELECT a.rep AS a, b.rep AS b
    FROM g a JOIN g b ON a.shingle = b.shingle AND a.rep < b.rep
        AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    GROUP BY a.rep, b.rep
    HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))
), e AS (
    SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), reach AS (
    SELECT rep AS id, rep AS other FROM c
    UNION
    SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a
), m AS (
    SELECT id, min(other) AS component_id FROM reach GROUP BY id
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles,
       CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE m.component_id END AS component_id,
       len(s.shingles) = 0 OR s.doc_id = m.component_id AS kept
FROM s JOIN c ON list_sort(s.shingles) = c.shingles JOIN m ON m.id = c.rep
"""

VECTORS = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), p AS (
    SELECT x.vec_id AS a, y.vec_id AS b
    FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
    WHERE len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.93
), reach AS (
    SELECT vec_id AS id, vec_id AS other FROM embeddings
    UNION
    SELECT reach.id, p.b FROM reach JOIN p ON reach.other = p.a
), c AS (
    SELECT id, min(other) AS component_id FROM reach GROUP BY id
), n AS (
    SELECT a, count(*) AS n_links FROM p GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

AUDIT = r"""
WITH t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), l AS (
    SELECT doc_id AS id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
        len(words) < 200,
        100 * len(list_distinct(words)) < 50 * len(words),
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
        regexp_matches(text, '[#$%&*|]'),
        coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)
    ] AS fails
    FROM t LEFT JOIN l ON l.id = t.doc_id
), c AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM f GROUP BY part, fails
), k AS (
    SELECT unnest(range(1, 6)) AS k
), orders AS (
    SELECT [a.k, b.k, c.k, d.k, e.k] AS o
    FROM k a, k b, k c, k d, k e
    WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (
    SELECT o, s.k AS step, o[s.k] AS own, o[1:s.k - 1] AS earlier FROM orders, k s
), r AS (
    SELECT part, o, step, own,
           CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails[own]), 0) AS BIGINT) AS kept,
           CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND fails[own]), 0) AS BIGINT) AS removed,
           CAST(coalesce(sum(n) FILTER (WHERE gone AND fails[own]), 0) AS BIGINT) AS redundant,
           CAST(coalesce(sum(n) FILTER (WHERE fails[own] AND list_count(list_filter(fails, lambda x: x)) = 1), 0) AS BIGINT)
               AS unique_fails,
           CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND fails[own]), 0) AS BIGINT) AS good_lost,
           CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails[own]), 0) AS BIGINT) AS toxic_lost
    FROM (
        SELECT *, len(list_filter(earlier, lambda e: fails[e])) > 0 AS gone FROM c, steps
    )
    GROUP BY part, o, step, own
)
SELECT part, list_aggregate(list_transform(o, lambda x: chr(CAST(64 + x AS INTEGER))), 'string_agg', '') AS filter_order,
       CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


def _step(bits: str) -> str:
    """One bit of CRC-32 for a table of remainders."""
    return f"SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) AS c FROM ({bits})"


_REMAINDERS = "SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c FROM range(256)"
for _ in range(8):
    _REMAINDERS = _step(_REMAINDERS)


def _more(value: str, cost: str, edit: str) -> str:
    """A path, its cost in nine digits and its edits, with one edit more."""
    return f"lpad(CAST(CAST(substr({value}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({value}, 10) || '{edit}'"


def _inserted(ask: str, answer: str, begin: str, system: str) -> str:
    """After insertions: paths by state as begin, system, ask (answered) and answer (asked)."""
    asked = f"least({answer}, {_more(begin, '3', 'I')}, {_more(system, '3', 'I')}, {_more(ask, '3', 'I')})"
    both = f"least({ask}, {_more(answer, '3', 'I')}, {_more(begin, '6', 'II')}, {_more(system, '6', 'II')})"
    return f"{begin} AS e0, {system} AS e1, {asked} AS e2, {both} AS e3"


#: No path: dearer than any.
_NONE = "'900000000'"

REPAIR = rf"""
WITH RECURSIVE table_of AS (
    SELECT list(c ORDER BY i) AS remainders FROM ({_REMAINDERS})
), spaced AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
    FROM conversations
), dealt AS (
    SELECT s.*, xor(list_reduce(
            [4294967295] || list_transform(string_split(place, ''), lambda x: CAST(ascii(x) AS BIGINT)),
            lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS deal
    FROM spaced s, table_of
), damaged AS (
    SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
           CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN deal = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM dealt WHERE deal <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS spot,
           count(*) OVER (PARTITION BY conv_id) AS n,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
           NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS empty,
           NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open_end,
           lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS earlier
    FROM damaged
), faulty AS (
    SELECT conv_id, turn, role, text, spot, n, empty OR again AS bad, substr(role, 1, 1) AS initial,
           empty AS blank, NOT empty AND again AS duplicate, NOT empty AND NOT again AND open_end AS truncated,
           earlier IS NOT NULL AND substr(earlier, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal
    FROM placed
), walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS spot, n, '000000000' AS v0, {_NONE} AS v1, {_NONE} AS v2, {_NONE} AS v3
    FROM faulty WHERE spot = 1
    UNION ALL
    SELECT conv_id, spot, n,
           {_more('e0', '4', 'D')},
           least({_more('e1', '4', 'D')}, CASE WHEN keeps AND initial = 's' THEN {_more('e0', 'cut', 'K')} ELSE {_NONE} END),
           least({_more('e2', '4', 'D')},
               CASE WHEN keeps AND initial = 'u' THEN least({_more('e0', 'cut', 'K')}, {_more('e1', 'cut', 'K')},
                   {_more('e3', 'cut', 'K')}) ELSE {_NONE} END,
               CASE WHEN keeps THEN least({_more('e0', '(3 + cut)', 'R')}, {_more('e1', '(3 + cut)', 'R')},
                   {_more('e3', '(3 + cut)', 'R')}) ELSE {_NONE} END),
           least({_more('e3', '4', 'D')},
               CASE WHEN keeps AND initial = 'a' THEN {_more('e2', 'cut', 'K')} ELSE {_NONE} END,
               CASE WHEN keeps THEN {_more('e2', '(3 + cut)', 'R')} ELSE {_NONE} END)
    FROM (
        SELECT w.conv_id, f.spot, w.n, NOT f.bad AS keeps, f.initial, CASE WHEN f.truncated THEN 3 ELSE 0 END AS cut,
               {_inserted('v3', 'v2', 'v0', 'v1')}
        FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.spot = w.spot + 1
    )
), best AS (
    SELECT conv_id, least(e0, e3) AS path
    FROM (SELECT conv_id, {_inserted('v3', 'v2', 'v0', 'v1')} FROM walk WHERE spot = n)
), letters AS (
    SELECT conv_id, unnest(range(1, length(path) - 8)) AS k, path FROM best
), edits AS (
    SELECT *, substr(path, CAST(k + 9 AS BIGINT), 1) AS edit, length(replace(substr(path, 10, CAST(k AS BIGINT)), 'I', '')) AS row_at,
           length(replace(substr(path, 10, CAST(k AS BIGINT)), 'D', '')) AS line
    FROM letters
), rolled AS (
    SELECT e.conv_id, e.line, e.edit, f.role, f.text,
           CASE WHEN first_value(e.edit) OVER w = 'K' AND first_value(f.initial) OVER w = 's' THEN 1 ELSE 0 END AS system
    FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.spot = e.row_at AND e.edit <> 'I'
    WHERE e.edit <> 'D'
    WINDOW w AS (PARTITION BY e.conv_id ORDER BY e.line)
), lines AS (
    SELECT conv_id, line, CASE WHEN edit = 'K' THEN role WHEN (line - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS said
    FROM rolled
), texts AS (
    SELECT conv_id, string_agg(said, chr(10) ORDER BY line) AS whole FROM lines GROUP BY conv_id
), faults AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
           count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
    FROM faulty GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(substr(path, 1, 9) AS BIGINT), 0) AS BIGINT) AS cost,
       coalesce(substr(path, 10), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM o.conv_id
"""
