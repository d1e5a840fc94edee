"""SQL that cuts texts into chunks step by step, for the queries over chunks."""

from __future__ import annotations

from ..functions import constants as K

#: White space at the ends of lines.
_W = "' ' || chr(9) || chr(10) || chr(13)"
_NO_END = "(^|[^\\p{L}\\p{N}_])(" + "|".join(K.ABBREVIATIONS) + "|[A-Z])\\."


def blocks(docs: str) -> str:
    """CTE blocks: the lines of docs (doc_id, text) that aren't blank and no headings, with offsets and the path of headings above."""
    before = "OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    levels = ", ".join(f"max(CASE WHEN lvl = {k} THEN i END) {before} AS p{k}, last_value(CASE WHEN lvl = {k} THEN title END IGNORE NULLS) {before} AS t{k}" for k in range(1, 7))
    above = lambda k: f"greatest(-1, {', '.join(f'coalesce(p{j}, -1)' for j in range(1, k))})" if k > 1 else "-1"
    path = ", ".join(f"CASE WHEN p{k} > {above(k)} THEN t{k} END" for k in range(1, 7))
    return f"""split AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {docs})),
    placed AS (SELECT *, trim(line, {_W}) AS bare, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(line) - length(ltrim(line, {_W})) AS offs FROM split),
    leveled AS (SELECT *, CASE WHEN regexp_matches(bare, '^#{{1,6}}\\s+.*\\S') THEN length(regexp_extract(bare, '^#+')) END AS lvl, regexp_extract(bare, '^#{{1,6}}\\s+(.*\\S)', 1) AS title FROM placed),
    stacked AS (SELECT *, {levels} FROM leveled),
    blocks AS (SELECT doc_id, i, bare AS text, offs AS start_char, offs + length(bare) AS end_char, nullif(concat_ws(' > ', {path}), '') AS path FROM stacked WHERE lvl IS NULL AND bare <> '')"""


def chunks(docs: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, least: int = K.LEAST_CHUNK) -> str:
    """CTE chunks of docs (doc_id, text): doc_id, chunk_index, total_chunks, start_char, end_char, heading_path, text."""
    guarded = f"regexp_replace(regexp_replace(text, '{_NO_END}', '\\1\\2' || chr(1), 'g'), '{_NO_END}', '\\1\\2' || chr(1), 'g')"
    sentences = f"list_filter(list_transform(string_split(regexp_replace({guarded}, '([.!?])(\\s|$)', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'), {_W})), lambda s: s <> '')"
    last = lambda c: f"CASE WHEN contains(rest[1:{size}], '{c}') THEN {size} - strpos(reverse(rest[1:{size}]), '{c}') ELSE -1 END"
    return f"""{blocks(docs)},
    sentences AS (SELECT doc_id, i, generate_subscripts(s, 1) AS n, unnest(s) AS sentence FROM (SELECT doc_id, i, {sentences} AS s FROM blocks WHERE length(text) > {size})),
    cut AS (SELECT doc_id, i, n, 0 AS k, NULL::VARCHAR AS part, sentence AS rest FROM sentences
      UNION ALL SELECT doc_id, i, n, k + 1, CASE WHEN length(rest) <= {size} THEN rest ELSE trim(rest[1:stop], {_W}) END, CASE WHEN length(rest) <= {size} THEN NULL ELSE trim(rest[stop + 1:], {_W}) END
      FROM (SELECT *, CASE WHEN found < {size // 2} THEN {size} ELSE found END AS stop FROM (SELECT *, greatest({last(" ")}, {last(",")}, {last("，")}) AS found FROM cut WHERE rest IS NOT NULL))),
    parts AS (SELECT c.doc_id, c.i, n, k, part AS text, CAST(start_char + coalesce(sum(length(part)) OVER (PARTITION BY c.doc_id, c.i ORDER BY n, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, path FROM cut c JOIN blocks USING (doc_id, i) WHERE part <> ''),
    pieces AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, n, k) AS step FROM (
      SELECT doc_id, i, 0 AS n, 0 AS k, text, start_char, end_char, path FROM blocks WHERE length(text) <= {size}
      UNION ALL SELECT doc_id, i, n, k, text, start_char, start_char + length(text), path FROM parts)),
    pack AS (SELECT doc_id, 1 AS step, NULL::VARCHAR AS done, NULL::BIGINT AS done_start, NULL::BIGINT AS done_end, NULL::VARCHAR AS done_path, text AS held, start_char AS held_start, end_char AS held_end, path AS held_path, length(text) + 1 AS n FROM pieces WHERE step = 1
      UNION ALL SELECT doc_id, step, CASE WHEN flush THEN held END, held_start, held_end, held_path,
        CASE WHEN seeded THEN seed || chr(10) || text WHEN flush THEN text ELSE held || chr(10) || text END, CASE WHEN seeded THEN greatest(0, held_end - length(seed)) WHEN flush THEN start_char ELSE held_start END, end_char, path,
        CASE WHEN seeded THEN length(seed) WHEN flush THEN 0 ELSE n END + length(text) + 1
      FROM (SELECT *, full_up AND seed <> '' AND length(seed) + length(text) + 1 <= {size} AS seeded FROM (
        SELECT *, trim(CASE WHEN length(held) > {overlap} AND gap BETWEEN 1 AND length(last) - 1 THEN last[gap + 1:] ELSE last END, {_W}) AS seed FROM (
        SELECT *, changed OR full_up AS flush, greatest(strpos(last, ' '), strpos(last, chr(10))) AS gap FROM (
        SELECT p.*, f.held, f.held_start, f.held_end, f.held_path, f.n AS n, held_path IS DISTINCT FROM path AS changed, held_path IS NOT DISTINCT FROM path AND f.n + length(text) + 1 > {size} AS full_up, right(held, {overlap}) AS last
        FROM pack f JOIN (SELECT doc_id, step, text, start_char, end_char, path FROM pieces) p ON p.doc_id = f.doc_id AND p.step = f.step + 1))))),
    rough AS (SELECT doc_id, done AS text, done_start AS start_char, done_end AS end_char, done_path AS path, step FROM pack WHERE done IS NOT NULL
      UNION ALL SELECT doc_id, held, held_start, held_end, held_path, step + 1 FROM pack QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) = 1),
    todo AS (SELECT *, row_number() OVER o AS k, lead(text) OVER o AS next_text, lead(path) OVER o AS next_path FROM rough WINDOW o AS (PARTITION BY doc_id ORDER BY step)),
    merge AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, NULL::VARCHAR AS done, NULL::BIGINT AS done_start, NULL::BIGINT AS done_end, NULL::VARCHAR AS done_path, NULL::VARCHAR AS held, NULL::BIGINT AS held_start, NULL::BIGINT AS held_end, NULL::VARCHAR AS held_path, NULL::VARCHAR AS carry, NULL::BIGINT AS carry_start FROM (SELECT DISTINCT doc_id FROM todo)
      UNION ALL SELECT doc_id, k, CASE WHEN way = 'new' THEN held END, held_start, held_end, held_path,
        CASE way WHEN 'back' THEN held || chr(10) || c WHEN 'on' THEN held ELSE c END, CASE way WHEN 'new' THEN c_start ELSE held_start END, CASE way WHEN 'on' THEN held_end ELSE end_char END, CASE way WHEN 'new' THEN path ELSE held_path END,
        CASE WHEN way = 'on' THEN c END, CASE WHEN way = 'on' THEN c_start END
      FROM (SELECT *, CASE WHEN length(c) < {least} AND held IS NOT NULL AND held_path IS NOT DISTINCT FROM path AND length(held) + length(c) + 1 <= {size} THEN 'back' WHEN length(c) < {least} AND next_text IS NOT NULL AND next_path IS NOT DISTINCT FROM path AND length(c) + length(next_text) + 1 <= {size} THEN 'on' ELSE 'new' END AS way FROM (
        SELECT t.*, m.held, m.held_start, m.held_end, m.held_path, CASE WHEN carry IS NULL THEN text ELSE carry || chr(10) || text END AS c, coalesce(carry_start, start_char) AS c_start FROM merge m JOIN todo t ON t.doc_id = m.doc_id AND t.k = m.k + 1))),
    chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, start_char, end_char, path AS heading_path, text FROM (
      SELECT doc_id, k, done AS text, done_start AS start_char, done_end AS end_char, done_path AS path FROM merge WHERE done IS NOT NULL
      UNION ALL (SELECT doc_id, k + 1, held, held_start, held_end, held_path FROM merge WHERE held IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1)))"""


#: Texts whose short lines are headings: a short first line is the title, others are sections.
MARKED = "(SELECT doc_id, regexp_replace(regexp_replace(text, '^([^\\n#]{1,40})(\\n|$)', '# \\1\\2'), '(?m)^([^\\n#]{1,40})$', '## \\1', 'g') AS text FROM documents)"
