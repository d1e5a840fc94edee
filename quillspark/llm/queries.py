"""The registered queries of this subpackage."""

from __future__ import annotations

from . import bpe, decontaminate, forest, langid, licenses, ngram_join, pii, quality, sharding, shared_terms, spelling, token_counts, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_llr,
        toxicity.op2_toxicity_zstd,
        pii.op3_pii_feistel,
        token_counts.op4_token_histogram,
        ngram_join.op5_jaccard_heavy_light,
        bpe.op6_bpe_monoid,
        decontaminate.op7_decontaminate_cgk,
        sharding.op8_hilbert_shards,
        licenses.op9_license_fuzzy,
        langid.op10_langid_nb,
        forest.op11_minhash_forest,
        shared_terms.op12_shared_terms,
        spelling.op13_spelling_variants,
    )
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"



def _classes_sql(width: int, percent: int, more: str = "") -> str:
    """Rows of doc_id, n_shingles and component_id for links between sets of shingles."""
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
      sets AS (SELECT doc_id, CASE WHEN len(w) >= {width} THEN list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
      shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
      pairs AS (SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
      links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
      reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.r)
      SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id{more} FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


#: The others compute hashes, dictionaries or encodings that DuckDB has not; tests/llm hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_heavy_light": _classes_sql(5, 75),
    "op11_minhash_forest": _classes_sql(4, 80, ", doc_id = component_id AS kept"),
    "op12_shared_terms": f"""WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS t FROM documents),
      wanted AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS t FROM benchmark) GROUP BY item_id, t),
      sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
      whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM sizes),
      tfs AS (SELECT doc_id, t, count(*) AS tf FROM terms WHERE t IN (SELECT t FROM wanted) GROUP BY doc_id, t),
      weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tfs GROUP BY t), whole),
      impacts AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))) AS impact FROM tfs JOIN sizes USING (doc_id) JOIN weights USING (t), whole),
      scores AS (SELECT item_id, doc_id, CAST(sum(k * impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (t) GROUP BY item_id, doc_id)
      SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10""",
}
