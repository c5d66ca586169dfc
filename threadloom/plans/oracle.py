"""SQL twins of the engine's queries, for DuckDB over the same tables.

They state the semantics a second time with other means: window functions, lists and
regular expressions of that engine, no code shared with the operators but the literals.
"""

from __future__ import annotations

from ..functions.text import IDEOGRAPHS, fragments, ngram_list, strip_literal, word_list

QUERY, ONE_CHAR, LITERAL, PHRASE = "eronts", "w", "the haing there the", "of the"
SESSION, WORKSPACE, SEMANTIC_MIN = "3", "/ws/1", 0.2

_SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve")


def toy_vocabulary() -> dict[str, int]:
    """Special tokens at their fixed ids, then letters and common syllables with continuations."""
    out = {"[PAD]": 0, "[UNK]": 100, "[CLS]": 101, "[SEP]": 102, "[MASK]": 103}
    for t in [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,", *_SYLLABLES]:
        for piece in (t, "##" + t):
            out[piece] = 200 + len(out)
    return out


_WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _strip(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{N}}]', '', 'g')"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_WS}+', ' ', 'g'))"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _grams(c: str, n: int) -> str:
    return f"list_transform(range(1, length({c}) - {n} + 2), lambda i: substring({c}, i, {n}))"


def _words(c: str) -> str:
    return rf"regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '[\p{{L}}\p{{N}}]+')"


_BASE = f"""
ev AS (
  SELECT conv_id AS session_no, conv_id::VARCHAR AS session_id, '/ws/' || (conv_id % 4) AS cwd, 1700000000000 + conv_id * 100000000 AS created_at,
         turn AS seq, role || '/message' AS type, 1700000000000 + conv_id * 100000000 + turn * 60000 AS time, text FROM conversations),
un AS (
  SELECT session_no, session_id, cwd, created_at, seq, type, time, {_trim('text')} AS text, {_strip('text')} AS norm FROM ev
  WHERE type IN ('user/message', 'assistant/message') AND {_strip('text')} <> ''),
docs AS (SELECT row_number() OVER (ORDER BY session_no, seq) AS rowid, * FROM un)"""


def _sql(body: str, ctes: str = "") -> str:
    return f"WITH {_BASE}{', ' + ctes if ctes else ''}\n{body}"


def _trigram_match(norm: str) -> str:
    return "(" + " OR ".join(f"contains(lower({norm}), '{g.lower()}')" for g in ngram_list(strip_literal(QUERY), 3)) + ")"


def _like_hits(text: str) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains(translate({text}, {_AZ}), '{g.lower()}') THEN 1 ELSE 0 END)" for g in ngram_list(strip_literal(QUERY), 2)) + ")"


def _score(norm: str, q: str = QUERY) -> str:
    q = strip_literal(q)
    prefix = f"substring({norm}, 1, 1000)"

    def share(n: int) -> str:
        grams = ngram_list(q, n)
        return "(" + " + ".join(f"(CASE WHEN contains({prefix}, '{g}') THEN 1 ELSE 0 END)" for g in grams) + f") / {len(grams)}::DOUBLE"

    base = f"(0.7::DOUBLE * {share(2)} + 0.3::DOUBLE * {share(3)})"
    return f"round(CASE WHEN contains({prefix}, '{q}') THEN greatest({base}, 0.9::DOUBLE) ELSE {base} END, 6)"


_CANDIDATE = f"({_trigram_match('norm')} OR {_like_hits('text')} > 0)"


def _hits(limit: int, where: str = "true", least: float = 0.15) -> str:
    return f"SELECT * FROM (SELECT *, {_score('norm')} AS score FROM docs WHERE {_CANDIDATE} AND {where}) WHERE score >= {least}::DOUBLE ORDER BY score DESC, rowid LIMIT {limit}"


def _snippet(c: str, q: str = QUERY) -> str:
    clean = _norm(c)
    at = "CASE " + " ".join(f"WHEN contains(t, '{f}') THEN instr(t, '{f}') - 1" for f in fragments(q)) + " ELSE 0 END"
    return f"""(SELECT CASE WHEN length(t) <= 240 THEN t ELSE
      (CASE WHEN s > 0 THEN '…' ELSE '' END) || substring(t, s + 1, least(length(t), s + 239 - (CASE WHEN s > 0 THEN 1 ELSE 0 END)) - s)
      || (CASE WHEN least(length(t), s + 239 - (CASE WHEN s > 0 THEN 1 ELSE 0 END)) < length(t) THEN '…' ELSE '' END) END
      FROM (SELECT t, greatest(0, spot - 80) AS s FROM (SELECT t, {at} AS spot FROM (SELECT {clean} AS t))))"""


_PHRASE = "".join(f" {w} " for w in word_list(PHRASE))
_PADDED = f"(' ' || array_to_string({_words('text')}, '  ') || ' ')"
_SPANS = f"((length({_PADDED}) - length(replace({_PADDED}, '{_PHRASE}', ''))) // {len(_PHRASE)})"

_VEC = "vec AS (SELECT vec_id + 1 AS rowid, embedding::DOUBLE[] AS vec, label, vec_id FROM embeddings), q AS (SELECT vec AS qv FROM vec WHERE rowid = 1)"
_SEM = f"""sem AS (SELECT * FROM (SELECT docs.*, round(list_dot_product(vec, qv), 4) AS score FROM vec JOIN docs USING (rowid), q)
  WHERE score >= {SEMANTIC_MIN}::DOUBLE ORDER BY score DESC, rowid LIMIT 30)"""
_COVER = """cover AS (SELECT (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM docs WHERE rowid IN (SELECT rowid FROM vec)) AS embedded)"""
_FUZ = f"fuz AS ({_hits(30)})"
_MERGED = """merged AS (SELECT rowid, max(score) AS score FROM (SELECT rowid, score FROM sem UNION ALL SELECT rowid, score FROM fuz)
  GROUP BY rowid ORDER BY score DESC, rowid LIMIT 20), mh AS (SELECT docs.*, merged.score FROM merged JOIN docs USING (rowid))"""


def _islands(hits: str) -> str:
    return f"""isl AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY rowid) AS run FROM (
      SELECT *, CASE WHEN rowid - lag(rowid) OVER (PARTITION BY session_id ORDER BY rowid) <= 5 THEN 0 ELSE 1 END AS new FROM {hits})),
    per AS (SELECT session_id, run, first(seq ORDER BY rowid) AS start_seq, last(seq ORDER BY rowid) AS end_seq, count(*) AS hit_count,
      first(text ORDER BY score DESC, rowid) AS text, max(score) AS score FROM isl GROUP BY session_id, run),
    epi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, run) AS episode FROM per) WHERE episode <= 3)"""


_GROUPS = f"""{_VEC}, {_SEM}, {_FUZ}, {_MERGED}, {_islands('mh')},
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, rowid) AS position FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, rowid) AS rn FROM mh) WHERE rn = 1)),
lst AS (SELECT session_id, string_agg(start_seq || ':' || end_seq || ':' || hit_count, ' ' ORDER BY episode) AS events,
  string_agg('[' || start_seq || '..' || end_seq || ']×' || hit_count, ', ' ORDER BY episode) AS spans, count(*) AS n,
  first(text ORDER BY episode) AS best FROM epi GROUP BY session_id),
grp AS (SELECT position, session_id, cwd, created_at, time AS hit_time, {_snippet('best')} AS snippet, events, spans, n FROM top JOIN lst USING (session_id) WHERE position <= 10)"""

_PREV = "prev AS (SELECT * FROM ev WHERE session_no % 7 <> 1 AND (session_no % 5 <> 0 OR seq < 3))"


def _fp(table: str) -> str:
    return f"SELECT session_no, session_id AS id, count(*) AS n_events, count(*) || ':' || max(seq) || ':' || max_by(time, seq) || ':' || max_by(type, seq) AS fingerprint FROM {table} GROUP BY 1, 2"


_STATE = f"""{_PREV}, oldfp AS ({_fp('prev')}), nowfp AS ({_fp('ev')}),
oldmax AS (SELECT session_id AS id, max(seq) AS max_seq FROM prev WHERE type IN ('user/message', 'assistant/message') AND {_strip('text')} <> '' GROUP BY 1),
stored AS (
  SELECT id, CASE WHEN session_no % 2 = 0 THEN fingerprint END AS fingerprint,
    CASE WHEN session_no % 2 = 1 THEN 'r' || n_events WHEN session_no % 11 = 0 THEN 'stale' END AS revision, coalesce(max_seq, -1) AS max_seq
  FROM oldfp LEFT JOIN oldmax USING (id)
  UNION ALL SELECT 'old-' || id, fingerprint, NULL, 9 FROM oldfp WHERE session_no % 7 = 0),
live AS (SELECT id, fingerprint FROM nowfp WHERE session_no % 2 = 0),
snap AS (SELECT id, 'r' || n_events AS revision FROM nowfp WHERE session_no % 2 = 1),
cls AS (
  SELECT id, stored.id IS NOT NULL AS has_row, live.id IS NOT NULL AS is_live, snap.id IS NOT NULL AS is_snap, stored.fingerprint AS ofp, stored.revision AS orev,
    max_seq, live.fingerprint AS lfp, snap.revision AS srev
  FROM stored FULL JOIN live USING (id) FULL JOIN snap USING (id)),
act AS (SELECT *, CASE
    WHEN is_live AND (NOT has_row OR ofp IS DISTINCT FROM lfp) THEN 'reindex'
    WHEN is_live AND orev IS DISTINCT FROM srev THEN 'meta' WHEN is_live THEN 'skip'
    WHEN is_snap AND (NOT has_row OR orev IS DISTINCT FROM srev) THEN 'reindex' WHEN is_snap THEN 'skip' ELSE 'removed' END AS action FROM cls),
plan AS (SELECT id, action, CASE WHEN action = 'reindex' THEN CASE WHEN is_live THEN lfp END ELSE ofp END AS fingerprint,
    CASE WHEN action IN ('reindex', 'meta') THEN srev ELSE orev END AS revision,
    CASE WHEN action = 'reindex' THEN CASE WHEN NOT has_row OR (ofp IS NULL AND NOT is_live) THEN -1 ELSE coalesce(max_seq, -1) END END AS from_seq FROM act)"""

_ALOG = """alog AS (SELECT user_id::VARCHAR AS session_id, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'summary' WHEN 'view' THEN 'assembly' WHEN 'error' THEN 'disposed' END AS kind
  FROM events WHERE event_type IN ('signup', 'view', 'error'))"""
_FRAG = f"""summ AS (SELECT session_id, max(seq) + 1 AS "at", max(seq) AS high FROM ev GROUP BY 1),
frag AS (SELECT * FROM (SELECT session_id, "at", seq, type, {_norm('text')} AS text,
    row_number() OVER (PARTITION BY session_id, "at" ORDER BY CASE WHEN type = 'user/message' THEN 0 ELSE 1 END, length({_norm('text')}) DESC, seq) AS rank
  FROM summ JOIN ev USING (session_id) WHERE seq BETWEEN 0 AND high AND type IN ('user/message', 'assistant/message') AND {_trim('text')} <> '') WHERE rank <= 3)"""
_RANK = """rk0 AS (SELECT source AS qid, doc_id::VARCHAR AS key, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
rk AS (SELECT * FROM rk0 WHERE rank <= 20 UNION ALL SELECT 'src1-none', key, rank FROM rk0 WHERE rank <= 6 AND qid = 'src1'),
rel AS (SELECT source AS qid, doc_id::VARCHAR AS key FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
cnt AS (SELECT qid, count(*) AS n FROM rel GROUP BY 1),
met AS (SELECT cnt.qid, round(count(*) FILTER (rank <= 5) / max(n)::DOUBLE, 6) AS recall5, round(count(*) FILTER (rank <= 10) / max(n)::DOUBLE, 6) AS recall10,
    round(coalesce(1::DOUBLE / min(rank), 0), 6) AS mrr,
    round(sum(coalesce(1 / log2(rank + 1), 0)) / max((SELECT sum(1 / log2(i + 1)) FROM unnest(range(1, n + 1)) AS u(i))), 6) AS ndcg
  FROM cnt JOIN rel USING (qid) LEFT JOIN rk USING (qid, key) GROUP BY cnt.qid)"""

_RANGES = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in IDEOGRAPHS)
_BERT = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}]', '', 'g'), '{_WS}', ' ', 'g'), "
    f"'([^ ])([{_RANGES}])', '\\1 \\2', 'g'), '([{_RANGES}])', '\\1 ', 'g')"
)
_PUNCT = r"\pP!-/:-@\[-`{-~"
_PIECES = "|".join(_SYLLABLES) + "|[a-zA-Z.,]"
_WP = f"""wp AS (SELECT rowid, array_to_string(list_transform(t, lambda w: CASE WHEN length(w) <= 100 AND regexp_full_match(w, '[a-zA-Z.,]+')
    THEN array_to_string(list_transform(regexp_extract_all(w, '{_PIECES}'), lambda p, k: CASE WHEN k = 1 THEN p ELSE '##' || p END), ' ') ELSE '[UNK]' END), ' ') AS tokens
  FROM (SELECT rowid, regexp_extract_all(trim({_BERT}), '[^\\s{_PUNCT}]+|[{_PUNCT}]') AS t FROM docs))"""
_IDS = ", ".join(f"('{p}', {i})" for p, i in toy_vocabulary().items())
_RAW_TYPE = "CASE WHEN type = 'system/message' THEN 'tool/call' ELSE type END"

_APPLIED = _STATE + f""", olddocs AS (SELECT session_id, seq, {_trim('text')} AS text FROM (SELECT * FROM prev UNION ALL
  SELECT session_no, 'old-' || session_id, cwd, created_at, seq, type, time, text FROM prev WHERE session_no % 7 = 0)
  WHERE type IN ('user/message', 'assistant/message') AND {_strip('text')} <> ''),
applied AS (SELECT session_id, seq, text FROM olddocs WHERE session_id NOT IN (SELECT id FROM plan WHERE action = 'removed' OR from_seq = -1)
  UNION ALL SELECT session_id, seq, text FROM un JOIN plan ON id = session_id WHERE action = 'reindex' AND seq > from_seq)"""

_BATCH = f"""qs AS (SELECT item_id AS qid, {_strip('text')} AS q FROM benchmark),
qg AS (SELECT qid, q, list_distinct({_grams('q', 2)}) AS b, list_distinct({_grams('q', 3)}) AS t FROM qs WHERE length(q) >= 2),
pr AS (SELECT qid, q, rowid, text, norm, substring(norm, 1, 1000) AS p, b, t FROM qg, docs),
sc AS (SELECT qid, q, rowid, text, norm, p, b, t, 0.7::DOUBLE * len(list_filter(b, lambda g: contains(p, g))) / len(b)
    + CASE WHEN len(t) > 0 THEN 0.3::DOUBLE * len(list_filter(t, lambda g: contains(p, g))) / len(t) ELSE 0 END AS s FROM pr),
fin AS (SELECT qid, rowid, round(CASE WHEN contains(p, q) THEN greatest(s, 0.9::DOUBLE) ELSE s END, 6) AS score FROM sc
  WHERE s >= 0.15 AND (len(list_filter(t, lambda g: contains(lower(norm), lower(g)))) > 0
    OR len(list_filter(b, lambda g: contains(translate(text, {_AZ}), translate(g, {_AZ})))) > 0))"""

SQL: dict[str, str] = {
    "src_live_sessions": _sql("SELECT session_id, cwd, created_at, count(*) AS n_events, max(seq) AS last_seq FROM ev WHERE session_no % 2 = 0 GROUP BY 1, 2, 3"),
    "src_snapshots": _sql("SELECT session_id, cwd, 'r' || count(*) AS revision FROM ev WHERE session_no % 2 = 1 GROUP BY 1, 2"),
    "strip_text": _sql(f"SELECT session_id, seq, {_strip('text')} AS stripped FROM ev"),
    "norm_text": _sql(f"SELECT session_id, seq, {_norm('text')} AS norm FROM ev"),
    "char_stats": _sql(f"SELECT session_id, seq, length(text) AS n_raw, length(s) AS n_stripped, substring(s, 1, 1) AS first, right(s, 1) AS last FROM (SELECT *, {_strip('text')} AS s FROM ev)"),
    "ngrams": _sql(f"SELECT session_id, seq, array_to_string({_grams('s', 3)}, ' ') AS grams FROM (SELECT *, {_strip('text')} AS s FROM ev)"),
    "distinct_ngrams": _sql(f"SELECT session_id, seq, len(g) AS n, array_to_string(list_sort(g), ' ') AS grams FROM (SELECT *, list_distinct({_grams('s', 2)}) AS g FROM (SELECT *, {_strip('text')} AS s FROM ev))"),
    "extract_text": _sql(f"SELECT session_id, seq, {_RAW_TYPE} AS type, CASE type WHEN 'user/message' THEN {_trim('text')} WHEN 'assistant/message' THEN {_trim('text')} || chr(10) || {_trim('text')} ELSE '' END AS text FROM ev"),
    "event_display_text": _sql(f"SELECT session_id, seq, {_RAW_TYPE} AS type, CASE type WHEN 'user/message' THEN ' ' || text || chr(10) WHEN 'assistant/message' THEN ' ' || text || '  ' || text ELSE '[tool:read] {{' || seq || '}}' END AS text FROM ev"),
    "snippet": _sql(f"SELECT session_id, seq, {_snippet('text')} AS snippet FROM un"),
    "bert_normalize": _sql(f"SELECT session_id, seq, {_BERT} AS normalized FROM ev"),
    "pre_tokenize": _sql(f"SELECT session_id, seq, len(t) AS n, array_to_string(t, '|') AS tokens FROM (SELECT *, regexp_extract_all(trim({_BERT}), '[^\\s{_PUNCT}]+|[{_PUNCT}]') AS t FROM ev)"),
    "idx_build_docs": _sql("SELECT rowid, session_id, seq, type, time, norm FROM docs"),
    "docs_with_sessions": _sql("SELECT rowid, session_id, seq, s_cwd, s_created FROM docs JOIN (SELECT session_id, min(cwd) AS s_cwd, min(created_at) AS s_created FROM ev GROUP BY 1) USING (session_id)"),
    "index_stats": _sql("SELECT (SELECT count(DISTINCT session_id) FROM ev) AS sessions, (SELECT count(*) FROM un) AS docs"),
    "session_max_seq": _sql("SELECT session_id AS id, max(seq) AS max_seq FROM un GROUP BY 1"),
    "session_fingerprint": _sql(f"SELECT id, fingerprint FROM ({_fp('ev')})"),
    "idx_reconcile_plan": _sql("SELECT * FROM plan", _STATE),
    "idx_removed_sessions": _sql("SELECT id FROM stored WHERE id NOT IN (SELECT id FROM live UNION ALL SELECT id FROM snap)", _STATE),
    "idx_append_delta": _sql("SELECT session_id, seq, type FROM un LEFT JOIN stored ON id = session_id WHERE seq > coalesce(max_seq, -1)", _STATE),
    "idx_reconcile_apply": _sql("SELECT session_id, count(*) AS n_docs, max(seq) AS max_seq, sum(length(text))::BIGINT AS chars FROM applied GROUP BY 1", _APPLIED),
    "idx_reconcile_commit": _sql(
        f"""SELECT a.*, p.fingerprint, p.revision FROM (SELECT session_id, count(*) AS n_docs, max(seq) AS max_seq, sum(length(text))::BIGINT AS chars,
          sum(len({_words('text')}))::BIGINT AS n_words FROM applied GROUP BY 1) a LEFT JOIN (SELECT * FROM plan WHERE action <> 'removed') p ON p.id = a.session_id""", _APPLIED
    ),
    "idx_stream_index": _sql(
        f"""SELECT session_id, count(*) AS n_docs, sum(length(norm))::BIGINT AS chars, max(seq) AS max_seq,
          sum(len(list_distinct({_grams('substring(norm, 1, 1000)', 2)})) + len(list_distinct({_grams('substring(norm, 1, 1000)', 3)})))::BIGINT AS n_postings FROM un GROUP BY 1"""
    ),
    "idx_upsert_sessions": _sql(
        "SELECT id, fingerprint, revision FROM stored WHERE id NOT IN (SELECT id FROM plan WHERE action IN ('reindex', 'meta')) "
        "UNION ALL SELECT id, fingerprint, revision FROM plan WHERE action IN ('reindex', 'meta')", _STATE,
    ),
    "cand_trigram": _sql(f"SELECT rowid, session_id, seq FROM docs WHERE {_trigram_match('norm')}"),
    "cand_bigram_like": _sql(f"SELECT rowid, {_like_hits('text')} AS like_hits FROM docs WHERE {_like_hits('text')} > 0"),
    "cand_single_char": _sql(f"SELECT rowid FROM docs WHERE contains(translate(text, {_AZ}), '{ONE_CHAR}')"),
    "cand_union": _sql(f"SELECT rowid FROM docs WHERE {_CANDIDATE}"),
    "fuzzy_score": _sql(f"SELECT rowid, {_score('norm')} AS score FROM docs"),
    "fuzzy_single_char": _sql(f"SELECT rowid, CASE WHEN contains(substring(norm, 1, 1000), '{ONE_CHAR}') THEN 0.8::DOUBLE ELSE 0::DOUBLE END AS score FROM docs"),
    "fuzzy_search": _sql(f"SELECT rowid, session_id, seq, score FROM ({_hits(20)})"),
    "fuzzy_batch": _sql("SELECT qid, rowid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) AS rank FROM fin) WHERE rank <= 20", _BATCH),
    "scope_all": _sql(f"SELECT rowid, session_id, cwd, score FROM ({_hits(30)})"),
    "scope_session": _sql(f"SELECT rowid, session_id, cwd, score FROM ({_hits(30, f"session_id = '{SESSION}'", 0.1)})"),
    "scope_workspace": _sql(f"SELECT rowid, session_id, cwd, score FROM ({_hits(30, f"cwd = '{WORKSPACE}'")})"),
    "literal_bm25": _sql(
        "SELECT rowid, session_id, seq, round(sum(m * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))), 6) AS score FROM part GROUP BY 1, 2, 3",
        f"""w AS (SELECT rowid, session_id, seq, {_words('text')} AS w FROM docs), st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean_len FROM w),
        qt AS (SELECT tok, count(*) AS m FROM unnest({word_list(LITERAL)!r}) AS u(tok) GROUP BY 1),
        tfs AS (SELECT rowid, session_id, seq, len(w) AS len, tok, m, len(list_filter(w, lambda x: x = tok)) AS tf FROM w, qt),
        dfs AS (SELECT tok, count(*)::DOUBLE AS df FROM tfs WHERE tf > 0 GROUP BY 1),
        part AS (SELECT tfs.*, mean_len, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf
          FROM tfs JOIN dfs USING (tok), st WHERE tf > 0)""",
    ),
    "literal_sessions": _sql(
        "SELECT session_id, sum(spans)::BIGINT AS spans, first(rowid ORDER BY spans DESC, rowid) AS best_rowid FROM sp GROUP BY 1 ORDER BY spans DESC, best_rowid LIMIT 50",
        f"sp AS (SELECT * FROM (SELECT rowid, session_id, {_SPANS} AS spans FROM docs) WHERE spans > 0)",
    ),
    "literal_events": _sql(f"SELECT rowid, seq, spans, 1::DOUBLE AS score FROM (SELECT rowid, seq, session_id, {_SPANS} AS spans FROM docs) WHERE spans > 0 AND session_id = '{SESSION}' ORDER BY rowid LIMIT 20"),
    "semantic_search": _sql("SELECT rowid, session_id, seq, score FROM sem", f"{_VEC}, {_SEM}"),
    "semantic_batch": _sql(
        f"""SELECT qid, rowid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) AS rank FROM (
          SELECT a.rowid AS qid, b.rowid, round(list_dot_product(a.vec, b.vec), 4) AS score FROM vec a, vec b WHERE a.vec_id % 50 = 0)
          WHERE score >= {SEMANTIC_MIN}::DOUBLE) WHERE rank <= 5""", _VEC,
    ),
    "vector_coverage": _sql("SELECT docs, embedded, round(least(1::DOUBLE, embedded / docs::DOUBLE), 6) AS coverage FROM cover", f"{_VEC}, {_COVER}"),
    "pending_vectors": _sql("SELECT rowid, length(text) AS chars FROM docs WHERE rowid NOT IN (SELECT rowid FROM vec WHERE rowid % 3 <> 0) ORDER BY rowid LIMIT 50", _VEC),
    "vec_store": f"WITH {_VEC}, v AS (SELECT rowid, vec[1] AS x FROM vec), n AS (SELECT rowid + 2 AS rowid, 9::DOUBLE AS x FROM v WHERE rowid % 4 = 0) SELECT rowid, round(x, 5) AS x FROM (SELECT * FROM v WHERE rowid NOT IN (SELECT rowid FROM n) UNION ALL SELECT * FROM n)",
    "warmup_batch": _sql("SELECT rowid, ((row_number() OVER (ORDER BY length(text), rowid)) - 1) // 16 AS batch FROM (SELECT rowid, text FROM docs WHERE rowid NOT IN (SELECT rowid FROM vec WHERE rowid % 3 <> 0) ORDER BY rowid LIMIT 64)", _VEC),
    "mean_pool_l2": """WITH t AS (SELECT label, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 END AS mask, embedding::DOUBLE[] AS v FROM embeddings),
        x AS (SELECT label, mask, unnest(v) AS x, unnest(range(0, len(v))) AS d FROM t),
        m AS (SELECT label, d, sum(x * mask) / greatest(sum(mask), 1) AS m FROM x GROUP BY 1, 2),
        n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1)
        SELECT label, d, round(m / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) + 0 AS x FROM m JOIN n USING (label)""",
    "hybrid_merge": _sql("SELECT rowid, session_id, score FROM mh", f"{_VEC}, {_SEM}, {_FUZ}, {_MERGED}"),
    "hybrid_gated": _sql(
        "SELECT rowid, session_id, score FROM mh",
        f"{_VEC}, {_COVER}, {_SEM.replace('sem AS', 'sem0 AS')}, sem AS (SELECT sem0.* FROM sem0, cover WHERE embedded / docs::DOUBLE >= 0.9), {_FUZ}, {_MERGED}",
    ),
    "recall_fallback": _sql(
        "SELECT session_id, 'literal' AS layer, sum(spans)::DOUBLE AS score FROM sp GROUP BY 1 ORDER BY score DESC, first(rowid ORDER BY spans DESC, rowid) LIMIT 10",
        f"sp AS (SELECT * FROM (SELECT rowid, session_id, {_SPANS} AS spans FROM docs) WHERE spans > 0)",
    ),
    "episodes": _sql(f"SELECT session_id, episode, start_seq, end_seq, hit_count, {_snippet('text')} AS snippet, score FROM epi", f"h AS ({_hits(100)}), {_islands('h')}"),
    "session_groups": _sql("SELECT position, session_id, cwd, created_at, hit_time, snippet, events FROM grp", _GROUPS),
    "title_enrich": _sql("SELECT session_id, min(cwd) AS cwd, CASE WHEN min(session_no) % 3 = 0 THEN 'Conversation ' || session_id END AS title FROM ev GROUP BY session_id"),
    "render_lines": _sql(
        """SELECT position, 1 AS line, '- ' || CASE WHEN session_id::BIGINT % 3 = 0 THEN 'Conversation ' || session_id || ' ' ELSE '' END || '(' || session_id || ', ' || cwd || ') — ' || snippet AS text FROM grp
        UNION ALL SELECT position, 2, '  ' || n || ' events: ' || spans FROM grp WHERE n > 1""", _GROUPS,
    ),
    "browse_page": _sql(
        f"SELECT seq, type, time, {_norm('text')} AS text, CASE WHEN count(*) OVER () = 3 THEN max(seq) OVER () + 1 END AS next_from_seq FROM (SELECT * FROM un WHERE session_id = '{SESSION}' AND seq >= 1 ORDER BY seq LIMIT 3)"
    ),
    "browse_seq_range": _sql(
        f"SELECT seq, type, time, {_norm('text')} AS text, CASE WHEN count(*) OVER () = 3 THEN 4 END AS next_from_seq FROM ev WHERE session_id = '{SESSION}' AND seq BETWEEN 1 AND 3"
    ),
    "seq_range_scan": _sql(f"SELECT seq, type, text FROM ev WHERE session_id = '{SESSION}' AND seq BETWEEN 1 AND 4"),
    "detail_window": _sql(
        f"""SELECT seq, type, time, {_norm('text')} AS text FROM (SELECT *, row_number() OVER (ORDER BY seq) AS pos FROM ev WHERE session_id = '{SESSION}')
        WHERE pos BETWEEN (SELECT count(*) FROM ev WHERE session_id = '{SESSION}' AND seq <= 2) - 2 AND (SELECT count(*) FROM ev WHERE session_id = '{SESSION}' AND seq <= 2) + 2"""
    ),
    "detail_hits": _sql(f"SELECT seq, type, time, {_snippet('text')} AS text, score FROM ({_hits(30, f"session_id = '{SESSION}'", 0.1)})"),
    "anchor_active": f"""WITH {_ALOG}, r AS (SELECT *, max(CASE WHEN kind <> 'assembly' THEN seq END) OVER (PARTITION BY session_id ORDER BY seq) AS anchor_seq FROM alog),
        c AS (SELECT r.*, a.kind AS reset, sum(CASE WHEN r.kind = 'assembly' THEN 1 ELSE 0 END) OVER (PARTITION BY r.session_id, r.anchor_seq ORDER BY r.seq) AS round
          FROM r JOIN alog a ON a.session_id = r.session_id AND a.seq = r.anchor_seq)
        SELECT session_id, seq, anchor_seq, round::BIGINT AS round FROM c WHERE kind = 'assembly' AND reset = 'summary' AND round <= 3""",
    "wordpiece": _sql("SELECT rowid, len(string_split(tokens, ' ')) AS n, tokens FROM wp", _WP),
    "encode": _sql(
        """SELECT rowid, count(*) + 2 AS n, '101 ' || string_agg(id, ' ' ORDER BY "at") || ' 102' AS ids FROM (
          SELECT rowid, unnest(string_split(tokens, ' ')) AS p, unnest(range(len(string_split(tokens, ' ')))) AS "at" FROM wp) JOIN voc USING (p) WHERE "at" < 510 GROUP BY 1""",
        f"{_WP}, voc(p, id) AS (VALUES {_IDS})",
    ),
    "embed_batch": _sql(
        """SELECT rowid, d, (CASE WHEN norm = 0 THEN 0 ELSE c / norm END)::FLOAT::DOUBLE AS x FROM (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY rowid)) AS norm FROM
          (SELECT rowid, d::INT AS d, coalesce(c, 0)::DOUBLE AS c FROM (SELECT rowid, unnest(range(32)) AS d FROM docs) LEFT JOIN cnt USING (rowid, d)))""",
        """gr AS (SELECT rowid, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS g FROM (SELECT rowid, ' ' || lower(text) || ' ' AS t FROM docs)),
        h1 AS (SELECT rowid, g, (xor(2166136261::BIGINT, ord(substring(g, 1, 1))::BIGINT) * 16777619::HUGEINT & 4294967295::HUGEINT)::BIGINT AS h FROM gr),
        h2 AS (SELECT rowid, g, (xor(h, ord(substring(g, 2, 1))::BIGINT) * 16777619::HUGEINT & 4294967295::HUGEINT)::BIGINT AS h FROM h1),
        h3 AS (SELECT rowid, (xor(h, ord(substring(g, 3, 1))::BIGINT) * 16777619::HUGEINT & 4294967295::HUGEINT)::BIGINT AS h FROM h2),
        cnt AS (SELECT rowid, h % 32 AS d, sum(CASE WHEN h >> 31 = 1 THEN 1 ELSE -1 END) AS c FROM h3 GROUP BY 1, 2)""",
    ),
    "src_golden": _sql("SELECT session_id, count(*) AS n, max(seq) AS last, (SELECT count(*) FROM benchmark) AS queries FROM ev GROUP BY 1"),
    "anchor_fragments": _sql('SELECT session_id, "at", rank, seq, type, text FROM frag', _FRAG),
    "anchor_text": _sql(
        """SELECT session_id, "at", '摘要:Summary of ' || session_id || chr(10) || coalesce(lines || chr(10), '')
          || '以上为本会话被压缩区间的摘要与关键原文片段。需要精确原文时用 recall 工具下钻:detail:{sessionId, seq} 或 detail:{sessionId, browse:true}。' AS text
        FROM summ LEFT JOIN (SELECT session_id, "at", string_agg('[' || CASE WHEN type = 'user/message' THEN '你' ELSE '助手' END || '#' || seq || '] ' || substring(text, 1, 160), chr(10) ORDER BY rank) AS lines
          FROM frag GROUP BY 1, 2) USING (session_id, "at")""", _FRAG,
    ),
    "ir_metrics": f"WITH {_RANK} SELECT * FROM met",
    "ir_metrics_avg": f"WITH {_RANK} SELECT count(*) AS queries, round(avg(recall5), 6) AS recall5, round(avg(recall10), 6) AS recall10, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM met",
    "ir_false_positives": f"""WITH {_RANK}, neg AS (SELECT DISTINCT source AS qid FROM documents WHERE source NOT IN (SELECT qid FROM rel)
        UNION ALL SELECT DISTINCT source || '-none' FROM documents WHERE source LIKE '%1')
        SELECT count(*) AS negatives, count(*) FILTER (qid IN (SELECT qid FROM rk WHERE rank <= 5)) AS false_positives FROM neg""",
}
SQL["anchor_stream"] = SQL["anchor_active"]
SQL["anchor_text_stream"] = SQL["anchor_text"]


def job_sql() -> dict[str, str]:
    """SQL twins of the jobs' outputs."""
    hits = """hit AS (SELECT qid, rowid, score, session_id, cwd, seq FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) AS rank FROM fin)
      JOIN docs USING (rowid) WHERE rank <= 20),
    best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) AS place FROM
      (SELECT qid, session_id, cwd, max(score) AS score, first(rowid ORDER BY score DESC, rowid) AS rowid FROM hit GROUP BY ALL)),
    isl AS (SELECT *, sum(new) OVER (PARTITION BY qid, session_id ORDER BY rowid) AS run FROM
      (SELECT *, CASE WHEN rowid - lag(rowid) OVER (PARTITION BY qid, session_id ORDER BY rowid) <= 5 THEN 0 ELSE 1 END AS new FROM hit)),
    per AS (SELECT qid, session_id, run, first(seq ORDER BY rowid) AS start_seq, last(seq ORDER BY rowid) AS end_seq, count(*) AS hit_count, max(score) AS score FROM isl GROUP BY ALL),
    epi AS (SELECT *, row_number() OVER (PARTITION BY qid, session_id ORDER BY score DESC, run) AS episode FROM per)"""
    return {
        "job1_ingest_sessions": _sql(
            f"""SELECT msg.*, title, n_messages, last_seq, first_time, last_time FROM msg JOIN ses USING (session_id)""",
            f"""msg AS (SELECT session_id, cwd AS workspace, created_at, seq, type, time, text, norm, date_trunc('month', epoch_ms(created_at))::DATE AS month FROM un
              WHERE session_id IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY type, text) = 1),
            ses AS (SELECT session_id, rtrim(substring({_norm("arg_min(text, seq) FILTER (type = 'user/message')")}, 1, 80), ' ') AS title,
              count(*) AS n_messages, max(seq) AS last_seq, min(time) AS first_time, max(time) AS last_time FROM msg GROUP BY session_id)""",
        ),
        "job2_answer_questions": _sql(
            f"""SELECT epi.qid AS item_id, place, epi.session_id, episode, start_seq, end_seq, hit_count, epi.score,
              docs.seq AS best_seq, substring({_norm('docs.text')}, 1, 240) AS answer, best.cwd AS workspace
            FROM epi JOIN best ON best.qid = epi.qid AND best.session_id = epi.session_id JOIN docs ON docs.rowid = best.rowid WHERE episode <= 3 AND place <= 5""",
            f"{_BATCH}, {hits}",
        ),
    }
