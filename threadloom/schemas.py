"""Schemas of stored tables and of responses."""

from __future__ import annotations

EVENTS = "session_id string, seq bigint, type string, time bigint, data string"
SESSIONS = "id string, cwd string, created_at bigint, fingerprint string, revision string, max_seq bigint"
DOCS = "rowid bigint, session_id string, cwd string, created_at bigint, seq bigint, type string, time bigint, text string, norm string"
POSTINGS = "rowid bigint, session_id string, n tinyint, gram string"
WORDS = "word string, rowid bigint, session_id string, seq bigint, len int, positions array<int>"
GRAMS = "gram string, block bigint, offsets array<int>"
VECTORS = "session_id string, seq bigint, text_hash string, vec array<float>"
HITS = "rowid bigint, session_id string, cwd string, created_at bigint, seq bigint, type string, time bigint, text string, score double"
EPISODES = "session_id string, episode int, start_seq bigint, end_seq bigint, hit_count bigint, snippet string, score double"
CONTEXT = "seq bigint not null, type string not null, time bigint, text string"
GROUP = (
    "session_id string not null, title string, cwd string, created_at bigint, hit_time bigint, snippet string, "
    "events array<struct<start_seq: bigint, end_seq: bigint, hit_count: bigint, snippet: string>>, "
    "next_from_seq bigint, context array<struct<seq: bigint, type: string, time: bigint, text: string>>"
)
QRELS = "qid string, query string, relevant array<string>"
