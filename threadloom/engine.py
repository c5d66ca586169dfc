"""The request interface: coarse recall, then detail, over document tables."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from . import schemas
from .config import SETTINGS, Settings, clamp, clamp_context, clamp_limit, clamp_page
from .operators import anchors, episodes, fuzzy, hybrid, literal, semantic
from .operators import detail as details
from .operators.index import in_scope
from .operators.reconcile import reconcile
from .operators.store import IndexStore
from .streaming.run import stored

QUERY_PREFIX = "为这个句子生成表示以用于检索相关文章："
log = logging.getLogger(__name__)


@dataclass
class Response:
    """What a request returns; ``groups`` are plain dictionaries, bounded by the limit."""

    ok: bool
    query: str | None = None
    total: int = 0
    groups: list[dict] = field(default_factory=list)
    error: str | None = None

    @staticmethod
    def schema() -> StructType:
        """The response's schema, as ``to_table`` gives it."""
        group = StructType.fromDDL(schemas.GROUP)
        return StructType([StructField("ok", BooleanType(), False), StructField("query", StringType()), StructField("total", IntegerType(), False), StructField("groups", ArrayType(group), False), StructField("error", StringType())])

    def to_table(self, spark: SparkSession) -> DataFrame:
        """One row with that schema; what a group lacks is null."""
        names = StructType.fromDDL(schemas.GROUP).fieldNames()
        groups = [tuple(g.get(n) for n in names) for g in self.groups]
        return spark.createDataFrame([(self.ok, self.query, self.total, groups, self.error)], self.schema())


@dataclass(frozen=True)
class Scope:
    """At most one of a session and a workspace; neither means all sessions."""

    session_id: str | None = None
    cwd: str | None = None


def resolve_scope(scope: object = None, workspace: object = None, current_session: str | None = None, current_cwd: str | None = None) -> Scope:
    """The scope of a request: ``all``, ``workspace``, ``session`` or the default.

    The default, like ``session``, is the current session, else a workspace: the given
    one or the current one.
    """
    given = workspace.strip() if isinstance(workspace, str) and workspace.strip() else None
    cwd = given or current_cwd or None
    if scope == "all":
        return Scope()
    if scope == "workspace" or not current_session:
        return Scope(cwd=cwd)
    return Scope(session_id=current_session)


class Engine:
    """Recall over ``docs`` (see ``schemas.DOCS``), with optional parts.

    ``events`` holds all events for windows, ``titles`` (id, title), ``vectors`` (rowid,
    vec), ``embedder`` an ``operators.semantic.Embedder`` for queries, ``postings`` the
    index to search by (else documents are scanned), ``words`` the one for phrases, ``store`` the ``IndexStore`` that
    vectors made on the way are committed to. With ``logs``, a function that gives the current
    (events, live, snapshots) of ``operators.reconcile``, each request first brings the store up to date.
    """

    def __init__(self, docs: DataFrame, events: DataFrame | None = None, titles: DataFrame | None = None, vectors: DataFrame | None = None, embedder=None, settings: Settings = SETTINGS, postings: DataFrame | None = None, store: IndexStore | None = None, words: DataFrame | None = None, logs: Callable[[], tuple[DataFrame, DataFrame, DataFrame]] | None = None):
        self.docs, self.events, self.titles, self.embedder, self.settings, self.postings, self.store, self.words, self.logs = docs, events, titles, embedder, settings, postings, store, words, logs
        self._vectors, self._held = vectors, None

    @classmethod
    def of(cls, store: IndexStore, events: DataFrame | None = None, titles: DataFrame | None = None, embedder=None, settings: Settings = SETTINGS, logs: Callable[[], tuple[DataFrame, DataFrame, DataFrame]] | None = None) -> Engine:
        """An engine over an index folder."""
        return cls(store.read("docs"), events, titles, store.read("vectors"), embedder, settings, store.read("postings"), store, store.read("words") if store.holds("words") else None, logs)

    def refresh(self) -> None:
        """Read the store's newest version from now on."""
        self.store.refresh()
        self.docs, self.postings, self.vectors = self.store.read("docs"), self.store.read("postings"), self.store.read("vectors")
        self.words = self.store.read("words") if self.store.holds("words") else None

    def reconcile(self) -> bool:
        """Bring the store up to date with the logs; False if that fails, which never surfaces."""
        if self.store is None or self.logs is None:
            return True
        try:
            if any(reconcile(self.store, *self.logs()).values()):
                self.store.compact()
                self.refresh()
            return True
        except Exception:
            log.warning("reconciling failed, using phrases", exc_info=True)
            return False

    @property
    def vectors(self) -> DataFrame | None:
        """The vectors, kept on the executors from the first request that reads them until they change."""
        if self._held is None and self._vectors is not None:
            self._held = self._vectors.persist()
        return self._held

    @vectors.setter
    def vectors(self, new: DataFrame | None) -> None:
        if self._held is not None:
            self._held.unpersist()
        self._vectors, self._held = new, None

    def warm(self, budget: int | None = None) -> int:
        """Embed the next documents (a tick's budget unless given); returns how many. Failures never surface.

        New vectors are committed to the store, or else kept as a table of their own.
        """
        s = self.settings
        budget = s.warmup_budget() if budget is None else budget
        if not s.semantic or self.embedder is None or self._vectors is None or budget <= 0:
            return 0
        try:
            embedder = self.embedder
            todo = semantic.warmup(self.docs, self.vectors, budget, s.warmup_batch).collect()  # at most ``budget`` rows
            if not todo:
                return 0
            vecs = [v for k in range(0, len(todo), s.warmup_batch) for v in embedder.embed([r["text"] or "" for r in todo[k : k + s.warmup_batch]])]
            new = self.docs.sparkSession.createDataFrame([(r["rowid"], [float(x) for x in v]) for r, v in zip(todo, vecs)], "rowid bigint, vec array<float>")
            if self.store is not None:  # documents without a vector, so none is replaced
                self.store.refresh()
                change = self.store.draft()
                change.add("vectors", new)
                change.commit()
                self.store.compact()
                self.vectors = self.store.read("vectors")
            else:
                self.vectors = stored(semantic.store(self._vectors, new), "vectors")
            return len(todo)
        except Exception:
            log.warning("warm-up failed", exc_info=True)
            return 0

    def anchor_texts(self, summaries: DataFrame) -> DataFrame:
        """Anchors of summaries (see ``operators.anchors``); none if the settings say so."""
        made = anchors.anchor_texts(summaries, self.events if self.events is not None else self.docs, self.settings)
        return made if self.settings.anchor else made.where("false")

    def recall(self, query: str, scope: object = None, workspace: object = None, limit: object = None, context: object = None, detail: dict | None = None, current_session: str | None = None, current_cwd: str | None = None) -> Response:
        """Groups of sessions that match, or with ``detail`` original text of one session."""
        text = " ".join(str(query or "").split())
        if not text:
            return Response(False, error="query is required")
        n = clamp_limit(limit)
        if detail is not None:
            return self.detail(text, detail, n, clamp_context(context))
        found = resolve_scope(scope, workspace, current_session, current_cwd)
        if found == Scope() and scope != "all" and not self.settings.allow_unscoped:
            return Response(False, query=text, error="no current session or workspace; use scope 'all'")
        try:
            groups = self.coarse(text, found, n)
        except Exception as error:
            log.exception("search failed")
            return Response(False, query=text, error=f"search failed: {error}")
        return Response(True, text, len(groups), groups)

    def hits(self, query: str, scope: Scope, limit: int) -> DataFrame:
        """Merged hits of both layers, at most 2 * limit."""
        s = self.settings
        if self.postings is None:
            f = fuzzy.search(self.docs, query, limit * s.fan_out, scope.session_id, scope.cwd, s=s)
        else:
            f = fuzzy.search_index(self.docs, self.postings, query, limit * s.fan_out, scope.session_id, scope.cwd, s=s)
        sem = self._semantic(query, scope, limit * s.fan_out)
        return hybrid.merge(sem if sem is not None else f.where("false"), f, limit, s)

    def _semantic(self, query: str, scope: Scope, limit: int) -> DataFrame | None:
        """Semantic hits, or None where vectors are absent, incomplete or broken."""
        s = self.settings
        if not s.semantic or self._vectors is None or self.embedder is None or not getattr(self.embedder, "available", True):
            return None
        self.warm(s.warmup_budget(request=True))
        try:
            if semantic.coverage(self.docs, self.vectors).first()["coverage"] < s.ready_coverage:
                return None
            vec = [float(x) for x in self.embedder.embed([QUERY_PREFIX + query])[0]]
            whole = scope == Scope() and self.store is not None  # a store's vectors are those of its documents
            return semantic.search(self.vectors, in_scope(self.docs, scope.session_id, scope.cwd), vec, limit, s.min_semantic_score, self.embedder.dim, whole)
        except Exception:
            log.warning("semantic layer unavailable", exc_info=True)
            return None

    def coarse(self, query: str, scope: Scope, limit: int) -> list[dict]:
        """Groups from merged hits; without hits, or if that fails, from phrase search."""
        try:
            groups = self._grouped(self.hits(query, scope, limit), query, limit) if self.reconcile() else []
            if groups:
                return groups
        except Exception:
            log.warning("fuzzy layer failed, using phrases", exc_info=True)
        if self.words is None:
            best = literal.search_sessions(in_scope(self.docs, scope.session_id, scope.cwd), query, limit)
        else:
            best = literal.search_sessions_index(self.docs, self.words, query, limit, scope.session_id, scope.cwd)
        text = self.docs.select(F.col("rowid").alias("best_rowid"), "time", "text")
        rows = best.join(text, "best_rowid").orderBy(F.desc("spans"), "best_rowid").collect()
        names = self._titles([r["session_id"] for r in rows])
        return [
            {"session_id": r["session_id"], "title": names.get(r["session_id"]), "cwd": r["cwd"] or None, "created_at": r["created_at"] or None, "hit_time": r["time"] or None, "snippet": " ".join(r["text"].split())[: self.settings.snippet_chars], "events": [], "context": []}
            for r in rows
        ]

    def _grouped(self, hits: DataFrame, query: str, limit: int) -> list[dict]:
        rows = episodes.session_groups(hits, query, limit, self.settings).orderBy("position").collect()
        names = self._titles([r["session_id"] for r in rows])
        return [{**{k: v for k, v in r.asDict(True).items() if k != "position"}, "title": names.get(r["session_id"]), "context": []} for r in rows]

    def _titles(self, ids: list[str]) -> dict[str, str]:
        if self.titles is None or not ids:
            return {}
        return {r["id"]: r["title"] for r in self.titles.where(F.col("id").isin(ids)).collect()}

    def detail(self, query: str, request: dict, limit: int, context: int) -> Response:
        """A page, a window around an event, or the hits of one session."""
        session = request.get("sessionId")
        if not isinstance(session, str) or not session:
            return Response(False, error="detail.sessionId is required")
        group: dict = {"session_id": session, "title": self._titles([session]).get(session)}
        if request.get("browse") is True:
            start = clamp(request.get("fromSeq"), 0, 0, 2**53)
            size = clamp_page(request.get("pageSize"))
            known = self.reconcile() or self.events is None
            page = details.browse(self.docs, session, start, size) if known else details.browse_range(self.events, session, start, size)
            rows = page.orderBy("seq").collect()
            group["next_from_seq"] = rows[0]["next_from_seq"] if rows else None
        elif isinstance(request.get("seq"), (int, float)) and not isinstance(request.get("seq"), bool):
            before, after = clamp(request.get("before"), context, 0, 10), clamp(request.get("after"), context, 0, 10)
            rows = details.window(self.events if self.events is not None else self.docs, session, int(request["seq"]), before, after).orderBy("seq").collect()
        else:
            rows = []
            if self.reconcile():
                hits = self.hits(query, Scope(session_id=session), limit)
                rows = details.hit_list(hits, query).orderBy(F.desc("score"), "seq").collect()
            if not rows:
                found = literal.search_events(self.docs, query, session, limit) if self.words is None else literal.search_events_index(self.docs, self.words, query, session, limit)
                rows = details.hit_list(found, query).collect()
        group["context"] = [{k: r[k] for k in ("seq", "type", "time", "text")} for r in rows]
        return Response(True, query, 1, [group])


def render_text(response: Response, chars: int = SETTINGS.render_chars) -> str:
    """A response as lines of text."""
    if not response.ok:
        return f"Recall failed: {response.error or 'unknown error'}"
    lines = [f'Recall "{response.query}": {response.total} session(s) matched.']
    for g in response.groups:
        title = f"{g['title']} " if g.get("title") else ""
        if g.get("context"):
            lines.append(f"- {title}({g['session_id']})")
            lines += [f"  [{c['seq']} {c['type']}] {(c['text'] or '')[:chars]}" for c in g["context"]]
            if g.get("next_from_seq") is not None:
                lines.append(f"  → next page from seq {g['next_from_seq']}")
        else:
            place = f", {g['cwd']}" if g.get("cwd") else ""
            lines.append(f"- {title}({g['session_id']}{place}) — {g.get('snippet')}")
            found = g.get("events") or []
            if len(found) > 1:
                spans = ", ".join(f"[{e['start_seq']}..{e['end_seq']}]×{e['hit_count']}" for e in found)
                lines.append(f"  {len(found)} events: {spans}")
    return "\n".join(lines)
