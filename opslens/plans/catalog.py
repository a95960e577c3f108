"""The registered queries: each runs one operator over a whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions import ids, prompts, text
from opslens.functions.kernels import fake_vectors
from opslens.operators import cells
from opslens.operators import consensus as cons
from opslens.operators import embed as emb
from opslens.operators import incidents as inc
from opslens.operators import ledger as led
from opslens.operators import metrics as met
from opslens.operators import postings as post
from opslens.operators import retrieve as ret
from opslens.operators import windows as win
from opslens.operators.detect import Thresholds, detect, detect_windows
from opslens.plans import views as v
from opslens.sources import envelopes as env
from opslens.session import cut_lineage, scratch, stored
from opslens.sources import logs as src
from opslens.sources.snapshots import Snapshot
from opslens.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CALL_LIMIT = 0.002
GATEWAY_LIMIT = 0.0005
MODELS = {"TINY": "model-xs", "SMALL": "model-s", "MEDIUM": "model-m", "LARGE": "model-l"}
SKETCH_ERROR = 0.01  # of the rows; a sketch of 800 stays well under it
HALF = 1705363200000000  # 2024-01-16, splits stored state from the batch at hand
COLD_RULES = Thresholds(cold_spike=15, cold_rate_errors=20)
NEW_RULES = Thresholds(new_count=1)

c, lit = F.col, F.lit


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def big(x: Column) -> Column:
    return x.cast("bigint")


def us(x: str) -> Column:
    return text.epoch_us(c(x))


# --- sources and sinks ---------------------------------------------------------------------------


@query
def ingest_logs(s, d):
    rows = src.store_rows(v.logs(s, d))
    return rows.select("event_id", "service", "level", "message", "fingerprint", us("occurred_at").alias("occurred_us"),
                       c("event_date").cast("string").alias("event_date"))


@query
def envelope_raw(s, d):
    logs = v.logs(s, d)
    out = env.to_envelope(
        logs, env.RAW_SCHEMA, "service", message_id=ids.name_uuid(F.encode(c("event_id").cast("string"), "UTF-8")),
        produced_at=c("occurred_at"), trace=F.coalesce(F.nullif(c("trace_id"), lit("")), F.concat(lit("gen-"), c("event_id").cast("string"))),
        payload=F.struct("service", "level", "message"),
    )
    return out.select("key", "value", big(F.size("headers")).alias("n_headers"))


@query
def envelope_preprocessed(s, d):
    p = v.preprocessed(s, d)
    out = env.to_envelope(
        p, env.PREPROCESSED_SCHEMA, "fingerprint", message_id=F.concat(lit("m-"), c("event_id").cast("string")), produced_at=c("occurred_at"),
        trace=c("trace_id"), tenant=ids.resolve_tenant(c("metadata")), payload=F.struct("service", "level", "template"),
    )
    return out.select("key", "value", big(F.size("headers")).alias("n_headers"))


@query
def envelope_tickets(s, d):
    t = inc.ticket_records(inc.stub_tickets(inc.open_incidents(_hourly(s, d))))
    body = F.from_json("value", "schema string, messageId string, payload struct<incidentId: string, severity: string, status: string>")
    return t.select("key", big(F.size("headers")).alias("n_headers"), body.alias("b")).select(
        "key", "n_headers", "b.schema", "b.messageId", "b.payload.incidentId", "b.payload.severity", "b.payload.status")


@query
def failed_audit(s, d):
    _, dead = env.split_poison(env.decode(v.records(s, d)))
    return inc.failed_rows(dead).select("execution_id", "origin", "status")


@query
def decode_envelopes(s, d):
    good, _ = env.split_poison(env.decode(v.records(s, d)))
    f = env.flatten(good)
    return f.select("event_id", "service", "level", "message", "tenant_id", us("occurred_at").alias("occurred_us"))


@query
def dlq_split(s, d):
    _, dead = env.split_poison(env.decode(v.records(s, d)))
    h = F.map_from_entries("headers")
    return dead.select(
        "key", "value", "topic", big(c("partition")).alias("partition"),
        F.decode(h["x-error-class"], "UTF-8").alias("error_class"),
        F.decode(h["x-error-original-topic"], "UTF-8").alias("original_topic"),
        F.decode(h["x-error-original-partition"], "UTF-8").alias("original_partition"),
        F.decode(h["x-error-original-offset"], "UTF-8").alias("original_offset"),
    )


@query
def replay_range(s, d):
    r = env.time_range(v.records(s, d), "timestamp", "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return r.select("key", "value", big(c("partition")).alias("partition"), "offset")


@query
def validate_envelopes(s, d):
    return v.records(s, d).select("partition", "offset", env.valid_envelope(c("value")).alias("valid")).withColumn("partition", big(c("partition")))


@query
def validate_batches(s, d):
    """Batches of one user's entries on one day, with a small limit so that some break it."""
    e = v.table(s, d, "events").select(F.concat_ws("/", "user_id", F.to_date("ts").cast("string")).alias("batch_id"))
    return src.batch_errors(e, "batch_id", 3).select("batch_id", big(c("n_rows")).alias("n_rows"))


@query
def validate_events(s, d):
    logs = v.logs(s, d)
    # blank traces stand in for blank levels, so that rules are broken
    marked = logs.withColumn("level", F.when(c("trace_id") == "", "").otherwise(c("level"))).withColumn(
        "occurred_at", F.when(c("event_id") % 13 != 0, c("occurred_at"))
    )
    ok, bad = src.validate_entries(marked)
    return ok.select("event_id", lit("").alias("errors")).unionByName(bad.select("event_id", F.concat_ws(",", "errors").alias("errors")))


# --- text and identity ---------------------------------------------------------------------------


@query
def normalize_messages(s, d):
    return v.table(s, d, "documents").select("doc_id", text.normalize(c("text")).alias("template"))


@query
def fingerprint_logs(s, d):
    l = v.doc_logs(s, d)
    return l.select("event_id", text.fingerprint(c("service"), c("level"), text.normalize(c("message"))).alias("fingerprint"))


@query
def fingerprint_ingest(s, d):
    l = v.doc_logs(s, d)
    return l.select("event_id", text.ingest_fingerprint(c("service"), c("level"), text.normalize(c("message"))).alias("fingerprint"))


@query
def parse_log_lines(s, d):
    p = text.parse_log(c("message"))
    return v.logs(s, d).select(
        "event_id", *[F.coalesce(p[n], lit("")).alias(n) for n in ("timestamp", "level", "thread", "logger", "message")],
        p["matched"].alias("matched"),
    )


@query
def extract_exception(s, d):
    line = F.concat(lit("com.acme."), c("source"), lit("Exception: "), c("text"))
    p = text.parse_log(line, "exception")
    return v.table(s, d, "documents").select("doc_id", p["exception_class"].alias("exception_class"), p["exception_msg"].alias("exception_msg"))


@query
def parse_syslog(s, d):
    line = F.concat(
        lit("<"), (c("event_id") % 190 + 1).cast("string"), lit(">Jan "), F.lpad((c("event_id") % 28 + 1).cast("string"), 2, "0"),
        lit(" 10:11:12 host"), (c("user_id") % 5).cast("string"), lit(" app["), c("user_id").cast("string"), lit("]: "), c("event_type"),
    )
    p = text.parse_log(line, "syslog")
    return v.table(s, d, "events").select("event_id", p["syslog_pri"].alias("syslog_pri"), p["day"].alias("day"), p["host"].alias("host"),
                                          p["tag"].alias("tag"), p["message"].alias("message"))


@query
def preprocess_logs(s, d):
    return v.preprocessed(s, d).select("event_id", "template", "fingerprint")


@query
def tenant_resolution(s, d):
    return v.logs(s, d).select("event_id", ids.resolve_tenant(c("metadata")).alias("tenant_id"))


@query
def trace_resolution(s, d):
    ctx = F.when(c("event_id") % 3 == 0, F.concat(lit("ctx-"), c("event_id").cast("string"))).otherwise(lit(""))
    t = ids.resolve_trace(ctx, c("trace_id"))
    known = (ctx != "") | (c("trace_id") != "")
    return v.logs(s, d).select("event_id", F.when(known, t).otherwise(lit("fresh")).alias("trace"), F.length(F.when(~known, t).otherwise(lit(""))).cast("bigint").alias("fresh_len"))


@query
def tenant_filter(s, d):
    return src.for_tenant(src.with_tenant(v.logs(s, d)), "tenant-1").select("event_id", "service", "level")


@query
def incident_ids(s, d):
    return v.preprocessed(s, d).select(
        "event_id", ids.incident_id(c("fingerprint"), lit("SPIKE")).alias("spike_id"), ids.incident_id(c("fingerprint"), lit("RATE_JUMP")).alias("rate_jump_id"),
    )


@query
def extract_json_payload(s, d):
    return v.records(s, d).select("partition", "offset", text.extract_json(F.concat(lit("answer: "), c("value"), lit(" done"))).alias("payload")).withColumn("partition", big(c("partition")))


@query
def extract_json_texts(s, d):
    return v.table(s, d, "pages").select("page_id", text.extract_json(c("html")).alias("payload"))


@query
def stack_anchor(s, d):
    trace = F.concat(lit("java.lang.NullPointerException\n\tat org.acme."), c("source"), lit(".Ledger.closeBook(Ledger.java:88)\n"), c("text"))
    docs = v.table(s, d, "documents").withColumn("trace", F.when(c("doc_id") % 4 != 0, trace).otherwise(c("text")))
    return docs.select("doc_id", text.anchor_context(c("trace"), c("lang")).alias("context"))


@query
def render_prompts(s, d):
    docs = v.table(s, d, "documents")
    p = prompts.render("{{role}} reads {{text}} for {{source}}", role=c("lang"), text=c("text"), source=c("source"))
    return docs.select("doc_id", p.alias("prompt"))


@query
def stub_completion(s, d):
    docs = v.table(s, d, "documents").withColumn(
        "prompt", F.concat(c("text"), F.when(c("doc_id") % 3 == 0, " NullPointerException").when(c("doc_id") % 3 == 1, " TimeoutException").otherwise(""))
    )
    out = cons.complete(docs)
    return out.select("doc_id", "answer", prompts.stub_tokens(c("prompt")).alias("tokens_in"), prompts.stub_tokens(c("answer")).alias("tokens_out"))


@query
def text_preview(s, d):
    return v.table(s, d, "documents").select("doc_id", text.preview(c("text")).alias("preview"))


@query
def content_hash(s, d):
    return v.table(s, d, "documents").select("doc_id", text.content_hash(c("text")).alias("content_hash"))


@query
def window_ids(s, d):
    return v.event_keys(s, d).select("event_id", text.window_id(c("occurred_at")).alias("window_id"))


# --- windows -------------------------------------------------------------------------------------


@query
def fingerprint_window_counts(s, d):
    return win.window_counts(v.preprocessed(s, d))


@query
def service_error_windows(s, d):
    return win.service_error_counts(v.logs(s, d))


@query
def fingerprint_baseline(s, d):
    return win.baseline(win.window_counts(v.preprocessed(s, d)), win.FP_KEYS)


@query
def service_error_baseline(s, d):
    return win.baseline(win.service_error_counts(v.logs(s, d)), win.SVC_KEYS)


@query
def running_counts(s, d):
    return win.running_counts(v.event_keys(s, d))


@query
def first_seen_sessions(s, d):
    # per-user series fall silent often enough to go cold again
    e = v.event_keys(s, d).join(v.table(s, d, "events").select("event_id", "user_id"), "event_id")
    return win.first_seen(e.withColumn("fingerprint", F.concat(c("fingerprint"), lit("-"), c("user_id").cast("string"))))


@query
def fingerprints_in_count_range(s, d):
    counts = win.window_counts(v.event_keys(s, d), 3600)
    busiest = counts.groupBy("window_id").agg(F.sum("cnt").alias("n")).agg(F.max(F.struct(c("n"), c("window_id"))).alias("m")).select("m.window_id")
    return win.in_count_range(counts, busiest.scalar(), 2, 6)


@query
def fingerprint_batches(s, d):
    b = win.fingerprint_batches(v.preprocessed(s, d), sample=5)
    return b.select("service", "fingerprint", "cnt", us("first_at").alias("first_us"), us("last_at").alias("last_us"), "normalized_message",
                    F.concat_ws(",", F.transform("sample", lambda e: e["event_id"].cast("string"))).alias("sample_ids"))


# --- detection -----------------------------------------------------------------------------------

_DETECT_COLS = ("event_id", "service", "fingerprint", "window_id", "is_cold", "fp_count", "fp_mean", "fp_std", "svc_errors", "svc_mean", "svc_std")


def _report(df: DataFrame) -> DataFrame:
    return df.select(*_DETECT_COLS, F.coalesce("anomaly_type", lit("")).alias("anomaly_type"), F.coalesce("score", lit(0.0)).alias("score"),
                     F.coalesce("signal", lit("")).alias("signal"), F.coalesce("severity", lit("")).alias("severity"))


@query
def detect_anomalies(s, d):
    return _report(detect(v.preprocessed(s, d)))


@query
def detect_anomalies_hourly(s, d):
    return _report(detect(v.event_keys(s, d), window_s=3600, n=168))


@query
def detect_cold(s, d):
    r = detect(v.event_keys(s, d), COLD_RULES, window_s=86400, n=30)
    return _report(r.filter(c("is_cold") & c("anomaly_type").isNotNull()))


@query
def detect_spikes(s, d):
    return _report(detect(v.event_keys(s, d), window_s=3600, n=168).filter(~c("is_cold") & (c("anomaly_type") == "SPIKE")))


@query
def detect_rate_jumps(s, d):
    return _report(detect(v.event_keys(s, d), window_s=3600, n=168).filter(~c("is_cold") & (c("anomaly_type") == "RATE_JUMP")))


@query
def detect_new_errors(s, d):
    return _report(detect(v.event_keys(s, d), NEW_RULES, window_s=3600, n=1).filter(~c("is_cold") & (c("anomaly_type") == "NEW_ERROR")))


@query
def detect_closed_windows(s, d):
    r = detect_windows(v.event_keys(s, d), window_s=3600, n=168)
    return r.select("service", "fingerprint", "window_id", "fp_count", "svc_errors", "is_cold",
                    F.coalesce("anomaly_type", lit("")).alias("anomaly_type"), F.coalesce("score", lit(0.0)).alias("score"))


def _hourly(s, d) -> DataFrame:
    return detect(v.event_keys(s, d), window_s=3600, n=168)


def _hourly_once(s, d) -> DataFrame:
    """For queries that read the detections more than once."""
    return cut_lineage(_hourly(s, d))


@query
def evidence_map(s, d):
    """The numbers behind each incident's first report, key by key; hourly rules and cold rules."""
    cold = inc.open_incidents(detect(v.event_keys(s, d), COLD_RULES, window_s=86400, n=30), thresholds=COLD_RULES)
    both = inc.open_incidents(_hourly(s, d)).withColumn("rules", lit("hourly")).unionByName(cold.withColumn("rules", lit("cold")))
    return both.select("rules", "incident_id", F.explode(F.from_json("evidence", "map<string,string>")).alias("key", "value"))


@query
def open_incidents(s, d):
    i = inc.open_incidents(_hourly(s, d), events=src.with_tenant(v.logs(s, d)))
    return i.select("incident_id", "fingerprint", "anomaly_type", "event_id", "service", "score", "title", "summary", "severity", "tenant_id", us("first_seen_at").alias("first_us"))


@query
def stub_tickets(s, d):
    t = inc.stub_tickets(inc.open_incidents(_hourly(s, d)))
    return t.select("ticket_id", "incident_id", "title", "severity", "service", "status", F.element_at(F.split("description", "\n"), 1).alias("fingerprint_line"),
                    F.get_json_object(F.regexp_extract("description", r"(?s)Evidence: (.*)", 1), "$.current").alias("current"))


@query
def ticket_upsert(s, d):
    found = _hourly_once(s, d)
    old = inc.open_incidents(found.filter(c("ts_us") < HALF)).withColumn("status", lit("CLOSED"))
    new = inc.open_incidents(found.filter(c("ts_us") >= HALF))
    return inc.upsert_incidents(new, old).select("incident_id", "event_id", "status", "severity")


@query
def stored_tickets(s, d):
    """Two batches of incidents through the stored table, the second one twice, and what a reader finds then."""
    path = scratch(s, "tickets")
    found = _hourly_once(s, d)
    for epoch, half in enumerate((c("ts_us") < HALF, c("ts_us") >= HALF, c("ts_us") >= HALF)):
        inc.store_tickets(s, path, inc.open_incidents(found.filter(half)), min(epoch, 1), buckets=16)
    return Snapshot(s, path, ["incident_id"], 16).read().select(
        "incident_id", "event_id", "severity", "ticket.ticket_id", "ticket.title", "ticket.status")


@query
def event_audit(s, d):
    found = _hourly_once(s, d)
    return inc.audit_rows(found, inc.open_incidents(found)).select("event_id", "execution_id", "run_key", "status", us("started_at").alias("started_us"))


# --- streams: the table's files arrive as a stream, and the sink is read when it has run dry -------


def _run(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


_ONCE = {"availableNow": True}


@query
def stream_window_counts(s, d):
    """Window counts in complete mode, the table replaced with every batch."""
    at = scratch(s, "stream-counts")
    counts = jobs.stream_counts(v.event_keys(s, d, v.arriving(s, d, "events")))
    _run(counts.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/ck").trigger(**_ONCE).foreachBatch(
        lambda b, _: b.write.mode("overwrite").parquet(f"{at}/out")).start())
    return s.read.parquet(f"{at}/out")


@query
def stream_detections(s, d):
    at = scratch(s, "stream-detect")
    _run(jobs.start_detect(v.event_keys(s, d, v.arriving(s, d, "events")), f"{at}/state", f"{at}/ck", window_s=3600, n=168, trigger=_ONCE))
    return _report(s.read.parquet(f"{at}/state/detections"))


@query
def stream_preprocess(s, d):
    """Envelopes in; messages and dead letters out, each from its own sink."""
    at = scratch(s, "stream-preprocess")
    decoded = env.decode(v.records(s, d, v.arriving(s, d, "events")))
    _run(jobs.start_preprocess(decoded, ("parquet", {"path": f"{at}/good"}), ("parquet", {"path": f"{at}/dead"}), f"{at}/ck", _ONCE))
    dead = s.read.option("recursiveFileLookup", "true").parquet(f"{at}/dead")
    good = s.read.option("recursiveFileLookup", "true").parquet(f"{at}/good")
    body = F.from_json(c("value").cast("string"), "messageId string, tenantId string, payload struct<service string, level string, message string>")
    cls = F.map_from_entries(F.from_json("headers", "array<struct<key string, value string>>"))["x-error-class"]
    return dead.select(lit("dead").alias("sink"), c("value").cast("string").alias("body"), cls.alias("detail")).unionByName(
        good.select(body.alias("b")).select(lit("good").alias("sink"), F.concat_ws("|", "b.messageId", "b.tenantId", "b.payload.service", "b.payload.level").alias("body"),
                                            c("b.payload.message").alias("detail")))


@query
def stream_cache_hits(s, d):
    """Embedding requests against the cache, the last write of each text kept as keyed state."""
    at = scratch(s, "stream-cache")
    r = v.embed_requests(s, d, v.arriving(s, d, "documents")).filter("text IS NOT NULL").select(
        "seq", text.content_hash(c("text")).alias("content_hash"), F.timestamp_micros("ts_us").alias("at"))
    hits = jobs.cache_hit_stream(r, "content_hash", emb.EMBED_TTL_SECONDS, "at", "seq")
    with jobs.keyed_state(s):
        q = hits.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/ck").trigger(**_ONCE).start(f"{at}/out")
    _run(q)
    return s.read.parquet(f"{at}/out").select("seq", "content_hash", "is_hit")


# --- retrieval -----------------------------------------------------------------------------------


@query
def vector_topk(s, d):
    corpus = v.corpus(s, d)
    out = ret.vector_topk(v.label_queries(corpus), corpus, k=20)
    return out.select("query_id", "id", "distance", big(c("rnk")).alias("rnk"))


@query
def lexical_topk(s, d):
    docs = v.table(s, d, "documents").select(c("doc_id").alias("id"), c("text").alias("content"))
    q = v.table(s, d, "benchmark").select(c("item_id").alias("query_id"), "text")
    return ret.lexical_topk(q, docs, k=10).select("query_id", "id", "similarity", big(c("rnk")).alias("rnk"))


@query
def lexical_postings(s, d):
    """The same search over a stored index of rare trigrams."""
    at = scratch(s, "postings")
    docs = v.table(s, d, "documents").select(c("doc_id").alias("id"), c("text").alias("content"))
    post.store(post.build(docs), at)
    q = v.table(s, d, "benchmark").select(c("item_id").alias("query_id"), "text")
    return post.search(post.load(s, at), q, k=10).select("query_id", "id", "similarity", big(c("rnk")).alias("rnk"))


@query
def vector_neighbours(s, d):
    """Every vector as a query, in several waves."""
    rows = v.table(s, d, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vector"))
    out = ret.vector_topk(rows.withColumnRenamed("id", "query_id"), rows, k=5, wave_rows=256)
    return out.select("query_id", "id", "distance", big(c("rnk")).alias("rnk"))


@query
def vector_cells(s, d):
    """Every vector as a query, against vectors stored by cell and shell."""
    at = scratch(s, "cells")
    rows = v.table(s, d, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vector"))
    cells.store(cells.build(rows), at)
    out = cells.search(cells.load(s, at), rows.withColumnRenamed("id", "query_id"), k=5)
    return out.select("query_id", "id", "distance", big(c("rnk")).alias("rnk"))


@query
def hybrid_code_search(s, d):
    """A corpus by name, with filters: unknown keys and null values are ignored."""
    corpus = stored(v.corpus(s, d), "corpus")  # read for the questions, by both searches and for the winners' content
    out = ret.hybrid_search(v.label_queries(corpus), v.code_corpus(s, d, corpus), top_k=10, corpus_name="code",
                            filters={"repo": "svc-1", "service": "x", "fqn": None})
    return out.select("query_id", "id", "content", "corpus", "score", big(c("rnk")).alias("rnk"))


@query
def rank_fusion(s, d):
    corpus = stored(v.corpus(s, d), "corpus")
    q = cut_lineage(v.label_queries(corpus))
    out = ret.rrf(ret.vector_topk(q, corpus, 20), ret.lexical_topk(q, corpus, 20))
    return out.select("query_id", "id", F.coalesce("vec_rank", lit(0)).cast("bigint").alias("vec_rank"), F.coalesce("lex_rank", lit(0)).cast("bigint").alias("lex_rank"), "rrf_score")


@query
def hybrid_search(s, d):
    corpus = stored(v.corpus(s, d), "corpus")
    out = ret.hybrid_search(v.label_queries(corpus), corpus, top_k=10)
    return out.select("query_id", "id", "content", "score", big(c("rnk")).alias("rnk"))


@query
def corpus_filter(s, d):
    out = ret.corpus_filter(v.code_corpus(s, d), "CODE", {"repo": "svc-1", "nope": "x", "fqn": None})
    return out.select("id", "repo", "content")


@query
def anomaly_context(s, d):
    i = inc.open_incidents(_hourly(s, d)).select("incident_id", "service", "fingerprint", lit("").alias("template"))
    embedder = lambda q: emb.embed(q, "text", fake_vectors, 64, "vector")
    out = ret.anomaly_context(i, v.code_corpus(s, d, stored(v.corpus(s, d), "corpus")), embedder, top_k=10)
    return out.select("incident_id", "id", "score", big(c("rnk")).alias("rnk"))


@query
def anomaly_context_templates(s, d):
    """The same, asked by the normalised message of the opening event; views have none and are asked by fingerprint."""
    i = inc.open_incidents(_hourly(s, d)).join(v.preprocessed(s, d).select("event_id", "template"), "event_id")
    i = i.withColumn("template", F.when(c("fingerprint") != "view", c("template"))).select("incident_id", "service", "fingerprint", "template")
    embedder = lambda q: emb.embed(q, "text", fake_vectors, 64, "vector")
    out = ret.anomaly_context(i, v.code_corpus(s, d, stored(v.corpus(s, d), "corpus")), embedder, top_k=10)
    return out.select("incident_id", "id", "score", big(c("rnk")).alias("rnk"))


# --- embedding -----------------------------------------------------------------------------------

def _poll() -> Column:
    return win.int_div(c("seq"), emb.POLL_ROWS)


@query
def embed_batch_dedup(s, d):
    return emb.dedupe_requests(v.embed_requests(s, d), _poll()).select("batch_id", "content_hash", "n_requests", "first_seq", "text")


@query
def embed_savings(s, d):
    return emb.savings(v.embed_requests(s, d), _poll())


@query
def embed_cache_hits(s, d):
    return emb.request_cache_hits(v.embed_requests(s, d)).select("seq", "content_hash", "is_hit")


def _vector_cache(s, d) -> DataFrame:
    return v.corpus(s, d).filter("vector IS NOT NULL").groupBy(text.content_hash(c("content")).alias("content_hash")).agg(F.min_by("vector", "id").alias("embedding"))


def _by_place(df: DataFrame, *columns: str) -> DataFrame:
    """The rows with every value of their vector, one per place; place -1 where there is no vector."""
    out = df.select(*columns, F.posexplode_outer("embedding").alias("pos", "value"))
    return out.withColumns({"pos": big(F.coalesce("pos", lit(-1))), "value": F.coalesce("value", lit(0.0)).cast("double")})


@query
def embedding_cache_lookup(s, d):
    out = emb.lookup_vectors(emb.dedupe_requests(v.embed_requests(s, d)), _vector_cache(s, d))
    return _by_place(out, "content_hash", "n_requests", "cached")


@query
def embed_texts(s, d):
    """All 1,536 values of each text's vector, as one exact sum in which every value has its own weight."""
    out = emb.embed(v.table(s, d, "documents").select("doc_id", "text"), "text", fake_vectors)
    total = F.aggregate(F.transform("embedding", lambda x, i: F.round(x.cast("double") * 1000).cast("bigint") * (i + 1)),
                        lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("doc_id", big(F.size("embedding")).alias("n_values"), total.alias("weighted_sum"))


@query
def embed_corpus_counts(s, d):
    return emb.corpus_counts(v.embed_requests(s, d))


def _upsert(s, d, corpus: str) -> DataFrame:
    r, vectors = v.embed_requests(s, d), _vector_cache(s, d)
    old = emb.upsert_corpus(None, r.filter(c("ts_us") < HALF), corpus, vectors)
    return emb.upsert_corpus(old, r.filter(c("ts_us") >= HALF), corpus, vectors)


@query
def upsert_log_corpus(s, d):
    return _by_place(_upsert(s, d, "LOGS"), "fingerprint", "content", "content_hash", "seq", "sample_count", "last_seen_us")


@query
def upsert_code_corpus(s, d):
    return _by_place(_upsert(s, d, "CODE"), "repo", "git_sha", "file_path", "fqn", "content_hash", "seq", "last_seen_us")


@query
def upsert_incident_corpus(s, d):
    return _by_place(_upsert(s, d, "INCIDENTS"), "incident_id", "content", "seq", "last_seen_us")


@query
def incident_fk_check(s, d):
    known = v.table(s, d, "labels").select(F.concat(lit("inc-"), c("doc_id").cast("string")).alias("incident_id"))
    good, bad = emb.known_incidents(emb.corpus_requests(v.embed_requests(s, d), "INCIDENTS"), known)
    return good.select("seq", lit(True).alias("known")).unionByName(bad.select("seq", lit(False).alias("known")))


# --- ledger --------------------------------------------------------------------------------------


@query
def response_cache_hits(s, d):
    return led.response_cache_hits(v.calls(s, d)).select("call_id", "prompt_hash", "is_hit")


@query
def call_cost(s, d):
    out = led.call_costs(v.calls(s, d))
    return out.select("call_id", "charged_tokens", "est_cost", "actual_cost", F.coalesce("estimation_delta", lit(-1)).alias("estimation_delta"))


@query
def daily_spend(s, d):
    return led.daily_spend(v.calls(s, d), CALL_LIMIT).withColumn("day", c("day").cast("string"))


@query
def running_spend(s, d):
    return led.running_spend(v.calls(s, d), CALL_LIMIT).select("call_id", "spent_tokens", "spend_usd", "level")


@query
def budget_admission(s, d):
    return led.admit(v.calls(s, d), CALL_LIMIT).select("call_id", "spent_before", "decision", "level", "charged")


@query
def call_gateway(s, d):
    out = led.gateway(v.calls(s, d), MODELS, GATEWAY_LIMIT)
    return out.select("call_id", "is_hit", "decision", F.coalesce("level", lit("")).alias("level"), "model", "charged")


@query
def tier_routing(s, d):
    # level and decision by arithmetic, so that every pair of them is routed
    calls = v.calls(s, d).withColumn("lvl", F.element_at(F.array(*[lit(x) for x in ("NORMAL", "DEGRADED", "CRITICAL", "EXHAUSTED")]), (c("call_id") % 7 % 4 + 1).cast("int"))).withColumn(
        "dec", F.element_at(F.array(*[lit(x) for x in ("ALLOW", "DEGRADE", "DENY")]), (c("call_id") % 5 % 3 + 1).cast("int")))
    return calls.select("call_id", "tier", "lvl", "dec", led.effective_tier(c("tier"), led.routing_level(c("lvl"), c("dec"))).alias("effective_tier"),
                        led.route(c("tier"), c("lvl"), c("dec"), MODELS).alias("model"))


def _modelled(s, d) -> DataFrame:
    return v.calls(s, d).withColumn("model", led.route(c("tier"), lit("NORMAL"), lit("ALLOW"), MODELS))


@query
def call_usage(s, d):
    return led.usage(led.response_cache_hits(_modelled(s, d)))


# --- consensus, priority, evaluation -------------------------------------------------------------


@query
def persona_fanout(s, d):
    docs = v.table(s, d, "documents").select(F.concat(lit("inc-"), c("doc_id").cast("string")).alias("incident_id"), "text")
    return cons.fan_out(docs).select("incident_id", "role", big(F.length("text")).alias("n"))


@query
def parse_findings(s, d):
    f = v.findings(s, d).withColumn(
        "answer",
        F.when(c("doc_id") % 6 == 0, F.concat(lit("no json here "), c("rationale"))).when(c("doc_id") % 6 == 1, lit("{broken"))
        .otherwise(F.concat(lit('Sure: {"role":"'), c("role"), lit('","errorType":"'), c("error_type"), lit('","layer":"'), c("layer"),
                            lit('","suspectedFiles":["A.java","B.java"],"confidence":0.5,"rationale":"'), c("rationale"), lit('"} ok'))),
    ).select("incident_id", "role", "answer")
    out = cons.parse_findings(f)
    return out.select("incident_id", "role", "error_type", "layer", big(F.size("suspected_files")).alias("n_files"), "confidence", "parse_failed")


@query
def consensus_gate(s, d):
    return v.verdict_rows(s, d)


@query
def consensus_dissent(s, d):
    return cons.dissent(v.findings(s, d), v.verdict_rows(s, d))


@query
def incident_outcome(s, d):
    vr = v.verdict_rows(s, d).withColumn("doc_id", F.split_part(c("incident_id"), lit("-"), lit(2)).cast("bigint"))
    toxic = v.table(s, d, "labels").select("doc_id", (c("toxic") == 1).alias("toxic"))
    j = vr.join(toxic, "doc_id", "left")
    return j.select("incident_id", cons.outcome(~F.coalesce("toxic", lit(False)), c("agreed_error_type")).alias("status"))


@query
def root_cause_shortcut(s, d):
    vr = v.verdict_rows(s, d).withColumn("dissent_json", lit("[]")).withColumn("code_context", c("incident_id"))
    out = cons.root_cause(vr)
    return out.select("incident_id", F.coalesce("cause", lit("")).alias("cause"), big(F.size("evidence")).alias("n_evidence"), F.coalesce("cause_confidence", lit(-1.0)).alias("cause_confidence"))


def _drafter(batch: list[str]) -> list[str]:
    """Scripted drafts that name the file behind ``cause`` if there is one."""
    out = []
    for p in batch:
        own = re.search(r"own:(src\d+)", p)
        files = f'"{own[1]}"' if own else ""
        out.append(f'text before {{"title":"t","description":"d","suspectedFiles":[{files}],"fixSuggestion":"f"}}')
    return out


@query
def draft_ticket(s, d):
    docs = v.table(s, d, "documents").select(
        "doc_id", F.when(c("doc_id") % 2 == 0, F.concat(lit("own:"), c("source"))).otherwise("none").alias("cause"),
        lit("APPLICATION").alias("primary_layer"), F.array(c("lang")).alias("evidence"), F.array(c("text")).alias("alternatives"),
        F.array(c("lang"), c("source")).alias("suspected_files"))
    out = cons.draft_ticket(docs, _drafter)
    return out.select("doc_id", "title", "description", "repro_steps", "fix_suggestion", F.concat_ws(",", "suspected_files").alias("files"))


@query
def ticket_priority(s, d):
    e = v.event_keys(s, d).withColumn("service", F.when(c("service") == "svc-0", "Payment-Service").otherwise(c("service"))).withColumn(
        "tiebreak", F.when(c("event_id") % 2 == 0, "this is P1").otherwise("P2"))
    out = cons.prioritize(e, "service", "occurred_at", "UTC")
    return out.select("event_id", "priority_score", "calculated_severity", "routing_queue", "justification")


def _panel(batch: list[str]) -> list[str]:
    """Scripted answers: English incidents find agreement, French ones lack confidence, others a majority."""
    out = []
    for p in batch:
        if p.startswith("SYSTEM:\nYou are the "):
            role = p[len("SYSTEM:\nYou are the "):].split(" of the on-call panel", 1)[0]
            layer = role if p.endswith(("de", "es", "zh")) else "APPLICATION"
            conf = 0.2 if p.endswith("fr") else 0.9
            out.append(f'{{"role":"{role}","errorType":"E","layer":"{layer}","suspectedFiles":["A.java"],"confidence":{conf},"rationale":"r"}}')
        elif "root cause" in p:
            out.append('{"cause":"found","evidence":["x"],"confidence":0.8,"alternatives":[]}')
        elif "Write the ticket" in p:
            out.append('{"title":"t","description":"d","suspectedFiles":[],"fixSuggestion":"f"}')
        else:
            out.append("P1")
    return out


@query
def resolve_incidents(s, d):
    labels = v.table(s, d, "labels").select("doc_id", (c("quality") == 1).alias("is_anomaly"))
    docs = v.table(s, d, "documents").join(labels, "doc_id", "left").select(
        F.concat(lit("inc-"), c("doc_id").cast("string")).alias("incident_id"),
        F.when(c("source") == "src1", cons.TOP_SERVICE).otherwise(c("source")).alias("service"),
        F.timestamp_micros(lit(1704067200000000) + c("doc_id") * 3600000000).alias("created_at"),
        F.coalesce("is_anomaly", lit(True)).alias("is_anomaly"), lit("Find out what broke").alias("requirement"),
        c("text").alias("stack_trace"), c("lang").alias("code_context"),
    )
    out = cons.resolve_incidents(docs, _panel)
    return out.select("incident_id", "status", *[F.coalesce(x, lit("")).alias(x) for x in ("agreed_error_type", "primary_layer", "calculated_severity", "cause")],
                      F.concat_ws(",", "suspected_files").alias("files"))


def _agreed(batch: list[str]) -> list[str]:
    """Scripted answers of a panel in which the system analyst dissents."""
    out = []
    for p in batch:
        if p.startswith("SYSTEM:\nYou are the "):
            role = p[len("SYSTEM:\nYou are the "):].split(" of the on-call panel", 1)[0]
            layer = "INFRASTRUCTURE" if role == "System Analyst" else "APPLICATION"
            out.append(f'{{"role":"{role}","errorType":"E","layer":"{layer}","suspectedFiles":["{role[0]}.java"],"confidence":0.9,"rationale":"r"}}')
        elif "root cause" in p:
            out.append('{"cause":"found","evidence":["x"],"confidence":0.8,"alternatives":[]}')
        elif "Write the ticket" in p:
            out.append('{"title":"t","description":"d","suspectedFiles":[],"fixSuggestion":"f"}')
        else:
            out.append("P1")
    return out


@query
def incident_pipeline(s, d):
    """Detections to resolved tickets in one run."""
    opened = cut_lineage(inc.open_incidents(_hourly(s, d)))
    embedder = lambda q: emb.embed(q, "text", fake_vectors, 64, "vector")
    context = ret.anomaly_context(opened.withColumn("template", lit("")), v.code_corpus(s, d, stored(v.corpus(s, d), "corpus")), embedder, top_k=10)
    out = cons.incident_pipeline(opened, context, _agreed)
    return out.select("incident_id", "status", "context_ids", "agreed_error_type", "primary_layer", "confidence", "n_findings",
                      F.concat_ws(",", "verdict_files").alias("files"), "dissent_json", "calculated_severity", "cause")


@query
def retrieval_eval(s, d):
    """Precision at 5 of trigram search, where benchmark passages are known to stand in documents."""
    docs = v.table(s, d, "documents").select(c("doc_id").alias("id"), c("text").alias("content"))
    q = v.table(s, d, "benchmark").select(c("item_id").alias("query_id"), "text")
    top = ret.lexical_topk(q, docs, k=5, threshold=0.1).join(docs, "id").join(q, "query_id")
    hits = F.sum(F.contains("content", "text").cast("int"))
    per = top.groupBy("query_id").agg(big(F.count(lit(1))).alias("found"), hits.alias("hits"))
    return q.select("query_id").join(per, "query_id", "left").select(
        "query_id", F.coalesce("found", big(lit(0))).alias("found"), F.coalesce("hits", big(lit(0))).alias("hits"),
        (F.coalesce("hits", big(lit(0))) / lit(5.0)).alias("precision_at_5"))


@query
def precision_at_k(s, d):
    return cons.precision_at_k(v.eval_set(s, d)).select("doc_id", "hits", "precision_at_k", "reachable_precision")


@query
def layer_accuracy(s, d):
    j = v.eval_set(s, d).join(v.verdict_rows(s, d).select("incident_id", "primary_layer"), "incident_id")
    out = cons.layer_accuracy(j)
    return out.select("n", F.round("layer_accuracy", 9).alias("layer_accuracy"), F.round("precision_at_k", 9).alias("precision_at_k"), "passed")


# --- metrics -------------------------------------------------------------------------------------


@query
def throughput_rate(s, d):
    return met.rate(v.event_keys(s, d), "occurred_at", 60, ["service"])


@query
def terminal_states(s, d):
    found = _hourly_once(s, d)
    return met.terminal_states(inc.audit_rows(found, inc.open_incidents(found)))


@query
def hourly_cost(s, d):
    return met.hourly_cost(_modelled(s, d), CALL_LIMIT, led.USD_PER_1K)


@query
def latency_percentiles(s, d):
    e = v.table(s, d, "events").withColumn("ms", F.round(c("value") * 100).cast("bigint"))
    out = met.latency_percentiles(e, "ms", ["event_type"], exact=True)
    return out.select("event_type", "cnt", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query
def latency_sketches(s, d):
    """Percentiles from sketches stored by the minute, held against all rows: their ranks lie within the bound."""
    e = v.table(s, d, "events").select("event_type", F.unix_micros(c("ts").cast("timestamp")).alias("ts_us"), F.round(c("value") * 100).cast("bigint").alias("ms"))
    got = met.merged_percentiles(met.latency_sketches(e, "ms", ["event_type"]), ["event_type"])
    got = got.select("event_type", "cnt", F.explode(F.create_map(*[x for q in (50, 95, 99) for x in (lit(q), c(f"p{q}"))])).alias("p", "est"))
    # the share of rows under the estimate and up to it has the wanted share between them
    ranks = e.join(got, "event_type").groupBy("event_type", "cnt", "p").agg(
        F.avg((c("ms") < c("est")).cast("double")).alias("under"), F.avg((c("ms") <= c("est")).cast("double")).alias("upto"))
    return ranks.select("event_type", "cnt", big(c("p")).alias("p"), (
        (c("under") <= c("p") / 100 + SKETCH_ERROR) & (c("upto") >= c("p") / 100 - SKETCH_ERROR)).alias("within"))


@query
def distinct_text_sketches(s, d):
    """Distinct texts from sketches stored by the hour, held against the exact number."""
    r = v.embed_requests(s, d)
    est = met.merged_distinct(met.distinct_sketches(r, "text", ["corpus"]), ["corpus"])
    exact = r.groupBy("corpus", "text").agg(lit(1).alias("one")).groupBy("corpus").agg(F.count("text").alias("texts"))
    return est.join(exact, "corpus").select(F.upper("corpus").alias("corpus"), "rows", "texts", (F.abs(c("distinct_est") / c("texts") - 1) <= 0.05).alias("within"))


@query
def anomaly_counts(s, d):
    return met.anomaly_counts(_hourly(s, d))


@query
def dlq_tail(s, d):
    out = met.dlq_tail(v.dlq(s, d), "logs.raw.dlq", 20)
    return out.select(big(c("partition")).alias("partition"), "offset", "key", "value_preview")


@query
def dlq_backlog(s, d):
    return met.dlq_backlog(v.dlq(s, d))


@query
def fingerprints_per_service(s, d):
    return met.counts_by(v.preprocessed(s, d), ["service", "fingerprint"])
