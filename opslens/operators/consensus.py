"""Panel findings to prioritised tickets, and the evaluation metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import prompts
from opslens.functions.text import anchor_context, extract_json
from opslens.session import cut_lineage

# Gates, weights, states.
MIN_CONFIDENCE = 0.4
REVIEW = "REVIEW_NEEDED"
REVIEW_CAUSE = "Manual review required — swarm could not reach consensus"
QUEUE = "ENGINEERING_QUEUE"
TOP_SERVICE = "payment-service"
PRECISION_GATE, LAYER_GATE = 0.70, 0.60
FINDING_SCHEMA = (
    "role string, errorType string, layer string, suspectedFiles array<string>, confidence double, rationale string"
)
ROOT_CAUSE_SCHEMA = "cause string, evidence array<string>, confidence double, alternatives array<string>"
TICKET_SCHEMA = "title string, description string, reproSteps string, suspectedFiles array<string>, fixSuggestion string"

# tier asked for at each step

Completer = Callable[[list[str]], list[str]]


def fan_out(incidents: DataFrame, personas: Mapping[str, str] = prompts.PERSONAS) -> DataFrame:
    """Every incident once per role: a fixed array exploded in place, no join."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("charter")) for r, c in personas.items()])
    return incidents.withColumn("_p", F.explode(roles)).select("*", "_p.role", "_p.charter").drop("_p")


def persona_prompts(fanned: DataFrame, requirement: Column, trace: Column, code: Column) -> DataFrame:
    system = prompts.render(prompts.PERSONA, role=F.col("role"), roleCharter=F.col("charter"))
    body = prompts.render(
        prompts.PERSONA_INPUT, projectRequirement=requirement, stackTrace=trace, codeContext=anchor_context(trace, code)
    )
    return fanned.withColumn("prompt", F.concat(system, body))


def complete(df: DataFrame, prompt_col: str = "prompt", fn: Completer | None = None, out_col: str = "answer") -> DataFrame:
    """Answers in batches through the user's function; without one, the rule-based stand-in."""
    if fn is None:
        return df.withColumn(out_col, prompts.stub_answer(F.col(prompt_col)))
    schema = df.withColumn(out_col, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = pa.array(fn(b[prompt_col].to_pylist()), type=pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, answers], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, schema)


def parse_findings(df: DataFrame, answer_col: str = "answer", role_col: str = "role") -> DataFrame:
    """Answers as findings; an unreadable answer becomes an UNKNOWN finding of zero confidence."""
    parsed = F.from_json(extract_json(F.col(answer_col)), FINDING_SCHEMA + ", _corrupt string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = df.withColumn("_f", parsed)
    bad = F.col("_f").isNull() | F.col("_f._corrupt").isNotNull()
    none = F.array().cast("array<string>")

    def pick(name: str, fallback: Column) -> Column:
        return F.when(bad, fallback).otherwise(F.col(f"_f.{name}"))

    keep = [c for c in df.columns if c not in (role_col, answer_col)]
    return out.select(
        *keep, F.coalesce(pick("role", F.col(role_col)), F.col(role_col)).alias("role"),
        F.coalesce(pick("errorType", F.lit("UNKNOWN")), F.lit("UNKNOWN")).alias("error_type"),
        F.coalesce(pick("layer", F.lit("UNKNOWN")), F.lit("UNKNOWN")).alias("layer"),
        F.coalesce(pick("suspectedFiles", none), none).alias("suspected_files"),
        F.coalesce(pick("confidence", F.lit(0.0)), F.lit(0.0)).alias("confidence"),
        F.when(bad, F.concat(F.lit("Parsing Failure: "), F.coalesce(F.col(answer_col), F.lit("null"))))
        .otherwise(F.col("_f.rationale")).alias("rationale"),
        bad.alias("parse_failed"),
    )


def consensus(findings: DataFrame, min_confidence: float = MIN_CONFIDENCE, incidents: DataFrame | None = None) -> DataFrame:
    """One verdict per incident.

    Accepted when some finding reaches ``min_confidence`` and one layer holds more than half of them.
    Counted in two partial aggregates (incident and layer, then incident). ``incidents`` adds those
    without any finding, which go to review.
    """
    c = F.col
    layers = findings.groupBy("incident_id", "layer").agg(
        F.count(F.lit(1)).alias("votes"), F.max("confidence").alias("conf"),
        F.max(F.struct("confidence", "role", "error_type")).alias("lead"),
    )
    per = layers.groupBy("incident_id").agg(
        F.sum("votes").alias("n"), F.max("conf").alias("max_confidence"),
        F.max(F.struct("votes", "layer", "conf", "lead")).alias("top"),
    )
    if incidents is not None:
        per = incidents.select("incident_id").join(per, "incident_id", "left")
    n = F.coalesce(c("n"), F.lit(0))
    top_conf = F.coalesce(c("max_confidence"), F.lit(0.0))
    majority = F.coalesce(c("top.votes") >= F.floor(n / 2) + 1, F.lit(False))
    review = (top_conf < min_confidence) | ~majority
    return per.select(
        "incident_id", n.alias("n_findings"), top_conf.alias("max_confidence"),
        F.when(review, REVIEW).otherwise(c("top.lead.error_type")).alias("agreed_error_type"),
        F.when(review, REVIEW).otherwise(c("top.layer")).alias("primary_layer"),
        F.when(review, top_conf).otherwise(c("top.conf")).alias("confidence"),
        F.when(review, F.lit(0).cast("bigint")).otherwise(c("top.votes")).alias("votes"),
    )


def dissent(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The findings outside the majority layer of accepted incidents."""
    v = verdicts.filter(F.col("primary_layer") != REVIEW).select("incident_id", "primary_layer")
    return findings.join(v, "incident_id").filter(F.col("layer") != F.col("primary_layer")).select(
        "incident_id", "role", F.col("layer").alias("minority_layer"), F.col("rationale").alias("minority_view")
    )


def outcome(anomalous: Column, agreed: Column) -> Column:
    return (
        F.when(~F.coalesce(anomalous, F.lit(False)), "DISCARDED")
        .when(F.upper(agreed) == REVIEW, "DEGRADED").otherwise("TICKETED")
    )


def root_cause_prompt() -> Column:
    """Over verdict columns plus ``dissent_json`` and ``code_context``."""
    c = F.col
    code = F.when(F.length(F.trim(F.coalesce("code_context", F.lit("")))) > 0, c("code_context")).otherwise("No code attached")
    return prompts.render(
        prompts.ROOT_CAUSE, agreedErrorType=c("agreed_error_type"), primaryLayer=c("primary_layer"),
        swarmConfidence=c("confidence").cast("string"), dissentJson=c("dissent_json"), codeChunks=code,
    )


def root_cause(verdicts: DataFrame, fn: Completer | None = None) -> DataFrame:
    """Adds cause, evidence, alternatives. Incidents under review never reach the model."""
    none = F.array().cast("array<string>")
    review = F.upper("agreed_error_type") == REVIEW
    held = verdicts.filter(review).select(
        "*", F.lit(REVIEW_CAUSE).alias("cause"), none.alias("evidence"), F.col("confidence").alias("cause_confidence"),
        none.alias("alternatives"),
    )
    asked = complete(verdicts.filter(~review).withColumn("_prompt", root_cause_prompt()), "_prompt", fn, "_answer")
    a = F.from_json(extract_json(F.col("_answer")), ROOT_CAUSE_SCHEMA)
    answered = asked.withColumn("_a", a).select(
        *verdicts.columns, F.col("_a.cause").alias("cause"), F.coalesce("_a.evidence", none).alias("evidence"),
        F.col("_a.confidence").alias("cause_confidence"), F.coalesce("_a.alternatives", none).alias("alternatives"),
    )
    return held.unionByName(answered)


def ticket_prompt() -> Column:
    c = F.col
    return prompts.render(
        prompts.TICKET, cause=c("cause"), layer=c("primary_layer"), evidence=F.concat_ws("; ", c("evidence")),
        alternatives=F.concat_ws("; ", c("alternatives")),
    )


def files_or(own: Column, fallback: Column) -> Column:
    return F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) == 0, fallback).otherwise(own)


def draft_ticket(df: DataFrame, fn: Completer | None = None) -> DataFrame:
    """Adds the draft; its files fall back to those of the verdict (``suspected_files``) when it names none."""
    asked = complete(df.withColumn("_prompt", ticket_prompt()), "_prompt", fn, "_answer")
    none = F.array().cast("array<string>")
    t = F.from_json(extract_json(F.col("_answer")), TICKET_SCHEMA)
    return asked.withColumn("_t", t).select(
        *[c for c in df.columns if c != "suspected_files"], F.col("_t.title").alias("title"),
        F.col("_t.description").alias("description"), F.coalesce("_t.reproSteps", F.lit("")).alias("repro_steps"),
        files_or(F.col("_t.suspectedFiles"), F.coalesce("suspected_files", none)).alias("suspected_files"),
        F.col("_t.fixSuggestion").alias("fix_suggestion"),
    )


def priority_score(service: Column, ts: Column, tz: str = "UTC") -> Column:
    """Frequency 3, service 5 or 2, and 3 outside 08:00-18:00 local time (both ends outside)."""
    weight = F.when(F.lower(F.coalesce(service, F.lit(""))) == TOP_SERVICE, 5).otherwise(2)
    clock = F.date_format(F.from_utc_timestamp(ts, tz), "HH:mm:ss.SSSSSS")
    business = (clock > "08:00:00.000000") & (clock < "18:00:00.000000")
    return (F.lit(3) * weight * F.when(business, 1).otherwise(3)).cast("bigint")


def prioritize(df: DataFrame, service_col: str = "service", ts_col: str = "created_at", tz: str = "UTC",
               tiebreak_col: str = "tiebreak") -> DataFrame:
    """Adds score, severity, queue and justification; 15 to 30 is decided by the tie-break answer."""
    out = df.withColumn("priority_score", priority_score(F.col(service_col), F.col(ts_col), tz))
    s = F.col("priority_score")
    tie = F.when(F.contains(F.coalesce(F.col(tiebreak_col), F.lit("")), F.lit("P1")), "P1").otherwise("P2")
    sev = F.when(s > 30, "P0").when(s >= 15, tie).when(s > 5, "P2").otherwise("P3")
    # Severities and texts of the priority contract.
    why = F.when(s.between(15, 30), F.concat(F.lit("LLM mediated tiebreaker adjustment. Base score: "), s.cast("string"))).otherwise(
        F.concat(F.lit("Deterministic score metrics: "), s.cast("string"))
    )
    return out.select("*", sev.alias("calculated_severity"), F.lit(QUEUE).alias("routing_queue"), why.alias("justification"))


def resolve_incidents(incidents: DataFrame, fn: Completer | None = None, tz: str = "UTC") -> DataFrame:
    """Incident rows through panel, gate, root cause, draft and priority; one row per incident.

    ``incidents``: incident_id, service, created_at, is_anomaly, requirement, stack_trace, code_context.
    Model steps only see rows that passed the gate before them. The five roles bound what one incident
    collects.
    """
    live = incidents.filter("is_anomaly")
    asked = persona_prompts(fan_out(live), F.col("requirement"), F.col("stack_trace"), F.col("code_context"))
    # written down: the answers feed several steps and must not be asked for twice
    found = cut_lineage(parse_findings(complete(asked.select("incident_id", "role", "prompt"), "prompt", fn).drop("prompt")))
    verdicts = consensus(found, incidents=live)
    lists = (
        found.join(verdicts.select("incident_id", "primary_layer"), "incident_id").groupBy("incident_id").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("layer") == F.col("primary_layer"), F.col("suspected_files")))))).alias("suspected_files"),
            F.to_json(F.array_sort(F.collect_list(F.when(F.col("layer") != F.col("primary_layer"), F.struct("role", F.col("rationale").alias("minorityView")))))).alias("dissent_json"),
        )
    )
    base = verdicts.join(lists, "incident_id", "left").join(live.select("incident_id", "service", "created_at", "code_context"), "incident_id")
    causes = root_cause(base, fn)
    ok = causes.filter(F.col("agreed_error_type") != REVIEW)
    drafts = draft_ticket(ok, fn).withColumn(
        "_tie", prompts.render(prompts.PRIORITY, description=F.col("description"), score=priority_score(F.col("service"), F.col("created_at"), tz).cast("string"))
    )
    tickets = prioritize(complete(drafts, "_tie", fn, "tiebreak"), tz=tz).drop("_tie", "tiebreak")
    out = incidents.select("incident_id", "is_anomaly").join(
        verdicts.select("incident_id", "agreed_error_type", "primary_layer", "confidence", "n_findings"), "incident_id", "left"
    )
    record = lists.select("incident_id", F.col("suspected_files").alias("verdict_files"), "dissent_json")
    out = out.join(record, "incident_id", "left")
    cols = ["incident_id", "cause", "title", "description", "suspected_files", "fix_suggestion", "priority_score", "calculated_severity", "routing_queue", "justification"]
    return out.withColumn("status", outcome(F.col("is_anomaly"), F.col("agreed_error_type"))).join(tickets.select(*cols), "incident_id", "left")


def precision_at_k(df: DataFrame, k: int = 5) -> DataFrame:
    """Hits among the first ``k`` suggestions over ``k``, and over what could have been hit.

    Columns ``suggested`` and ``expected_files``; repeated suggestions count each time.
    """
    hits = F.size(F.filter(F.slice(F.col("suggested"), 1, k), lambda x: F.array_contains(F.col("expected_files"), x)))
    reachable = F.least(F.lit(k), F.size("expected_files"))
    return df.withColumn("hits", hits.cast("bigint")).withColumn("precision_at_k", F.col("hits") / F.lit(float(k))).withColumn(
        "reachable_precision", F.coalesce(F.col("hits") / F.nullif(reachable.cast("double"), F.lit(0.0)), F.lit(0.0))
    )


def layer_accuracy(df: DataFrame, k: int = 5) -> DataFrame:
    """Averages over the evaluation set, and whether both gates pass."""
    right = F.when(F.lower("primary_layer") == F.lower("expected_layer"), 1.0).otherwise(0.0)
    return precision_at_k(df, k).agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("layer_accuracy"), F.avg("precision_at_k").alias("precision_at_k"),
    ).withColumn("passed", (F.col("precision_at_k") >= PRECISION_GATE) & (F.col("layer_accuracy") >= LAYER_GATE))


def incident_pipeline(incidents: DataFrame, context: DataFrame, fn: Completer | None = None, tz: str = "UTC") -> DataFrame:
    """Opened incidents to tickets: retrieved code becomes the panel's context, then ``resolve_incidents``.

    ``context`` has (incident_id, id, content, rnk), at most top-k rows an incident, as ``anomaly_context``
    returns them. One row per incident: the consensus record with its files and dissent, and the ticket.
    """
    found = context.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "id", "content"))).alias("_c"))
    rows = incidents.join(found, "incident_id", "left").select(
        "incident_id", "service", F.col("first_seen_at").alias("created_at"), F.lit(True).alias("is_anomaly"),
        F.col("title").alias("requirement"), F.col("summary").alias("stack_trace"),
        F.coalesce(F.array_join(F.transform("_c", lambda x: x["content"]), "\n\n"), F.lit("")).alias("code_context"),
        F.coalesce(F.array_join(F.transform("_c", lambda x: x["id"].cast("string")), ","), F.lit("")).alias("context_ids"),
    )
    rows = cut_lineage(rows)
    return resolve_incidents(rows.drop("context_ids"), fn, tz).join(rows.select("incident_id", "context_ids"), "incident_id")
