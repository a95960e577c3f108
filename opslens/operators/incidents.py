"""Incidents, tickets and the audit trail, all idempotent by incident id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions import ids
from opslens.operators.detect import Thresholds, evidence
from opslens.sources.envelopes import TICKETS_SCHEMA, to_envelope
from opslens.sources.snapshots import Snapshot
from opslens.sources.tables import DEFAULT_BUCKETS

# States on incidents, tickets and audit rows.
OPEN, PENDING = "OPEN", "PENDING"
TICKETED, DISCARDED, FAILED = "TICKETED", "DISCARDED", "FAILED"
AUDIT_AGENT = "ORCHESTRATOR"


def with_incident_id(detected: DataFrame) -> DataFrame:
    """Adds ``incident_id``; null where there is no report."""
    c = F.col
    return detected.withColumn(
        "incident_id", F.when(c("anomaly_type").isNotNull(), ids.incident_id(c("fingerprint"), c("anomaly_type")))
    )


def open_incidents(detected: DataFrame, existing: DataFrame | None = None, events: DataFrame | None = None,
                   thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row per new incident: its first report in (time, event id) order.

    The earliest report is a partial aggregate, so the many reports of a hot incident collapse before
    the shuffle. ``existing`` removes incidents that already have a ticket. The tenant of the opening event
    comes along if ``detected`` has it; else ``events`` (event_id, tenant_id) is asked for the few incidents.
    """
    c = F.col
    own = ["tenant_id"] if "tenant_id" in detected.columns else []
    numbers = ["score", "signal", "base_n", "fp_count", "fp_mean", "fp_std", "svc_errors", "svc_mean", "svc_std"]
    first = (
        detected.filter(c("anomaly_type").isNotNull())
        .groupBy("fingerprint", "anomaly_type")
        .agg(F.min(F.struct("ts_us", "event_id", "service", *numbers, *own)).alias("f"))
        .select("fingerprint", "anomaly_type", "f", "f.service", *[f"f.{x}" for x in numbers])
        .withColumn("evidence", F.to_json(evidence(thresholds)))
    )
    out = first.select(
        ids.incident_id(c("fingerprint"), c("anomaly_type")).alias("incident_id"),
        "fingerprint", "anomaly_type", c("f.event_id").alias("event_id"), "service", "score", "evidence",
        F.concat(F.lit("Anomaly: "), c("anomaly_type"), F.lit(" in "), c("service")).alias("title"),
        F.concat(F.lit("Fingerprint "), c("fingerprint")).alias("summary"),
        F.lit(OPEN).alias("status"), ids.severity(c("score")).alias("severity"),
        F.timestamp_micros(c("f.ts_us")).alias("first_seen_at"), F.timestamp_micros(c("f.ts_us")).alias("last_seen_at"),
        *[c(f"f.{x}").alias(x) for x in own],
    )
    if existing is not None:
        out = out.join(existing.select("incident_id"), "incident_id", "left_anti")
    if events is not None and not own:
        # inner first: the few incidents may travel to the events, not the reverse
        tenants = events.select("event_id", "tenant_id").join(out.select("event_id"), "event_id")
        out = out.join(tenants, "event_id", "left")
    return out


def stub_tickets(incidents: DataFrame) -> DataFrame:
    """The ticket of each new incident."""
    c = F.col
    return incidents.select(
        ids.name_uuid(F.encode(F.concat(F.lit("ticket:"), c("incident_id")), "UTF-8")).alias("ticket_id"),
        "incident_id",
        F.concat(F.lit("Anomaly Detected: "), c("anomaly_type"), F.lit(" in "), c("service")).alias("title"),
        F.concat(F.lit("Fingerprint: "), c("fingerprint"), F.lit("\nEvidence: "), c("evidence")).alias("description"),
        "severity", "service", F.array().cast("array<string>").alias("suspected_files"),
        F.lit(None).cast("string").alias("fix_suggestion"), F.lit(None).cast("string").alias("external_id"),
        F.lit(PENDING).alias("status"), c("first_seen_at").alias("created_at"),
    )


def audit_rows(detected: DataFrame, incidents: DataFrame, agent: str = AUDIT_AGENT) -> DataFrame:
    """One row per processed event with its final state.

    Opening events are matched on the unique event id, not on the incident, so a storm under one
    incident stays spread over the cluster.
    """
    c = F.col
    opened = incidents.select(c("event_id"), F.lit(True).alias("_opened"))
    run_id = ids.name_uuid(F.encode(F.concat(F.lit("run:"), c("event_id").cast("string")), "UTF-8"))
    return (
        with_incident_id(detected)
        .join(opened, "event_id", "left")
        .select(
            run_id.alias("execution_id"), F.coalesce("incident_id", run_id).alias("run_key"),
            F.lit(agent).alias("agent_name"), F.lit(0).alias("tokens_in"), F.lit(0).cast("decimal(10,6)").alias("cost_usd"),
            F.timestamp_micros(c("ts_us")).alias("started_at"), "event_id", "service",
            F.when(c("_opened"), F.lit(TICKETED)).otherwise(F.lit(DISCARDED)).alias("status"),
        )
    )


def failed_rows(dead: DataFrame, agent: str = AUDIT_AGENT) -> DataFrame:
    """Audit rows of records that could not be processed, from their dead letters."""
    at = F.map_from_entries("headers")
    origin = F.concat_ws(":", *[F.decode(at[f"x-error-original-{p}"], "UTF-8") for p in ("topic", "partition", "offset")])
    run_id = ids.name_uuid(F.encode(F.concat(F.lit("run:"), origin), "UTF-8"))
    return dead.select(
        run_id.alias("execution_id"), run_id.alias("run_key"), F.lit(agent).alias("agent_name"), origin.alias("origin"),
        F.lit(FAILED).alias("status"),
    )


def ticket_records(tickets: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """Tickets as records keyed by incident id; message ids follow the ticket, so a re-send repeats them."""
    c = F.col
    payload = F.struct(
        c("ticket_id").alias("id"), c("incident_id").alias("incidentId"), "title", "description", "severity", "service",
        c("suspected_files").alias("suspectedFiles"), "status",
    )
    t = c(tenant) if tenant in tickets.columns else F.lit(None).cast("string")
    return to_envelope(
        tickets.withColumn("occurred_at", c("created_at")), TICKETS_SCHEMA, "incident_id", payload=payload,
        message_id=c("ticket_id"), produced_at=c("created_at"), trace=F.lit(None).cast("string"), tenant=t,
    )


def upsert_incidents(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing rows untouched, new ids appended."""
    fresh = new.join(existing.select("incident_id"), "incident_id", "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def store_tickets(spark: SparkSession, path: str, new: DataFrame, epoch: int | None = None, buckets: int = DEFAULT_BUCKETS,
                  before_swap: Callable[[], None] | None = None) -> bool:
    """Insert new incidents, each with its ticket in one row, into the table at ``path``; rows that are there stay.

    Incident and ticket become visible together and with all others of the batch, or not at all; a batch whose epoch is
    stored already changes nothing. The result tells whether something was written.
    """
    tickets = stub_tickets(new)
    rows = new.join(tickets.select("incident_id", F.struct(*tickets.columns).alias("ticket")), "incident_id")
    merge = lambda old, batch: batch if old is None else upsert_incidents(batch, old)
    return Snapshot(spark, path, ["incident_id"], buckets).upsert(rows, merge, epoch, before_swap)
