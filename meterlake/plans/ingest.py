"""From log lines to a ledger."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.models import RATE_CARD, Rate
from meterlake.keys import ACCOUNT
from meterlake.operators import assemble as A
from meterlake.operators import context as C
from meterlake.operators import dedupe as D
from meterlake.sources.ledger import Ledger
from meterlake.sources.rollouts import parse_records
from meterlake.storage import Scratch, materialize


@dataclass(frozen=True)
class Metadata:
    """What is known beside the logs."""

    titles: DataFrame
    state: DataFrame
    edges: DataFrame


def context_records(lines: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Log records with the context they were written under.

    Carrying context takes two passes, so parsed records are stored and each line is read and
    parsed once. They stay in ``scratch`` until its owner clears it.
    """
    scratch = scratch or Scratch(lines.sparkSession, "records")
    return C.with_context(scratch.store(parse_records(lines), "records"))


def build_ledger(
    spark: SparkSession, ctx: DataFrame, sources: DataFrame, meta: Metadata,
    generated_at: datetime, since: datetime | None = None, rates: dict[str, Rate] = RATE_CARD,
) -> Ledger:
    """Assemble the ledger from stored context records.

    ``ctx`` is read once per kind of record, so hand in a stored table partitioned by kind
    (``stage``). ``sources`` is (account_id, file, size). Winners that several tables need are
    stored before they are joined.
    """
    origins = materialize(D.turn_origins(C.turn_candidates(ctx)), "origins")
    calls = materialize(D.dedupe_calls(C.token_records(ctx)), "calls")
    facts = materialize(A.thread_facts(
        meta.state, meta.titles, D.thread_parents(meta.edges, C.parent_candidates(ctx))), "facts")
    priced = A.since(A.price_events(A.attribute(calls, origins), facts, rates), since)
    tools = D.dedupe_tool_calls(C.call_records(ctx))
    events = materialize(A.attach_tool_calls(materialize(priced, "priced"), tools), "events")
    quota = materialize(A.since(D.dedupe_quota(C.quota_records(ctx)), since), "quota")
    threads = A.rollup_threads(events, facts, origins)
    cover = A.coverage(sources, C.file_counters(ctx), calls, events, threads, quota)
    return Ledger(events, threads, quota, cover, A.provenance(spark, generated_at))


def stage(lines: DataFrame) -> DataFrame:
    """Context records stored by kind."""
    scratch = Scratch(lines.sparkSession, "records")
    ctx = materialize(context_records(lines, scratch), "context", ["kind"])
    scratch.clear()
    return ctx


def ingest(
    spark: SparkSession, lines: DataFrame, sources: DataFrame, meta: Metadata,
    generated_at: datetime, since: datetime | None = None, rates: dict[str, Rate] = RATE_CARD,
) -> Ledger:
    """Lines to ledger in one go. ``sources`` may lack the account when there is only one."""
    if ACCOUNT not in sources.columns:
        sources = sources.withColumn(ACCOUNT, F.lit("default"))
    return build_ledger(spark, stage(lines), sources, meta, generated_at, since, rates)
