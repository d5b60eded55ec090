"""Streams of incoming briefs and shortlist selections.

Each micro-batch is saved into keyed tables in versions (``sources.versions``), so a batch that is
repeated after a failure leaves the same rows as when it ran once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadflow import schemas as S
from leadflow.operators import route as R
from leadflow.operators.normalize import normalize_briefs
from leadflow.operators.shared import handover
from leadflow.sources import tables as TB
from leadflow.sources import versions as VS
from leadflow.sources.briefs import contract_error, validate_briefs, validate_requests


def _landed(df: DataFrame, batch: int) -> DataFrame:
    """Rows with the batch that last saved them and the one that first did."""
    number = F.lit(batch).cast("bigint")
    return df.withColumns({"first_batch": number, "batch": number})


def land_briefs(raw: DataFrame, batch: int, requests_root: str, quarantine_root: str) -> None:
    """Check, normalise and save one batch of raw JSON briefs (column ``payload``).

    A brief's key is its request id, or its whole text where it has none, as 128 bits of its
    SHA-256: a repeated brief updates its row instead of adding one.  Of several briefs of one key in
    a batch the greatest payload wins, however they are spread over files; a later batch wins over an
    earlier one.  Refused briefs are kept once per payload.
    """
    given = F.get_json_object("payload", "$.request_id")
    key = F.substring(F.sha2(F.coalesce(given, F.col("payload")).cast("binary"), 256), 1, 32)
    briefs = handover(raw.select(key.alias("brief_id"), "payload"), "briefs")
    checked = handover(briefs.withColumn("error", contract_error(F.col("payload"))), "checked")
    refused = checked.filter(F.col("error").isNotNull())
    # one row per key before the work on its text
    winners = checked.filter(F.col("error").isNull()).groupBy("brief_id").agg(F.max("payload").alias("payload"))
    within, outside = validate_requests(handover(normalize_briefs(validate_briefs(winners)[0]), "requests"))
    late = outside.select("brief_id", F.col("user_text").alias("payload"), "error")
    bad = refused.unionByName(late).groupBy("payload").agg(F.max("brief_id").alias("brief_id"), F.max("error").alias("error"))
    VS.save(_landed(within, batch), requests_root, ["brief_id"], keep=["first_batch"])
    VS.save(_landed(bad, batch), quarantine_root, ["payload"], keep=["first_batch"])


def start_brief_intake(
    spark: SparkSession, source: str, requests_root: str, quarantine_root: str, checkpoint: str
) -> StreamingQuery:
    """Read JSON-lines files of briefs as they arrive."""
    raw = spark.readStream.text(source).select(F.col("value").alias("payload"))
    return (
        raw.writeStream.foreachBatch(lambda df, batch: land_briefs(df, batch, requests_root, quarantine_root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_requests(spark: SparkSession, root: str) -> DataFrame:
    return VS.read(spark, root).drop("bucket")


# ---------------------------------------------------------------- selections

#: Tables of a store of runs that selections work on, with their keys.
KEYS = {
    "options": ["shortlist_id", "option_number"],
    "runs": ["run_id"],
    "accepted_leads": ["lead_id"],
    "crm_records": ["lead_id"],
    "memory": ["scope", "kind", "value"],
    "refused": ["batch", "shortlist_id", "option_number"],
    "shortlists": ["shortlist_id"],
}


def create_store(store: str, options: DataFrame, shortlists: DataFrame, runs: DataFrame) -> None:
    """Makes the tables that selections read: ``options`` (all open), ``shortlists`` (see ``tables.shortlist_records``), ``runs``."""
    VS.create(options.withColumn("open", F.lit(True)), f"{store}/options", KEYS["options"])
    VS.create(runs, f"{store}/runs", KEYS["runs"])
    VS.create(shortlists.withColumn("batch", F.lit(None).cast("bigint")), f"{store}/shortlists", KEYS["shortlists"])


def table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """Current rows of a table of the store."""
    return VS.read(spark, f"{store}/{name}").drop("bucket")


def land_selections(selections: DataFrame, batch: int, store: str) -> None:
    """Promote one batch of selections against the current tables and save all that follows from it.

    Saved under the batch's number: accepted leads, CRM records, memory entries, options no longer
    open, runs completed, selections refused, and, last, the shortlists cleared.  A shortlist takes
    the first sound selection only.  A shortlist that the same batch has cleared already counts as
    pending, so a batch that is repeated, wherever it broke off, saves the same rows again.
    """
    spark = selections.sparkSession
    number = F.lit(batch).cast("bigint")
    asked = handover(selections, "selections")
    shortlists, options, runs = (table(spark, store, n) for n in ("shortlists", "options", "runs"))
    mine = F.col("batch") == number
    status = F.when(mine, "pending").otherwise(F.col("status"))
    now = handover(shortlists.withColumn("status", status), "shortlists")
    out = R.promote(asked, handover(options.drop("open"), "options"), now, runs)
    leads = handover(out["accepted_leads"], "leads")
    taken = leads.select("shortlist_id", "option_number")

    def save(df: DataFrame, name: str, keep: list[str] | None = None) -> None:
        VS.save(df, f"{store}/{name}", KEYS[name], keep)

    save(leads.withColumn("batch", number), "accepted_leads")
    save(R.crm_records(leads).withColumn("batch", number), "crm_records")
    entries = out["memory_deltas"].withColumn("first_seen", number)
    save(entries.groupBy("scope", "kind", "value").agg(F.min("value_norm").alias("value_norm"), F.min("first_seen").alias("first_seen")), "memory", ["first_seen"])
    save(out["refused"].withColumn("batch", number), "refused")
    save(options.join(taken, ["shortlist_id", "option_number"], "left_semi").withColumn("open", F.lit(False)), "options")
    done = leads.select("run_id").distinct()
    save(runs.join(done, "run_id", "left_semi").withColumn("status", F.lit("completed")), "runs")
    cleared = TB.settled(now, taken, F.coalesce(F.col("updated_at"), F.col("created_at"))).withColumn("batch", number)
    save(cleared, "shortlists", ["created_at"])


def start_selection_intake(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Read JSON files of ``{shortlist_id, option_number}`` as they arrive."""
    chosen = spark.readStream.schema(S.SELECTIONS).json(source)
    return (
        chosen.writeStream.foreachBatch(lambda df, b: land_selections(df, b, store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
