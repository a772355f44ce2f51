"""Keyed state over Parquet: upserts, null-safe anti-joins, manifests, resumable scans, caches with a lifetime.

There is no table format here, so an upsert is a union reduced per key; the writer swaps directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkforge.operators.ordering import last_wins


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: dict[str, Column] | None = None, coalesced: list[str] = ()) -> DataFrame:
    """New rows replace old ones of the same key. ``keep`` gives columns an aggregate over both versions (such
    as the first time seen); ``coalesced`` columns keep the old value where the new one is NULL."""
    both = old.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)), allowMissingColumns=True)
    keep = keep or {}
    row = F.struct(*[F.col(c) for c in both.columns if c not in keys and c != "_version"])
    packed = both.select(*keys, "_version", row.alias("_row"), *[F.col(c).alias(f"_keep_{c}") for c in keep], *[F.col(c).alias(f"_co_{c}") for c in coalesced])
    aggs = [F.max_by("_row", "_version").alias("_row")]
    aggs += [F.expr(f"{how}(_keep_{c})").alias(f"_keep_{c}") for c, how in keep.items()]
    aggs += [F.max_by(f"_co_{c}", F.when(F.col(f"_co_{c}").isNotNull(), F.col("_version"))).alias(f"_co_{c}") for c in coalesced]
    out = packed.groupBy(*keys).agg(*aggs)
    cols = [F.col(f"_keep_{c}").alias(c) if c in keep else F.col(f"_co_{c}").alias(c) if c in coalesced else F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in old.columns]
    return out.select(*cols)


def upsert_by_canonical(old: DataFrame, new: DataFrame, arrival: str = "record_row_id") -> DataFrame:
    """Upsert by (source_id, canonical_url) with a second unique key, (source_id, position): a row that loses its
    position to another gets the negative of its record id; payload columns keep old values under NULLs. Of several
    new rows of one position the last by ``arrival`` has it."""
    rows = upsert(old, new, ["source_id", "canonical_url"], {"first_discovered_at": "min", "record_row_id": "min"}, ["record_json", "row_json"])
    fresh = new.where("position > 0").groupBy("source_id", F.col("position").alias("_taken")).agg(F.max_by("canonical_url", arrival).alias("_by"))
    joined = rows.join(fresh.withColumnRenamed("source_id", "_source"), (F.col("source_id") == F.col("_source")) & (F.col("position") == F.col("_taken")) & (F.col("canonical_url") != F.col("_by")), "left")
    return joined.select(*[F.when(F.col("_by").isNotNull(), -F.abs("record_row_id")).otherwise(rows.position).alias(c) if c == "position" else rows[c] for c in rows.columns])


def get_or_insert(table: DataFrame, wanted: DataFrame, key: str, now: Column) -> DataFrame:
    """``table`` with new keys added and ``last_seen_at`` set for wanted ones."""
    wanted = wanted.select(key).distinct().withColumn("_want", F.lit(True))
    return table.join(wanted, key, "full_outer").select(
        key,
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(F.col("_want"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def anti_insert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys, NULLs equal, are neither in ``existing`` nor earlier in ``new`` (by pos)."""
    row = F.struct(*new.columns)
    one = new.groupBy(*keys).agg(F.min_by(row, "pos").alias("_row")).select("_row.*")
    on = reduce(lambda a, b: a & b, [one[k].eqNullSafe(existing[k]) for k in keys])
    return one.join(existing, on, "left_anti")


def latest_status(records: DataFrame, runs: DataFrame, batch_id: Column, directory: Column) -> DataFrame:
    """Latest status of each project over the runs of one batch; batch ids compare with NULLs equal."""
    own = runs.where(F.coalesce("batch_id", F.lit(-1)) == F.coalesce(batch_id, F.lit(-1))).where(F.col("directory") == directory)
    return last_wins(records.join(own.select("run_id"), "run_id"), [F.col("project_id")], F.struct("run_id", "record_row_id")).select("project_id", "status")


#: Statuses that a retry takes up and those that end a project.
RETRYABLE = ("failed", "no_sources_found")
FINAL = ("approved", "rejected", "skipped")


def should_select(status: Column, action: str) -> Column:
    """Whether a project of this latest status is taken by a resume action."""
    rules = {
        "enrich_unprocessed": status.isNull(),
        "retry_failed": status.isin(*RETRYABLE),
        "re_enrich_all": F.lit(True),
        "resume": status.isNull() | ~status.isin(*FINAL),
    }
    return F.coalesce(rules[action], F.lit(False))


def select_records(records: DataFrame, latest: DataFrame, action: str, count: int) -> DataFrame:
    """The first ``count`` records in batch order that the action takes."""
    joined = records.join(latest, "project_id", "left")
    return joined.where(should_select(F.col("status"), action)).orderBy("batch_index").limit(count)


def count_finished(latest: DataFrame) -> DataFrame:
    """One row: how many projects have a latest status that ends them."""
    return latest.agg(F.count_if(F.col("status").isin(*FINAL)).alias("n"))


def default_requested_count(records: DataFrame, latest: DataFrame, action: str) -> DataFrame:
    """One row: how many records a resume action asks for by default; those without a latest status if it is no other."""
    joined = records.select("project_id").join(latest.select("project_id", "status", F.lit(True).alias("_known")), "project_id", "left")
    rules = {
        "retry_failed": F.col("status") == "failed",
        "re_export_approved": F.col("status") == "approved",
        "reprocess_changed_rules": ~F.col("status").eqNullSafe("approved"),
    }
    return joined.agg(F.count_if(rules.get(action, F.col("_known").isNull())).alias("n"))


def next_unprocessed(candidates: DataFrame, records: DataFrame, done=("completed", "skipped", "excluded")) -> DataFrame:
    """One row: the least position whose canonical URL is absent or not done; NULL if none."""
    finished = records.where(F.col("status").isin(*done)).select("canonical_url")
    return candidates.join(finished, "canonical_url", "left_anti").agg(F.min("position").alias("position"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full-outer difference of (url, position) tables: url and label new, removed, reordered or unchanged."""
    o, n = old.select("url", F.col("position").alias("was")), new.select("url", F.col("position").alias("now"))
    label = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "reordered").otherwise("unchanged")
    return o.join(n, "url", "full_outer").select("url", "was", "now", label.alias("label"))


def attempt_window(candidates: DataFrame, group: list[str], order: Column, requested: Column) -> DataFrame:
    """The rows that a resumable scan looks at: in order, until ``requested`` successes or one fifth more (one at
    least) attempts. ``attempted`` and ``succeeded`` are booleans; completed rows are neither and cost nothing.

    A group is one scan; its rows are ordered by one task, as the limit is sequential by nature."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tried = F.coalesce(F.count_if("attempted").over(before), F.lit(0))
    made = F.coalesce(F.count_if("succeeded").over(before), F.lit(0))
    ceiling = requested + F.greatest(F.lit(1), F.floor(requested / 5))
    return candidates.withColumn("_tried", tried).withColumn("_made", made).where((F.col("_made") < requested) & (F.col("_tried") < ceiling)).drop("_tried", "_made")


def overlay_changes(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with approved values laid over their fields; of several changes to a field the last (by change_id)
    counts. An approved NULL counts as '' and overwrites."""
    latest = changes.where(F.col("review_status").isin("approved", "edited")).where(F.col("field").isin(*fields))
    per = [F.max_by(F.coalesce("final_value", F.lit("")), F.when(F.col("field") == f, F.col("change_id"))).alias(f"_new_{f}") for f in fields]
    wide = latest.groupBy(key).agg(*per)
    joined = rows.join(wide, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def cached_search(queries: DataFrame, cache: DataFrame, now: Column, ttl_days: int = 30, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of keyed queries in a cache whose rows live ``ttl_days``; cached errors are hits too."""
    if refresh:
        return cache.limit(0), queries
    live = cache.where(F.col("retrieved_at") >= now - F.expr(f"interval {ttl_days} days"))
    live = last_wins(live, [F.col("key")], F.col("retrieved_at"))
    return live.join(queries.select("key").distinct(), "key", "left_semi"), queries.join(live, "key", "left_anti")


def approval_matches(approvals: DataFrame, context: DataFrame, columns: list[str]) -> DataFrame:
    """Approvals whose context equals, NULLs alike, in every column."""
    on = reduce(lambda a, b: a & b, [approvals[c].eqNullSafe(context[c]) for c in columns])
    return approvals.join(context, on, "left_semi")


def exists_completed(records: DataFrame, urls: DataFrame) -> DataFrame:
    """The URLs with a completed record."""
    return urls.join(records.where("status = 'completed'"), "canonical_url", "left_semi")
