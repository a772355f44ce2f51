"""Fallback-key lookups: one probe row meets at most one build row, by identifier first, then by title.

The build side is reduced to one row for each key by aggregates before it is joined. Catalyst picks the join
by size: small caches are broadcast under the session's own threshold, large ones are shuffled on the key,
and adaptive execution splits skewed keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from linkforge.functions.text import blank
from linkforge.operators.ordering import first_wins, last_wins


@dataclass(frozen=True)
class Index:
    """A keyed cache: rows, their identifier, title key and source order. ``titles`` are the columns of the
    title key (title and year, or title alone); ``veto`` marks title groups whose rows contradict each other."""

    rows: DataFrame
    uid: Column
    titles: list[Column]
    order: Column
    veto: Column | None = None

    def _packed(self) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in self.rows.columns])
        cols = [row.alias("_hit"), blank(self.uid).alias("_uid"), self.order.alias("_order"), *[t.alias(f"_t{i}") for i, t in enumerate(self.titles)]]
        return self.rows.select(*cols)

    def by_uid(self, last: bool = True) -> DataFrame:
        """_uid, _hit: the last row of an identifier wins."""
        pick = last_wins if last else first_wins
        return pick(self._packed().where("_uid is not null"), [F.col("_uid")], F.col("_order")).select("_uid", "_hit")

    def by_title(self) -> DataFrame:
        """_t0.., _hit, _veto: the first row of a title wins. A veto is relative to that first row."""
        keys = [f"_t{i}" for i in range(len(self.titles))]
        rows = self._packed().where(" and ".join(f"coalesce(cast({k} as string), '') != ''" for k in keys))
        first = first_wins(rows, [F.col(k) for k in keys], F.col("_order")).select(*keys, "_hit")
        if self.veto is None:
            return first.withColumn("_veto", F.lit(False))
        # each row against its group's first row: the contradiction is an aggregate over a join on the key
        again = rows.select(*keys, F.col("_hit").alias("_other")).join(first, keys)
        clash = again.withColumn("_clash", self.veto)
        return clash.groupBy(*keys).agg(F.first("_hit").alias("_hit"), F.bool_or("_clash").alias("_veto"))


def identity_conflict(first: str = "_hit", other: str = "_other") -> Column:
    """Two cached identities contradict: both have identifiers that differ, or both have names that differ."""
    def differ(name: str, lower: bool) -> Column:
        a, b = blank(F.col(first)[name]), blank(F.col(other)[name])
        a, b = (F.lower(a), F.lower(b)) if lower else (a, b)
        return F.coalesce(a != b, F.lit(False))

    return differ("uid", False) | differ("legal_name", True)


def fallback_lookup(base: DataFrame, index: Index, uid: Column, titles: list[Column], name: str) -> DataFrame:
    """``base`` with a struct column ``name`` (NULL without a hit) and ``<name>_mode``: 'uid', 'title' or ''.

    The identifier is tried first; a miss, or no identifier, falls through to the title key. A vetoed title
    key gives nothing. Rows of ``base`` neither multiply nor go."""
    keys = [f"_p{i}" for i in range(len(titles))]
    probe = base.select("*", blank(uid).alias("_pu"), *[t.alias(k) for t, k in zip(titles, keys)])
    by_uid = index.by_uid().withColumnsRenamed({"_hit": "_hit_uid"})
    by_title = index.by_title().withColumnsRenamed({"_hit": "_hit_title"})
    out = probe.join(by_uid, probe._pu == by_uid._uid, "left")
    on = [out[k] == by_title[f"_t{i}"] for i, k in enumerate(keys)]
    out = out.join(by_title, on, "left")
    hit_title = F.when(~F.coalesce(F.col("_veto"), F.lit(False)), F.col("_hit_title"))
    mode = F.when(F.col("_hit_uid").isNotNull(), "uid").when(hit_title.isNotNull(), "title").otherwise("")
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.coalesce("_hit_uid", hit_title).alias(name), mode.alias(f"{name}_mode"))


def keyed_union(parts: list[DataFrame], key: Column, order: Column) -> DataFrame:
    """Union by priority: of equal keys the earliest part's row stays (within a part the one of greatest
    ``order``: later rows overwrite)."""
    tagged = [p.withColumn("_prio", F.lit(i)) for i, p in enumerate(parts)]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return last_wins(every, [key], F.struct(-F.col("_prio"), order)).drop("_prio")


def lookup_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: hits and title hits of each lookup."""
    aggs = []
    for n in names:
        aggs += [F.count_if(F.col(f"{n}_mode") != "").alias(f"{n}_matches"), F.count_if(F.col(f"{n}_mode") == "title").alias(f"{n}_title_matches")]
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
