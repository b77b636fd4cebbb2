"""Writes as pure merges: upserts, insert-if-absent, replacements, tombstones, deletes, retention budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.history import first_by


def upsert(existing: DataFrame, incoming: DataFrame, key: str, keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """``existing`` after ``incoming`` is merged in: new rows come in, known rows take the new values.

    Columns of ``keep`` stay as first inserted; those of ``fill`` take the new value only where there is one. One full
    outer join on the key, whatever the sizes.
    """
    old = existing.select(F.col(key), F.struct(*[c for c in existing.columns if c != key]).alias("_o"))
    new = incoming.select(F.col(key), F.struct(*[c for c in existing.columns if c != key]).alias("_n"))
    j = old.join(new, key, "full_outer")
    out = []
    for c in existing.columns:
        if c == key:
            out.append(F.col(key))
            continue
        o, n = F.col(f"_o.{c}"), F.col(f"_n.{c}")
        if c in keep:
            v = F.when(F.col("_o").isNotNull(), o).otherwise(n)
        elif c in fill:
            v = F.coalesce(n, o)
        else:
            v = F.when(F.col("_n").isNotNull(), n).otherwise(o)
        out.append(v.alias(c))
    return j.select(*out)


def replace_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], *order) -> DataFrame:
    """Rows of both with the last write of each key."""
    return first_by(existing.unionByName(incoming), keys, *order)


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key is not there yet: what a write would append."""
    return incoming.join(existing.select(key), key, "left_anti")


def patch(existing: DataFrame, changes: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """``existing`` with the columns ``allowed`` of the rows that ``changes`` names taken from there; null takes a value away.

    Other columns of ``changes`` but the key are refused; keys that aren't there change nothing.
    """
    other = [c for c in changes.columns if c != key and c not in allowed]
    if other:
        raise ValueError(f"not to be changed: {', '.join(other)}")
    new = [c for c in changes.columns if c != key]
    j = existing.join(changes.select(key, F.struct(*new).alias("_n")), key, "left")
    return j.select(*[F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in existing.columns])


def changed(before: DataFrame, after: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The rows of ``after`` that differ from ``before`` in any of the columns: what a backfill has to write."""
    old = before.select(key, F.struct(*columns).alias("_o"))
    return after.join(old, key).where(~F.struct(*columns).eqNullSafe(F.col("_o"))).drop("_o")


def rewrite_index(index: DataFrame, products: DataFrame, key: str = "product_id") -> DataFrame:
    """An index (key, token) after some products changed: all their rows go, and those of their tokens come."""
    new = products.select(F.col("id").alias(key), F.explode("tokens").alias("token")).distinct()
    return index.join(products.select(F.col("id").alias(key)), key, "left_anti").select(key, "token").unionByName(new)


def claim(jobs: DataFrame, claims: DataFrame, now: Column, lease: str) -> DataFrame:
    """``jobs`` (id, state, owner, lease_until) after ``claims`` (job, worker, at): a running job whose lease is over, or that
    has none, goes to the first claim, of equals the smaller worker, until ``now`` plus the lease; others keep their owner."""
    first = claims.groupBy(F.col("job").alias("id")).agg(F.min(F.struct("at", "worker"))["worker"].alias("_w"))
    free = (F.col("state") == "running") & (F.col("lease_until").isNull() | (F.col("lease_until") < now))
    j = jobs.join(first, "id", "left").withColumn("_take", free & F.col("_w").isNotNull())
    return j.withColumns({"owner": F.when(F.col("_take"), F.col("_w")).otherwise(F.col("owner")), "lease_until": F.when(F.col("_take"), now + F.expr(f"interval {lease}")).otherwise(F.col("lease_until"))}).drop("_w", "_take")


def adopt(rows: DataFrame, listers: DataFrame, key: str = "profile") -> DataFrame:
    """Rows without a profile after the first lister (profile, at) took them."""
    first = listers.agg(F.min(F.struct("at", key))[key].alias("_p"))
    # one row whatever the listers
    return rows.join(F.broadcast(first), F.lit(True), "left").withColumn(key, F.coalesce(key, "_p")).drop("_p")


def append_rows(rows: DataFrame, new: DataFrame, detail: list[str]) -> DataFrame:
    """Audit rows of both; what ``detail`` names is kept as one JSON text, nulls left out."""
    own = [c for c in rows.columns if c not in detail]
    pack = lambda df: df.select(*own, F.to_json(F.struct(*detail)).alias("detail"))
    return pack(rows).unionByName(pack(new))


def put_objects(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Objects (key, content, content_type) after ``new`` ones were put: the same key is written over."""
    return upsert(objects, new, "key")


def get_objects(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Of each key the object, or nulls where there is none."""
    return keys.select("key").join(objects, "key", "left")


def tombstone(products: DataFrame, merges: DataFrame) -> DataFrame:
    """Losers become merged, and older tombstones that pointed at a loser point at its survivor."""
    m = merges.select("loser", "survivor")
    j = products.join(m.select(F.col("loser").alias("id"), F.col("survivor").alias("_own")), "id", "left")
    j = j.join(m.select(F.col("loser").alias("merged_into"), F.col("survivor").alias("_next")), "merged_into", "left")
    return j.withColumns({"status": F.when(F.col("_own").isNotNull(), "merged").otherwise(F.col("status")), "merged_into": F.coalesce("_own", "_next", "merged_into")}).select(*products.columns)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``gone``; rows with a null key stay."""
    return df.join(gone.select(key), key, "left_anti")


def set_current(rows: DataFrame, confirmed: DataFrame, key: str, clean_run: bool) -> DataFrame:
    """Confirmed rows become current; the others become history only after a run without failures."""
    j = rows.join(confirmed.select(key).distinct().withColumn("_c", F.lit(True)), key, "left")
    other = F.lit(False) if clean_run else F.col("is_current")
    return j.withColumn("is_current", F.when(F.col("_c"), True).otherwise(other)).drop("_c")


def snapshot_verdict(old: Column, new: Column, same_bytes: Column) -> Column:
    """What becomes of a stored snapshot: an empty one never replaces a full one of the same bytes."""
    return F.when(old.isNull() & (new == 0), "skipped").when((new == 0) & (old > 0) & same_bytes, "refused-empty").when(old == new, "kept").otherwise("written")


def greedy_budget(rows: list[tuple], budget: int) -> list[tuple]:
    """Rows taken in order while they fit the budget; one that doesn't is skipped, later ones may fit. For bounded lists."""
    out = []
    for *row, cost in rows:
        if cost <= budget:
            budget -= cost
            out.append((*row, cost))
    return out


def budgeted(df: DataFrame, key: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """The rows of each ``key`` that ``greedy_budget`` takes of the key's whole list in ascending ``order``."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    listed = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], own.alias("row"))))
    g = df.groupBy(F.col(key).alias("_key")).agg(listed.alias("_l"))
    fits = f"aggregate(_l, named_struct('left', cast({budget} as bigint), 'at', cast(array() as array<int>), 'i', 0), (s, x) -> case when x.row.`{cost}` <= s.left then named_struct('left', s.left - x.row.`{cost}`, 'at', concat(s.at, array(s.i)), 'i', s.i + 1) else named_struct('left', s.left, 'at', s.at, 'i', s.i + 1) end, s -> transform(s.at, i -> _l[i].row))"
    return g.select(F.explode(F.expr(fits)).alias("_r")).select("_r.*")


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Writes a new version of a table beside the old one and returns its path: readers never see half a table."""
    out = f"{path}/v-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(out)
    return out
