"""Jobs, batches and their members: projections, orders, cursors, retries, repairs and retention."""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Outcomes and phases.
OUTCOMES = ("succeeded", "partially_succeeded", "no_change", "failed", "cancelled", "superseded", "dead_letter", "unsafe")
WORK_ITEM_STATES = ("pending", "running", "succeeded", "no_change", "review_required", "failed", "cancelled")
ACTIVE_PHASES = ("queued", "running", "stopping")
ATTENTION = ("failed", "partially_succeeded", "dead_letter", "unsafe")
DEFERRALS = (1, 5, 30)
REPAIRED_STATUS = {"failed": "failed", "dead_letter": "failed", "cancelled": "cancelled", "interrupted": "interrupted"}


def review_only(kind: Column, outcome: Column, failed_count: Column, group: str = "group") -> Column:
    """A grouped child that ended cleanly and only wants a person's decision; an unknown count of failures is none of these."""
    return F.coalesce((kind == group) & (outcome == "partially_succeeded") & (failed_count == 0), F.lit(False))


def batch_projection(parents: DataFrame, children: DataFrame) -> DataFrame:
    """job_id, children, ended, phase, outcome, attention_level, attention of each batch.

    parents(job_id, sealed, cancel_wanted); children(parent_id, type, phase, outcome, failed_count). A batch is over once it is
    sealed and all its children have ended. Successes and review-only children count as good; any other partial child, or
    good ones beside bad, cancelled or superseded ones, make the batch partial. Without good ones it is unsafe or failed
    if any child was, cancelled or superseded if some were, else unchanged.
    """
    c, n = F.col, lambda k: F.coalesce(F.col(k), F.lit(0))
    kids = children.withColumn("_review", review_only(c("type"), c("outcome"), c("failed_count")))
    sums = kids.where(c("parent_id").isNotNull()).groupBy(c("parent_id").alias("_p")).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(c("phase") != "queued").alias("_begun"), F.count_if("_review").alias("_review"),
        F.count_if(c("outcome").isin(*ATTENTION) & ~c("_review")).alias("_bad"), *[F.count_if(c("outcome") == o).alias(f"_{o}") for o in OUTCOMES],
    )
    j = parents.select("job_id", "sealed", "cancel_wanted").join(sums, c("job_id") == c("_p"), "left")
    ended = sum((n(f"_{o}") for o in OUTCOMES), F.lit(0))
    good = n("_succeeded") + n("_no_change") + n("_review")
    bad, partial = n("_failed") + n("_dead_letter") + n("_unsafe"), n("_partially_succeeded") - n("_review")
    over = c("sealed") & (ended == n("_all"))
    outcome = (
        F.when(n("_all") == 0, "no_change").when(partial > 0, "partially_succeeded")
        .when(good > 0, F.when(bad + n("_cancelled") + n("_superseded") > 0, "partially_succeeded").when(n("_succeeded") + n("_review") > 0, "succeeded").otherwise("no_change"))
        .when(bad > 0, F.when(n("_unsafe") > 0, "unsafe").otherwise("failed"))
        .when((n("_superseded") > 0) & (n("_superseded") == ended), "superseded").when(n("_cancelled") > 0, "cancelled").otherwise("no_change")
    )
    phase = F.when(over, "terminal").when(c("cancel_wanted"), "stopping").when(n("_begun") > 0, "running").otherwise("queued")
    level = F.when(n("_bad") > 0, F.when(n("_unsafe") > 0, "error").otherwise("warning"))
    return j.select("job_id", n("_all").cast("long").alias("children"), ended.cast("long").alias("ended"), phase.alias("phase"), F.when(over, outcome).alias("outcome"), level.alias("attention_level"), n("_bad").cast("long").alias("attention"))


def state_counts(items: DataFrame, key: str, state: str, states: Sequence[str]) -> DataFrame:
    """key, total and a count of each known state (0 where there is none)."""
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(state) == s).alias(s) for s in states])


def severity(level: Column) -> Column:
    return F.when(level == "error", 2).when(level == "warning", 1).otherwise(0)


def queue_keys() -> list[tuple[Column, bool]]:
    """The queue's order as (key, descending): the gravest first, running before waiting, then priority, age and id."""
    c = F.col
    return [(severity(c("level")), True), (F.when(c("phase").isin("running", "stopping"), 0).otherwise(1), False), (c("priority"), True), (c("eligible_at"), False), (c("created_at"), False), (c("job_id"), False)]


def history_keys(sort: str = "") -> list[tuple[Column, bool]]:
    """The history's order: by creation up or down, else the latest ended first."""
    down = sort != "created"
    return [(F.col("created_at" if sort in ("created", "-created") else "terminal_at"), down), (F.col("job_id"), down)]


def ordered(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    """In the order of these keys; nulls stand first where it falls and last where it rises."""
    return df.orderBy(*[k.desc_nulls_first() if down else k.asc_nulls_last() for k, down in keys])


CURSOR = 1024  # most bytes of a cursor's values


class CursorError(ValueError):
    """A cursor that is malformed, too long or of another query."""


def contract(view: str, filters: Mapping[str, object], sort: str) -> bytes:
    """What a cursor is good for: a view, its order and the filters that are set."""
    h = hashlib.blake2b(digest_size=32)
    for said in (view, sort, *(f"{k}={v!r}" for k, v in sorted(filters.items()) if v is not None)):
        h.update(len(said.encode()).to_bytes(4) + said.encode())
    return h.digest()


def encode_cursor(query: bytes, key: Sequence[str | int | float | None]) -> str:
    """A key's values as binary fields (kind, length, bytes), sealed by a digest keyed with the query that they belong to."""
    fields = b""
    for x in key:
        if x is not None and not isinstance(x, str | int | float):
            raise CursorError("a cursor holds plain values only")
        kind, body = (b"n", b"") if x is None else (b"s", x.encode()) if isinstance(x, str) else (b"f", struct.pack(">d", x)) if isinstance(x, float) else (b"i", str(int(x)).encode())
        fields += kind + len(body).to_bytes(2) + body if len(body) < CURSOR else b""
        if len(body) >= CURSOR or len(fields) > CURSOR:
            raise CursorError("cursor too long")
    return (hashlib.blake2b(fields, key=query, digest_size=12).digest() + fields).hex()


def decode_cursor(token: str, query: bytes) -> list:
    """The values of a cursor of this query; one that was changed, cut or made for another query is refused."""
    try:
        raw = bytes.fromhex(token) if len(token) <= 2 * (CURSOR + 12) else b""
    except ValueError:
        raw = b""
    seal, rest = raw[:12], raw[12:]
    if not seal or not hmac.compare_digest(seal, hashlib.blake2b(rest, key=query, digest_size=12).digest()):
        raise CursorError("not a cursor of this query")
    read, key = {b"n": lambda b: None, b"s": bytes.decode, b"f": lambda b: struct.unpack(">d", b)[0], b"i": int}, []
    while rest:
        size = int.from_bytes(rest[1:3])
        key.append(read[rest[:1]](rest[3 : 3 + size]))
        rest = rest[3 + size :]
    return key


def visible(jobs: DataFrame, promote: Mapping[str, Sequence[str]], hidden: Mapping[str, Sequence[str]]) -> DataFrame:
    """Jobs without parents that give way to their children and without children that their parents hide.

    promote: parent type -> child types in whose presence the parent is hidden; hidden: parent type -> child types that
    are hidden below it.
    """
    pairs = lambda m: F.array(*[F.struct(F.lit(p).alias("p"), F.lit(k).alias("k")) for p, ks in m.items() for k in ks])
    family = jobs.select(F.col("job_id").alias("_id"), F.col("type").alias("_pt")).join(jobs.where("parent_id IS NOT NULL").select("parent_id", F.col("job_id").alias("_kid"), F.col("type").alias("_kt")), F.col("_id") == F.col("parent_id"))
    named = F.struct(F.col("_pt").alias("p"), F.col("_kt").alias("k"))
    gone = family.where(F.array_contains(pairs(promote), named)).select(F.col("_id").alias("job_id"))
    gone = gone.union(family.where(F.array_contains(pairs(hidden), named)).select("_kid"))
    return jobs.join(gone.distinct(), "job_id", "left_anti")


def active_members(jobs: DataFrame, members: DataFrame, batch: str) -> DataFrame:
    """Subjects that active work covers: of single items, and of members of groups, active themselves or below an active
    batch. jobs(job_id, parent_id, type, phase, subject), members(job_id, subject)."""
    parent = jobs.where((F.col("type") == batch) & F.col("phase").isin(*ACTIVE_PHASES)).select(F.col("job_id").alias("_p"), F.lit(True).alias("_on"))
    own = jobs.where(F.col("type").isin("item", "group")).join(parent, F.col("parent_id") == F.col("_p"), "left")
    own = own.where(F.col("phase").isin(*ACTIVE_PHASES) | F.col("_on"))
    single = own.where(F.col("type") == "item").select("subject")
    grouped = own.where(F.col("type") == "group").select("job_id").join(members, "job_id").select("subject")
    return single.union(grouped).where(F.col("subject").isNotNull()).distinct()


def repair_runs(runs: DataFrame, batches: DataFrame, now: str) -> DataFrame:
    """runs(run_id, batch_id, status, completed_at, error) with those still running under an ended batch put right.

    batches(job_id, phase, outcome, terminal_at). Only outcomes that REPAIRED_STATUS names change a run; its own end and
    error stay where it has them.
    """
    new = F.coalesce(*[F.when(F.col("outcome") == k, v) for k, v in REPAIRED_STATUS.items()])
    ended = batches.where(F.col("phase") == "terminal").select(F.col("job_id").alias("_b"), new.alias("_new"), F.col("terminal_at").alias("_end"), F.col("outcome").alias("_why")).where("_new IS NOT NULL")
    may = F.coalesce((F.col("status") == "running") & F.col("batch_id").isNotNull(), F.lit(False))
    # Rows that no batch can change pass by the join: in it, all without a batch would be one key.
    j = runs.where(may).join(ended, F.col("batch_id") == F.col("_b"), "left")
    j = j.unionByName(runs.where(~may), allowMissingColumns=True)
    stale = (F.col("status") == "running") & F.col("_new").isNotNull()
    at = F.lit(now).cast("timestamp_ntz")
    return j.select("run_id", F.when(stale, F.col("_new")).otherwise(F.col("status")).alias("status"), F.when(stale, F.coalesce("completed_at", "_end", at)).otherwise(F.col("completed_at")).alias("completed_at"), F.when(stale, F.coalesce("error", "_why")).otherwise(F.col("error")).alias("error"), F.coalesce(stale, F.lit(False)).alias("repaired"))


def retryable(groups: DataFrame, members: DataFrame, rows: DataFrame) -> DataFrame:
    """job_id, member of what a retry of each group would take up again.

    groups(job_id, outcome), members(job_id, member), rows(job_id, member, status). A partial group needs one row for every
    member, and gives its failed ones; a failed or cancelled group must have no rows, and gives all its members.
    """
    want = members.groupBy("job_id").agg(F.array_sort(F.collect_list("member")).alias("_want"))
    have = rows.groupBy("job_id").agg(F.array_sort(F.collect_list("member")).alias("_have"), F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("member")))).alias("_failed"))
    j = groups.join(want, "job_id").join(have, "job_id", "left")
    give = F.when((F.col("outcome") == "partially_succeeded") & (F.col("_have") == F.col("_want")), F.col("_failed")).when(F.col("outcome").isin("failed", "cancelled") & F.col("_have").isNull(), F.col("_want"))
    return j.select("job_id", F.explode(give).alias("member"))


def group_snapshot(members: DataFrame, movies: DataFrame, series: DataFrame, seasons: DataFrame) -> DataFrame:
    """job_id, place, kind, subject_id, title of the members of groups in the order they were asked for.

    members(job_id, asked array<struct<kind, id>>), movies(movie_id, title), series(series_id, title), seasons(season_id,
    series_id). Members that do not exist have a null title; a season is called after its series.
    """
    m = members.select("job_id", F.posexplode("asked").alias("place", "m")).select("job_id", "place", F.col("m.kind").alias("kind"), F.col("m.id").alias("subject_id"))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("subject_id"))
    j = m.join(movies.select(F.col("movie_id").alias("_m"), F.col("title").alias("_mt")), of("movie") == F.col("_m"), "left")
    j = j.join(seasons.select(F.col("season_id").alias("_s"), F.col("series_id").alias("_of")), of("season") == F.col("_s"), "left")
    j = j.join(series.select(F.col("series_id").alias("_r"), F.col("title").alias("_rt")), F.coalesce(of("series"), F.col("_of")) == F.col("_r"), "left")
    return j.select("job_id", "place", "kind", "subject_id", F.coalesce("_mt", "_rt").alias("title"))


def claim(rows: DataFrame, due: Column, key: str, to: str, limit: int = 50) -> DataFrame:
    """rows(key, status, ...) with the first `limit` due ones, by key, set to the status `to`; adds claimed."""
    first = rows.where(due).select(key).orderBy(key).limit(limit).withColumn("_due", F.lit(True))
    j = rows.join(F.broadcast(first), key, "left")  # `limit` keys
    return j.withColumns({"status": F.when(F.col("_due"), to).otherwise(F.col("status")), "claimed": F.coalesce("_due", F.lit(False))}).drop("_due")


def deferral_seconds(times: Column) -> Column:
    """How long the n-th deferral of an admission waits; null once there is no further one."""
    return F.when(times.between(1, len(DEFERRALS)), F.element_at(F.array(*[F.lit(s) for s in DEFERRALS]), times.cast("int")))


def plan_checksum(keys: DataFrame, key: str) -> DataFrame:
    """planned, checksum of a set of keys, whatever their order or partitions: sums and xors of their hashes."""
    h = F.xxhash64(key)
    return keys.agg(F.count(F.lit(1)).alias("planned"), F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(2**31))), F.lit(0))), 256).alias("checksum"))


def delete_planned(rows: DataFrame, due: Column, key: str, checksum: str | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is left of rows after the due ones are deleted, and the plan (planned, checksum, deleted).

    With a checksum, nothing is deleted unless the due rows are still those it was made of; a dry run deletes nothing.
    """
    gone = rows.where(due).select(key)
    plan = plan_checksum(gone, key)
    ok = F.lit(not dry_run) & (F.lit(checksum is None) | (F.col("checksum") == F.lit(checksum or "")))
    plan = plan.withColumn("deleted", F.when(ok, F.col("planned")).otherwise(F.lit(0)))
    act = gone.crossJoin(F.broadcast(plan.where(F.col("deleted") > 0).select("deleted"))).select(key)  # one row
    return rows.join(act.distinct(), key, "left_anti"), plan


def insert_once(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """stored and those rows of `new` whose key neither has nor had before; of new rows of one key the first by `order` counts."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return stored.unionByName(first.join(stored.select(key).distinct(), key, "left_anti"))


def relink(links: DataFrame, seen: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A bridge table after a sync, and its files with those that nothing links to any more retired.

    links(episode_id, file_id), seen(episode_id, file_id), files(file_id, active). An episode that was seen has the links
    it was seen with and no others; other episodes keep theirs. Files that were seen are active; one that lost a link and
    has none left is not.
    """
    kept = links.join(seen.select("episode_id").distinct(), "episode_id", "left_anti")
    after = kept.select("episode_id", "file_id").union(seen.select("episode_id", "file_id")).distinct()
    lost = links.join(after, ["episode_id", "file_id"], "left_anti").select("file_id").join(after.select("file_id"), "file_id", "left_anti").distinct().withColumn("_lost", F.lit(True))
    here = seen.select("file_id").distinct().withColumn("_seen", F.lit(True))
    known = files.join(here, "file_id", "full").join(lost, "file_id", "left")
    return after, known.select("file_id", F.when(F.col("_seen"), True).when(F.col("_lost"), False).otherwise(F.col("active")).alias("active"))


def related(jobs: DataFrame, hit: Column) -> DataFrame:
    """Jobs that match, or whose parent or one of whose children does."""
    found = jobs.where(hit).select("job_id", "parent_id")
    own = found.select("job_id")
    parents = found.where("parent_id IS NOT NULL").select("parent_id")
    children = jobs.join(own.select(F.col("job_id").alias("_p")), F.col("parent_id") == F.col("_p"), "left_semi").select("job_id")
    return jobs.join(own.union(parents).union(children).distinct(), "job_id", "left_semi")


def child_totals(jobs: DataFrame, changed: str, sequence: str) -> DataFrame:
    """job_id of every job without a parent, with its children's counts in all and by outcome, their largest sequence (0
    without children) and latest change."""
    kids = jobs.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("_p")).agg(F.count(F.lit(1)).alias("created"), F.count_if(F.col("phase") == "terminal").alias("ended"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.max(sequence).alias("sequence"), F.max(changed).alias("changed"))
    names = ["created", "ended", *OUTCOMES, "sequence"]
    j = jobs.where("parent_id IS NULL").select("job_id").join(kids, F.col("job_id") == F.col("_p"), "left")
    return j.select("job_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names], "changed")


def retention_due(jobs: DataFrame, holds: list[DataFrame], before: Column, limit: int) -> DataFrame:
    """The first `limit` ended jobs from before a time that nothing holds (tables of job_id), nor an active child; one more
    tells that there are more."""
    due = jobs.where((F.col("phase") == "terminal") & (F.col("terminal_at") < before))
    active = jobs.where((F.col("phase") != "terminal") & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("job_id"))
    for hold in [*holds, active]:
        due = due.join(hold.select("job_id").distinct(), "job_id", "left_anti")
    return due.orderBy("terminal_at", "job_id").limit(limit + 1)


def uncovered(requests: DataFrame, active: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of requests(request, subject): the subjects neither under way nor in review; and, for requests all of whose subjects
    are under way in one active parent, that parent. active(subject, parent), review(subject)."""
    on = requests.join(active.groupBy("subject").agg(F.min("parent").alias("parent"), F.lit(True).alias("_on")), "subject", "left")
    seen = on.join(review.select("subject").distinct().withColumn("_seen", F.lit(True)), "subject", "left")
    open_ = seen.where(F.col("_on").isNull() & F.col("_seen").isNull()).select("request", "subject")
    all_on = on.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.count("_on").alias("k"), F.count("parent").alias("p"), F.min("parent").alias("parent"), F.max("parent").alias("_to"))
    return open_, all_on.where("n = k AND n = p AND parent = _to").select("request", "parent")


def rebuild_due(wanted: DataFrame, built: DataFrame, key: str, threshold: int, force: bool = False) -> DataFrame:
    """key, changed, due: for each profile how many inputs were added or have gone since it was built, and whether it is to
    be built again: forced, never built, or changed by `threshold` inputs. wanted(key, input), built(key, input)."""
    a, b = wanted.select(key, "input").distinct().withColumn("_a", F.lit(True)), built.select(key, "input").distinct().withColumn("_b", F.lit(True))
    j = a.join(b, [key, "input"], "full").groupBy(key).agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("changed"), F.count("_b").alias("_built"))
    return j.select(key, "changed", (F.lit(force) | (F.col("_built") == 0) | (F.col("changed") >= threshold)).alias("due"))


def equal_active(jobs: DataFrame, subject: str, request: list[str]) -> DataFrame:
    """asked, active: for each active job the oldest active one of its subject with an equal request, where that is another."""
    own = jobs.where(F.col("phase").isin(*ACTIVE_PHASES))
    w = Window.partitionBy(subject, *request).orderBy("created_at", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("active", F.first("job_id").over(w)).where(F.col("active") != F.col("job_id")).select(F.col("job_id").alias("asked"), "active")
