"""The mutation journal and the work it leaves owed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import keys

DEBOUNCE_MS = 30_000
EVENT = "seq long, mutation_id string, source string, op string, path string, from_path string, etag string, size long, committed_at long"


def numbered(rows: DataFrame, order: str, name: str, by: list[str] | None = None, width: int = 1_000_000) -> DataFrame:
    """Adds a number from 1 in order of a unique whole number, in each group of `by`.

    Rows are numbered inside ranges of `width` of the order, and the ranges' counts are summed up: no task gets a whole group.
    """
    by = by or []
    cut = rows.withColumn("__range", F.floor(F.col(order) / width))
    counts = cut.groupBy(*by, "__range").agg(F.count("*").alias("__count"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__range", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*by, "__range").orderBy(order)
    return cut.withColumn(name, F.row_number().over(inside)).join(starts, [*by, "__range"]).withColumn(name, F.col(name) + F.col("__start")).drop("__range", "__start")


def _columns(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}


def validate_events(events: DataFrame) -> DataFrame:
    """Adds error: why an event is no fact, or null."""
    return events.withColumn("error", keys.event_error(_columns(events)))


def drop_remote_apply(reports: DataFrame) -> DataFrame:
    """A copy that was downloaded is no fact."""
    return reports.where(~F.coalesce(F.col("origin") == "remote-apply", F.lit(False)))


def record_mutations(journal: DataFrame, events: DataFrame) -> DataFrame:
    """The rows to append: first fact of each new id, with the next numbers in order of arrival (a unique whole number).

    events: as EVENT, with arrival instead of seq.
    """
    first = events.groupBy("mutation_id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "mutation_id"]), "arrival").alias("e")).select("mutation_id", "e.*")
    new = first.join(journal.select("mutation_id"), "mutation_id", "left_anti")
    last = journal.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    return numbered(new, "arrival", "__n").join(F.broadcast(last)).withColumn("seq", F.col("last") + F.col("__n")).drop("last", "__n", "arrival")  # one row


def sequence_of(journal: DataFrame, events: DataFrame) -> DataFrame:
    """(mutation_id, seq) of every event that is recorded, repeats included."""
    return events.select("mutation_id").join(journal.select("mutation_id", "seq"), "mutation_id")


def verify_reports(reports: DataFrame, objects: DataFrame, journal: DataFrame, order: str | None = None) -> DataFrame:
    """Adds verdict: duplicate (before all else), accepted, or state-mismatch.

    A report is a duplicate if its id is in the journal, or if one before it in the batch was accepted under that id: what was not
    accepted is not recorded. order names a unique column (seq, where there is one); without it rows count in the order they are read in.
    """
    order = order or ("seq" if "seq" in reports.columns else None)
    reports = reports.withColumn("__at", F.col(order) if order else F.monotonically_increasing_id())
    known = journal.select("mutation_id").distinct().withColumn("__known", F.lit(True))
    now = objects.select(F.col("key").alias("path"), F.col("etag").alias("__now"))
    joined = reports.join(known, "mutation_id", "left").join(now, "path", "left")
    claimed, found = keys.normalize_etag(F.col("etag")), keys.normalize_etag(F.col("__now"))
    holds = F.when(F.col("op") == "delete", F.col("__now").isNull()).otherwise(F.coalesce(claimed == found, F.lit(False)))
    taken = joined.withColumn("__holds", holds).withColumn("__first", F.min(F.when(F.col("__holds"), F.col("__at"))).over(Window.partitionBy("mutation_id")))
    again = F.col("mutation_id").isNotNull() & (F.col("__at") > F.col("__first"))
    verdict = F.when(F.col("__known") | again, "duplicate").when(F.col("__holds"), "accepted").otherwise("state-mismatch")
    return taken.withColumn("verdict", verdict).drop("__known", "__now", "__at", "__holds", "__first")


def intents_for(events: DataFrame) -> DataFrame:
    """(path, action, target_etag, source, not_before, at, seq): what each event asks of the index; only an obsidian put is debounced."""
    wait = F.when((F.col("source") == "obsidian") & (F.col("op") == "put"), DEBOUNCE_MS).otherwise(0)
    intent = lambda path, action, etag: F.struct(path.alias("path"), F.lit(action).alias("action"), etag.cast("string").alias("target_etag"))
    none = F.lit(None).cast("string")
    upsert, remove, gone = intent(F.col("path"), "upsert", F.col("etag")), intent(F.col("path"), "remove", none), intent(F.col("from_path"), "remove", none)
    each = F.when(F.col("op") == "put", F.array(upsert)).when(F.col("op") == "delete", F.array(remove)).otherwise(F.array(gone, upsert))
    rows = events.select("seq", "source", "committed_at", (F.col("committed_at") + wait).alias("not_before"), F.posexplode(each).alias("part", "i"))
    return rows.select("i.path", "i.action", "i.target_etag", "source", "not_before", F.col("committed_at").alias("at"), "seq", "part")


def coalesce_intents(intents: DataFrame) -> DataFrame:
    """One row a path: the newest action with its etag and source, the latest not_before, the first time it was dirty.

    max_by aggregates partially before the shuffle, so a hot path costs a row a partition.
    """
    order = F.struct("seq", "part")
    newest = F.max_by(F.struct("action", "target_etag", "source"), order).alias("n")
    out = intents.groupBy("path").agg(newest, F.max("not_before").alias("not_before"), F.min_by("at", order).alias("first_dirty_at"), F.max_by("at", order).alias("updated_at"), F.max("seq").alias("seq"))
    return out.select("path", "n.action", "n.target_etag", "n.source", "not_before", "first_dirty_at", "updated_at", "seq", F.lit(0).alias("attempts"))


def merge_dirty(dirty: DataFrame, newer: DataFrame) -> DataFrame:
    """The dirty set with one more batch of coalesced intents folded in, whatever order batches come in. A newer intent starts with no attempts; the others keep theirs."""
    both = dirty.unionByName(newer, allowMissingColumns=True)
    told = "last_error" if "last_error" in both.columns else F.lit(None).cast("string").alias("last_error")
    pick = F.max_by(F.struct("action", "target_etag", "source", "updated_at", "attempts", told), "seq").alias("n")
    out = both.groupBy("path").agg(pick, F.max("not_before").alias("not_before"), F.min("first_dirty_at").alias("first_dirty_at"), F.max("seq").alias("seq"))
    return out.select("path", "n.action", "n.target_etag", "n.source", "not_before", "first_dirty_at", "n.updated_at", "seq", "n.attempts", "n.last_error")


def pending_summary(dirty: DataFrame, now: int) -> DataFrame:
    return dirty.agg(
        F.count_if(F.col("not_before") <= now).alias("due"), F.count_if(F.col("action") == "upsert").alias("upserts"),
        F.count_if(F.col("action") == "remove").alias("removes"), F.min("not_before").alias("earliest"),
    )


def due_paths(dirty: DataFrame, now: int, limit: int | None = 16) -> DataFrame:
    """The paths whose wait is over, the longest unchanged first; without a limit all of them, in no order."""
    due = dirty.where(F.col("not_before") <= now)
    return due if limit is None else due.orderBy("updated_at", "path").limit(limit)


def settle_intents(dirty: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The dirty set after a batch of work.

    outcomes: (path, action, target_etag, started_at, ok, error, retry_at). Done work leaves only if the intent is still the one
    that was worked on; failed work keeps its error, cut to 200 characters, and waits; a newer intent is kept as it is.
    """
    o = outcomes.select(F.col("path").alias("__p"), F.col("action").alias("__a"), F.col("target_etag").alias("__e"), "started_at", "ok", "error", "retry_at")
    joined = dirty.join(o, F.col("path") == F.col("__p"), "left")
    same = F.col("__p").isNotNull() & (F.col("action") == F.col("__a")) & F.col("target_etag").eqNullSafe(F.col("__e")) & (F.col("updated_at") <= F.col("started_at"))
    failed = same & ~F.col("ok")
    kept = joined.where(~(same & F.col("ok")))
    return kept.select(
        "path", "action", "target_etag", "source", F.when(failed, F.greatest("not_before", "retry_at")).otherwise(F.col("not_before")).alias("not_before"),
        "first_dirty_at", "updated_at", "seq", (F.col("attempts") + failed.cast("int")).alias("attempts"), F.when(failed, F.substring("error", 1, 200)).otherwise(F.col("last_error") if "last_error" in dirty.columns else F.lit(None)).alias("last_error"),
    )


def journal_state(journal: DataFrame) -> DataFrame:
    """One row: totals, counts by source, the last fact."""
    by = [F.count_if(F.col("source") == s).alias(f"from_{s}") for s in keys.SOURCES]
    state = F.coalesce(F.col("broadcast"), F.lit("pending")) if "broadcast" in journal.columns else F.lit("pending")
    return journal.agg(F.count("*").alias("total"), F.count_if(state == "pending").alias("pending"), F.count_if(state == "published").alias("published"), *by, F.max("seq").alias("last_seq"), F.max_by("mutation_id", "seq").alias("last_id"))


def deletion_index(journal: DataFrame, snapshot_seq: int | None = None, cursor: str | None = None, limit: int | None = None) -> DataFrame:
    """(path, etag, seq, committed_at): the paths whose last event is a delete with an etag. A rename away is an event of its source.

    A page is `limit` rows of paths after the cursor; has_more on its rows says whether others follow.
    """
    rows = journal if snapshot_seq is None else journal.where(F.col("seq") <= snapshot_seq)
    own = F.struct(F.col("path").alias("path"), F.col("op").alias("op"), F.col("etag").alias("etag"))
    left = F.struct(F.col("from_path").alias("path"), F.lit("renamed").alias("op"), F.lit(None).cast("string").alias("etag"))
    both = rows.select("seq", "committed_at", F.explode(F.when(F.col("op") == "rename", F.array(left, own)).otherwise(F.array(own))).alias("e")).select("seq", "committed_at", "e.*")
    last = both.groupBy("path").agg(F.max_by(F.struct("op", "etag", "seq", "committed_at"), "seq").alias("l")).select("path", "l.*")
    out = last.where((F.col("op") == "delete") & F.col("etag").isNotNull()).select("path", "etag", "seq", "committed_at")
    if cursor is not None:
        out = out.where(F.col("path") > cursor)
    if limit is None:
        return out
    page = out.orderBy("path").limit(limit + 1)
    return page.withColumn("__n", F.row_number().over(Window.orderBy("path"))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("__n") <= limit).drop("__n")


def pending_broadcasts(outbox: DataFrame, limit: int = 8) -> DataFrame:
    return outbox.where("broadcast = 'pending'").orderBy("seq").limit(limit)


def mark_broadcasts(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """results: (mutation_id, generation or null). A published row keeps its first generation; a failure touches pending rows only.

    An id reported more than once in a batch is one attempt; it is published if any report says so, under the least generation.
    """
    r = results.groupBy(F.col("mutation_id").alias("__m")).agg(F.min("generation").alias("__g"))
    joined = outbox.join(r, F.col("mutation_id") == F.col("__m"), "left")
    tried = F.col("__m").isNotNull() & (F.col("broadcast") == "pending")
    sent = tried & F.col("__g").isNotNull()
    return joined.withColumn("generation", F.when(sent, F.coalesce("generation", "__g")).otherwise(F.col("generation"))).withColumn("attempts", F.col("attempts") + tried.cast("int")).withColumn("broadcast", F.when(sent, "published").otherwise(F.col("broadcast"))).drop("__m", "__g")


def assign_generations(marks: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """marks: (channel, mutation_id or null, arrival, unique in its channel). Adds generation: a repeated id gets its first one again.

    earlier: (channel, mutation_id or null, generation) of marks before these; numbers go on from each channel's highest, else from 1.
    The hub of one channel forgets all but its newest 4096 ids; here it remembers what earlier holds, and all of its own.
    """
    rows = marks.withColumn("__id", F.coalesce(F.concat(F.lit("i"), F.col("mutation_id")), F.concat(F.lit("a"), F.col("arrival").cast("string"))))
    first = rows.groupBy("channel", "__id").agg(F.min("arrival").alias("__first"))
    if earlier is None:
        return rows.join(numbered(first, "__first", "generation", ["channel"]).drop("__first"), ["channel", "__id"]).drop("__id")
    last = earlier.groupBy("channel").agg(F.max("generation").alias("__last"))
    known = earlier.where("mutation_id is not null").groupBy("channel", F.concat(F.lit("i"), F.col("mutation_id")).alias("__id")).agg(F.min("generation").alias("generation"))
    fresh = numbered(first.join(known, ["channel", "__id"], "left_anti"), "__first", "__n", ["channel"]).join(last, "channel", "left")
    given = fresh.select("channel", "__id", (F.col("__n") + F.coalesce("__last", F.lit(0))).alias("generation")).unionByName(known)
    return rows.join(given, ["channel", "__id"]).drop("__id")


def gateway_changes(events: DataFrame) -> DataFrame:
    """What is broadcast: deletes as they are, puts and renames as a put of the path."""
    gone = F.col("op") == "delete"
    return events.select("seq", "mutation_id", F.when(gone, "delete").otherwise("put").alias("change"), "path", F.when(~gone, F.col("etag")).alias("etag"))


def fold_cursor(announced: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(client, highest_announced, last_reconciled, pending) from decimal strings; what is no generation is ignored."""
    number = lambda c: F.when(F.col(c).rlike(r"^(0|[1-9][0-9]*)\z"), F.col(c).try_cast("decimal(38,0)"))
    a = announced.select("client", number("generation").alias("a"), F.lit(None).cast("decimal(38,0)").alias("c"))
    c = confirmed.select("client", F.lit(None).cast("decimal(38,0)"), number("generation"))
    out = a.union(c).groupBy("client").agg(F.max("a").alias("a"), F.max("c").alias("c"))
    text = lambda x: F.coalesce(F.col(x), F.lit(0).cast("decimal(38,0)")).cast("string")
    return out.select("client", text("a").alias("highest_announced"), text("c").alias("last_reconciled"), F.coalesce(F.col("a") > F.coalesce("c", F.lit(0)), F.lit(False)).alias("pending"))
