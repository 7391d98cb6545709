"""The journal as a stream. Order is seq, idempotence is by mutation id; what must be remembered is Spark's own keyed state, with its timers.

Each function gives a streaming DataFrame of changes, to be written by any sink; `written_to` runs one to the end of its input into files. Folding the changes
(`current_dirty`, `current_deletions`) gives the present table, at any time. For large state set spark.sql.streaming.stateStore.providerClass to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from noteloom.operators import journal as J
from noteloom.sources.shared import drop, stored

WORK = "path string, action string, target_etag string, source string, not_before long, updated_at long, seq long, attempts int, retry_at long"
_KEPT = "action string, target_etag string, source string, not_before long, first_dirty_at long, updated_at long, seq long, part int, version long, told boolean"
DIRTY = "path string, kind string, action string, target_etag string, source string, not_before long, first_dirty_at long, updated_at long, seq long, part int, version long"
DELETION = "path string, change string, etag string, seq long, committed_at long, version long"
OUTBOX = "seq long, mutation_id string, change string, path string, etag string"


def stream_dedupe(events: DataFrame, keep: str | None = None) -> DataFrame:
    """Repeats of a mutation id go: for ever, as the journal never forgets; with `keep`, those within that time, and memory is bounded by it. Of repeats in one batch the one read first stays."""
    if keep is None:
        return events.dropDuplicates(["mutation_id"])
    timed = events.withColumn("__at", F.timestamp_millis("committed_at")).withWatermark("__at", keep)
    return timed.dropDuplicatesWithinWatermark(["mutation_id"]).drop("__at")


def _none(x):
    return None if x is None or x != x else x


def _dirty() -> Callable:
    """One path's intents: the newest (seq, part) has its say, not_before only grows, a timer tells when the wait is over."""
    names, shown = ([c.split(" ")[0] for c in x.split(", ")] for x in (_KEPT, DIRTY))

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = dict(zip(names, state.get, strict=True)) if state.exists else None
        row = lambda kind, s: pd.DataFrame([{"path": key[0], "kind": kind, **{c: s[c] for c in shown[2:]}}])[shown]
        if state.hasTimedOut:
            old["told"] = True
            state.update(tuple(old[c] for c in names))
            yield row("due", old)
            return
        rows = pd.concat(list(batches)).sort_values(["seq", "part"], kind="stable")
        first, last = rows.iloc[0], rows.iloc[-1]
        place, wait = (int(last["seq"]), int(last["part"])), int(rows["not_before"].max())
        s = dict(old) if old else {"not_before": wait, "first_dirty_at": int(first["at"]), "version": 0, "told": False}
        if old is None or place > (old["seq"], old["part"]):
            s |= {"action": last["action"], "target_etag": _none(last["target_etag"]), "source": last["source"], "updated_at": int(last["at"]), "seq": place[0], "part": place[1], "told": False}
        if wait > s["not_before"]:
            s |= {"not_before": wait, "told": False}
        s["first_dirty_at"], s["version"] = min(s["first_dirty_at"], int(first["at"])), s["version"] + 1
        over = not s["told"] and s["not_before"] < state.getCurrentWatermarkMs()
        s["told"] |= over
        state.update(tuple(s[c] for c in names))
        if not s["told"]:
            state.setTimeoutTimestamp(s["not_before"])
        yield row("dirty", s)
        if over:
            yield row("due", s)

    return follow


def stream_dirty_set(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Changes of the dirty set (DIRTY): a row of kind dirty for each new state of a path, and one of kind due when its wait is over.

    Timers go by the time of the events, which stands at the newest one less `late`, so the same events give the same rows whenever they are run. One of a smaller
    seq may raise not_before, and changes nothing else; Spark drops an event that is later than `late`.
    """
    timed = J.intents_for(stream_dedupe(events)).withColumn("__t", F.timestamp_millis("at")).withWatermark("__t", late)
    return timed.groupBy("path").applyInPandasWithState(_dirty(), DIRTY, _KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def stream_debounce(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The paths whose wait is over, each when its timer says so: 30 s after the last obsidian put."""
    return stream_dirty_set(events, late).where("kind = 'due'")


def current_dirty(changes: DataFrame) -> DataFrame:
    """The dirty set that the changes so far make, with told: whether its wait is over."""
    newest = changes.groupBy("path").agg(F.max_by(F.struct(*[c for c in changes.columns if c not in ("path", "kind")]), "version").alias("s"), F.max(F.when(F.col("kind") == "due", F.col("version"))).alias("due"))
    return newest.select("path", "s.*", F.coalesce(F.col("due") == F.col("s.version"), F.lit(False)).alias("told"))


def _last_event(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One path's last event; what changes is whether it is a deletion, and which."""
    old = state.get if state.exists else None
    last = pd.concat(list(batches)).sort_values(["seq", "part"], kind="stable").iloc[-1]
    if old and (int(last["seq"]), int(last["part"])) <= (old[2], old[3]):
        return
    new = [last["op"], _none(last["etag"]), int(last["seq"]), int(last["part"]), int(last["committed_at"])]
    gone = lambda e: e is not None and e[0] == "delete" and e[1] is not None
    version, out = old[5] if old else 0, []
    for change, e in (("retract", old), ("insert", new)):
        if gone(e):
            version += 1
            out.append((key[0], change, e[1], e[2], e[4], version))
    state.update((*new, version))
    if out:
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in DELETION.split(", ")])


def stream_deletions(events: DataFrame) -> DataFrame:
    """Changes of the deletion index (DELETION): inserts, and retractions of what no longer holds. A rename away is an event of its source."""
    own = F.struct(F.col("path"), F.col("op"), F.col("etag"), F.lit(1).alias("part"))
    left = F.struct(F.col("from_path").alias("path"), F.lit("renamed").alias("op"), F.lit(None).cast("string").alias("etag"), F.lit(0).alias("part"))
    each = stream_dedupe(events).select("seq", "committed_at", F.explode(F.when(F.col("op") == "rename", F.array(left, own)).otherwise(F.array(own))).alias("e"))
    kept = "op string, etag string, seq long, part int, committed_at long, version long"
    return each.select("e.*", "seq", "committed_at").groupBy("path").applyInPandasWithState(_last_event, DELETION, kept, "append", GroupStateTimeout.NoTimeout)


def current_deletions(changes: DataFrame) -> DataFrame:
    """The deletion index that the changes so far make."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("change", "etag", "seq", "committed_at"), "version").alias("l"))
    return last.where("l.change = 'insert'").select("path", "l.etag", "l.seq", "l.committed_at")


def written_to(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run to the end of what is there, into Parquet files; a restart goes on behind what was written."""
    return changes.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_outbox(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Deliver changes at least once, in order of seq inside a batch; batch number and mutation id make a repeat known."""
    once = J.gateway_changes(stream_dedupe(events))
    return once.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: send(df.orderBy("seq"), n)).start()


def put_off(spark: SparkSession, retries: str, before: int | None = None) -> DataFrame:
    """What failed and waits, as of the last piece of work (before one of a number)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(retries)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    numbers = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at)] if fs.exists(at) else []
    last = max((n for n in numbers if before is None or n < before), default=None)
    return spark.createDataFrame([], WORK) if last is None else spark.read.schema(WORK).parquet(f"{retries}/batch={last}")


def work(due: DataFrame, apply: Callable[[DataFrame, int], DataFrame], retries: str, n: int, now: int) -> None:
    """One piece of work: what is due, and what failed before and may be tried again, unless a newer state of its path is due.

    What fails now is put off until retry_at. The list of what waits is written anew under the number n, so a repeated piece of work starts where it started.
    """
    spark = due.sparkSession
    fresh = due.select("path", "action", "target_etag", "source", "not_before", "updated_at", "seq", F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("retry_at"))
    newest = fresh.groupBy("path").agg(F.max("seq").alias("__seq"))
    waiting = put_off(spark, retries, n).join(newest, "path", "left").where("__seq is null or __seq < seq").drop("__seq")
    todo = stored(fresh.unionByName(waiting.where(F.col("retry_at") <= now)), "stream-work")
    told = stored(apply(todo.drop("retry_at"), n).select("path", "seq", "ok", F.col("retry_at").alias("__retry")), "stream-told")
    failed = todo.join(told.where("not ok"), ["path", "seq"]).select(*[c for c in todo.columns if c not in ("attempts", "retry_at")], (F.col("attempts") + 1).alias("attempts"), F.col("__retry").alias("retry_at"))
    failed.unionByName(waiting.where(F.col("retry_at") > now)).select(*[c.split(" ")[0] for c in WORK.split(", ")]).write.mode("overwrite").parquet(f"{retries}/batch={n}")
    drop(todo)
    drop(told)


def stream_index(events: DataFrame, apply: Callable[[DataFrame, int], DataFrame], retries: str, checkpoint: str, now: Callable[[], int], late: str = "0 seconds") -> StreamingQuery:
    """Hand the paths whose wait is over to apply, batch by batch, with what failed before and may be tried again at now() (epoch ms).

    apply(due, n) re-reads the store, publishes, and returns (path, seq, ok, retry_at); a batch may be repeated after a loss, under its number. `work` does the same
    between batches, for what waits alone.
    """
    due = stream_debounce(events, late)
    return due.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: work(df, apply, retries, n, now())).start()
