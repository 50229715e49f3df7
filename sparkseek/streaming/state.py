"""Stateful parts, as streams and, where it has one, as a batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from sparkseek.operators.refresh import apply_refresh, remove_subtree
from sparkseek.operators.usage import KINDS

#: State in these streams needs this provider.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: How long streams keep a session or query that gets no more rows.
KEEP_MS = 3_600_000

#: Ids or sources go through Python by so many buckets: a call for each of many would cost more than its rows.
BUCKETS = 1024

# Usage scores


def _named(held: list, new: pd.Series) -> tuple[np.ndarray, list]:
    """The number of each new name, and all names: those held before, then the others."""
    code, names = pd.factorize(np.array([*held, *new.tolist()], dtype=object), use_na_sentinel=False)
    return code[len(held) :], [None if pd.isna(n) else n for n in names]


_USAGE_STATE = "ids array<string>, scores array<double>, lasts array<long>"


def stream_usage(events: DataFrame, half_life_days: float = 14.0, kinds: list[str] = KINDS, buckets: int = BUCKETS) -> DataFrame:
    """usage_scores() of a stream of (id, kind, ts): a row for each id with new launches, in update mode. A launch before the
    last one adds what it would be worth by now. State, the score and last launch of the ids of a bucket, comes and goes
    with the rows."""
    life = half_life_days * 86_400.0

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        held, scores, lasts = state.get if state.exists else ([], [], [])
        code, ids = _named(held, rows["id"])
        ts, before = rows["ts"].to_numpy(np.int64), np.array(lasts, np.int64)
        last = np.append(before, np.full(len(ids) - len(held), np.iinfo(np.int64).min))
        np.maximum.at(last, code, ts)
        score = np.bincount(code, np.exp2((ts - last[code]) / life), len(ids))
        score[: len(held)] += np.array(scores, float) * np.exp2((before - last[: len(held)]) / life)
        state.update((ids, score.tolist(), last.tolist()))
        new = np.unique(code)
        yield pd.DataFrame({"id": [ids[k] for k in new], "usage_score": score[new], "last_launched": last[new]})

    launches = events.where(F.col("kind").isin(*kinds) & F.col("id").isNotNull() & F.col("ts").isNotNull()).select(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "id", "ts")
    return launches.groupBy("bucket").applyInPandasWithState(run, "id string, usage_score double, last_launched long", _USAGE_STATE, "update", GroupStateTimeout.NoTimeout)


# Health of sources

# How long a source stays shut after it failed too often, in ms, the first time and the next ones.
SHUT_MS = [30_000, 120_000, 600_000]


def health_step(state: tuple, ts: int, ok: bool, limit: int) -> tuple[tuple, bool]:
    """(state, admitted) of a call's outcome; state: failures in a row, times shut, shut until. A shut source is not
    called: such outcomes change nothing. After that time one call is a trial."""
    failures, shut, until = state
    if ts < until:
        return state, False
    if ok:
        return (0, 0, 0), True
    failures += 1
    if failures >= limit or shut:
        return (0, shut + 1, ts + SHUT_MS[min(shut, len(SHUT_MS) - 1)]), True
    return (failures, shut, 0), True


HEALTH = "source string, ts long, seq long, ok boolean, admitted boolean, shut_until long"


def health_gate(outcomes: DataFrame, limit: int = 3) -> DataFrame:
    """HEALTH of outcomes(source, ts, seq, ok), ts in ms: whether each call was let through, and until when its source
    is shut after it. What a call meets depends on all before it, so the outcomes of one source are one sequence in one
    task: they go through sorted, a batch at a time, with three numbers of state, whatever their number."""

    def run(batches):
        source, state = None, (0, 0, 0)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.source != source:
                    source, state = row.source, (0, 0, 0)
                state, admitted = health_step(state, int(row.ts), bool(row.ok), limit)
                out.append((row.source, row.ts, row.seq, row.ok, admitted, state[2]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HEALTH.split(", ")])

    return outcomes.select("source", "ts", "seq", "ok").repartition("source").sortWithinPartitions("source", "ts", "seq").mapInPandas(run, HEALTH)


_HEALTH_STATE = "sources array<string>, failures array<long>, shut array<long>, until array<long>"


def stream_health(outcomes: DataFrame, limit: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """health_gate() of a stream, in update mode. State, three numbers of each source of a bucket, comes and goes with the rows."""
    columns = [c.split()[0] for c in HEALTH.split(", ")]

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        held, *numbers = state.get if state.exists else ([], [], [], [])
        code, sources = _named(held, rows["source"])
        now, told = [*zip(*numbers, strict=True), *([(0, 0, 0)] * (len(sources) - len(held)))], []
        for k, ts, ok in zip(code.tolist(), rows["ts"].tolist(), rows["ok"].tolist(), strict=True):
            now[k], admitted = health_step(now[k], int(ts), bool(ok), limit)
            told.append((admitted, now[k][2]))
        state.update((sources, *map(list, zip(*now, strict=True))))
        admitted, until = zip(*told, strict=True)
        yield rows.assign(admitted=admitted, shut_until=until)[columns]

    dealt = outcomes.select(F.pmod(F.xxhash64("source"), F.lit(buckets)).alias("bucket"), "source", "ts", "seq", "ok")
    return dealt.groupBy("bucket").applyInPandasWithState(run, HEALTH, _HEALTH_STATE, "update", GroupStateTimeout.NoTimeout)


# Results that arrive in batches


def drop_superseded(batches: DataFrame) -> DataFrame:
    """Batch form: rows of the newest query_id of their session only."""
    newest = batches.groupBy("session").agg(F.max("query_id").alias("query_id"))
    return batches.join(newest, ["session", "query_id"], "left_semi")


class _Newest(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "query_id long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(rows))
        newest = max(int(all_rows["query_id"].max()), self.state.get()[0] if self.state.exists() else -1)
        self.state.update((newest,))
        yield all_rows[all_rows["query_id"] == newest]

    def close(self) -> None:
        pass


def _clock(on: bool) -> str:
    """With a clock a stream goes on without new rows, so one over what is there now (availableNow) needs to be without."""
    return "ProcessingTime" if on else "None"


def stream_drop_superseded(batches: DataFrame, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """Stream form: rows of a query older than the newest seen in their session are dropped as they come. A session without
    rows for keep_ms is forgotten; with None, for streams that end, none is."""
    return batches.groupBy("session").transformWithStateInPandas(
        statefulProcessor=_Newest(keep_ms), outputStructType=batches.schema, outputMode="Append", timeMode=_clock(bool(keep_ms)))


def merge_results(batches: DataFrame, limit: int | None = None) -> DataFrame:
    """The state of each query after batches(query_id, source, seq, volatile, id, score, title): the newest row of each
    id, where a volatile source's rows are those of its last batch only; ranked by score, then id."""
    last = batches.where("volatile").groupBy("query_id", "source").agg(F.max("seq").alias("last"))
    alive = batches.join(last, ["query_id", "source"], "left").where(F.col("last").isNull() | (F.col("seq") == F.col("last"))).where(F.col("id").isNotNull())
    newest = alive.groupBy("query_id", "id").agg(F.max_by(F.struct("source", "score", "title"), F.struct("seq", "source")).alias("r"))
    order = Window.partitionBy("query_id").orderBy(F.desc("r.score"), "id")
    ranked = newest.select("query_id", "id", "r.source", "r.score", "r.title", F.row_number().over(order).alias("rank"))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


MERGED = "query_id long, id string, source string, score double, title string, rank int"
_MERGED = [c.split()[0] for c in MERGED.split(", ")]


class _Merged(StatefulProcessor):
    """The rows of a query that still count, by source and id: of a volatile source those of its last batch, of any other
    the newest of each id. A row without an id is a batch without rows; with a status it ends its source.

    Rows are a list to which new ones are appended, all at once; which of them count is found when they are shown, and the
    list is written anew where most don't.

    With an interval, what comes is shown when a timer ends, so at most once in it; when all sources that were seen have
    ended it is shown at once. State goes keep_ms after it was last touched."""

    def __init__(self, interval_ms: int, keep_ms: int | None):
        self.interval_ms, self.keep_ms = interval_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "source string, id string, seq long, score double, title string", self.keep_ms)
        self.sources = handle.getMapState("sources", "source string", "last long, status string", self.keep_ms)
        self.due = handle.getValueState("due", "at long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["seq", "source"], kind="stable")
        seen, added = {k[0]: tuple(v) for k, v in self.sources.iterator()}, []
        for source, part in new.groupby("source", sort=False):
            last, status = seen.get(source, (None, None))
            ends = part["status"].dropna()
            status = str(ends.iloc[-1]) if len(ends) else status
            told = part[part["status"].isna()]
            wiped = told[told["volatile"].astype(bool)]
            if len(wiped):
                newest = int(wiped["seq"].max())
                last = newest if last is None else max(last, newest)
            if last is not None:
                told = told[told["seq"] == last]
            told = told[told["id"].notna()].drop_duplicates("id", keep="last")
            plain = lambda c: told[c].astype(object).where(told[c].notna(), None).tolist()
            added += zip([source] * len(told), plain("id"), map(int, told["seq"]), plain("score"), plain("title"), strict=True)
            seen[source] = (last, status)
            self.sources.updateValue((source,), seen[source])
        if added:
            self.rows.appendList(added)
        if not self.interval_ms or all(status for _, status in seen.values()):
            yield self.shown(key, seen)
        elif not self.due.exists():
            at = timer.getCurrentProcessingTimeInMs() + self.interval_ms
            self.due.update((at,))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.due.exists() and self.due.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            yield self.shown(key, {k[0]: tuple(v) for k, v in self.sources.iterator()})

    def shown(self, key, seen: dict) -> pd.DataFrame:
        """All rows of a query, ranked, and with rank 0 a row for each source that ended, its status as the title."""
        if self.due.exists():
            self.due.clear()
        kept = pd.DataFrame([tuple(r) for r in self.rows.get()], columns=["source", "id", "seq", "score", "title"])
        n, since = len(kept), {source: last for source, (last, _) in seen.items() if last is not None}
        kept = kept[kept["seq"] >= kept["source"].map(since).fillna(-np.inf).astype(float)]
        kept = kept.sort_values("seq", kind="stable").drop_duplicates(["source", "id"], keep="last")
        if n > 2 * len(kept) + 1000:
            self.rows.put([(source, ident, int(seq), None if pd.isna(score) else float(score), title) for source, ident, seq, score, title in kept.itertuples(index=False)])
        held = kept.sort_values(["seq", "source"], kind="stable").drop_duplicates("id", keep="last").sort_values(["score", "id"], ascending=[False, True])
        held["rank"] = range(1, len(held) + 1)
        ended = pd.DataFrame([(source, None, 0, None, status, 0) for source, (_, status) in sorted(seen.items()) if status], columns=[*held.columns])
        return pd.concat([x for x in (held, ended) if len(x)] or [held]).assign(query_id=key[0])[_MERGED]

    def close(self) -> None:
        pass


def stream_merged(batches: DataFrame, interval_ms: int = 0, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """merge_results() of a stream, in update mode: all rows of the queries that a micro-batch touches, or that are due. State
    is by query, source and id, so only what changes is written, and goes after keep_ms (None, for streams that end: never).

    A row with a status ('done', or what went wrong) and no id ends its source; each ended source is a row of rank 0
    without an id, and its status as title. With interval_ms a query is shown at most once in it, but at once when all its
    sources have ended."""
    if "status" not in batches.columns:
        batches = batches.withColumn("status", F.lit(None).cast("string"))
    return batches.groupBy("query_id").transformWithStateInPandas(
        statefulProcessor=_Merged(interval_ms, keep_ms), outputStructType=MERGED, outputMode="Update", timeMode=_clock(bool(interval_ms or keep_ms)))


def stream_merge_results(batches: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval_ms: int = 30, keep_ms: int = KEEP_MS):
    """Gives sink the merged results of the queries that are due, at most once an interval. Returns the running query.
    Needs the ROCKSDB state store."""
    merged = stream_merged(batches, interval_ms, keep_ms)
    return merged.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{interval_ms} milliseconds").start()


# Files that change


def apply_file_changes(table: DataFrame, touched: DataFrame, current: DataFrame) -> DataFrame:
    """The table by path after a micro-batch: every touched(path, seen_at) is resolved again against current, whatever
    the event was. Each path and all under it goes, then what exists of them now comes in."""
    paths = touched.groupBy("path").agg(F.max("seen_at").alias("seen_at")).select("path")
    left = remove_subtree(table, paths)
    untouched = remove_subtree(current, paths)
    now = current.join(untouched.select("path"), "path", "left_anti")
    return apply_refresh(left, now)


def quiet_paths(events: DataFrame, quiet: str = "500 milliseconds") -> DataFrame:
    """(path, first_seen, seen_at, n) of a stream of (path, seen_at), in append mode: a path is given once it had no event for
    so long after seen_at, with how many came since first_seen. Its state goes then. Time is that of the events; those without a path
    only tell the time, so that a last change isn't waited for."""
    at = F.timestamp_millis("seen_at") if events.schema["seen_at"].dataType.typeName() == "long" else F.col("seen_at")
    timed = events.select("path", at.alias("seen_at")).withWatermark("seen_at", "0 seconds")
    timed = timed.where(F.when(F.col("seen_at").isNotNull(), F.col("path").isNotNull()))  # on the time too, else it is moved before the watermark
    bursts = timed.groupBy("path", F.session_window("seen_at", quiet).alias("w")).agg(F.count("*").alias("n"), F.max("seen_at").alias("seen_at"))
    return bursts.select("path", F.col("w.start").alias("first_seen"), "seen_at", "n")


def stream_file_changes(events: DataFrame, read_table: Callable[[], DataFrame], read_current: Callable[[DataFrame], DataFrame], write_table: Callable[[DataFrame, int], None], checkpoint: str,
                        quiet: str = "500 milliseconds", interval: str = "500 milliseconds"):
    """Runs apply_file_changes() on the paths of a stream of (path, seen_at) that have become quiet (quiet_paths()). Returns
    the running query."""

    def update(df: DataFrame, epoch: int) -> None:
        touched = df.groupBy("path").agg(F.max("seen_at").alias("seen_at"))
        write_table(apply_file_changes(read_table(), touched, read_current(touched)), epoch)

    return quiet_paths(events, quiet).writeStream.outputMode("append").foreachBatch(update).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def stale_sources(fetch_log: DataFrame, now: int, interval_s: int, backoff_s: int = 300) -> DataFrame:
    """(source, stale) of fetch_log(source, ts, ok), in seconds: never fetched or fetched longer ago than the interval,
    held between an hour and a year, and no failed attempt within the backoff."""
    interval = min(max(interval_s, 3600), 365 * 86_400)
    last = fetch_log.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("good"), F.max(F.when(~F.col("ok"), F.col("ts"))).alias("bad"))
    due = F.col("good").isNull() | (now - F.col("good") > interval)
    waits = F.col("bad").isNotNull() & (now - F.col("bad") < backoff_s) & (F.col("good").isNull() | (F.col("bad") > F.col("good")))
    return last.select("source", (due & ~waits).alias("stale"))
