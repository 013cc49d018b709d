"""Time-locked epochs from two live streams, samples and markers.

``join_epochs`` is a stream-stream interval join: state is bounded by the watermark, and a busy recording is spread over
time slots. ``assemble_epochs`` keeps a retention buffer per recording and reports markers it had to skip; a recording
there is one device, so its state is bounded by retention times sampling rate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SAMPLES = "row_id long, recording_id long, ch string, ts timestamp, v double"
MARKERS = "code long, recording_id long, onset timestamp"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over Parquet files as they arrive, for bounded replays and tests."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _seconds(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / 1e6


def join_epochs(samples: DataFrame, markers: DataFrame, tmin: float, tmax: float, delay: str = "10 minutes") -> DataFrame:
    """Samples in ``[onset + tmin, onset + tmax)`` of each marker, as a left outer interval join on event time.

    A marker has one time slot, that of its window's begin; a window is as wide as a slot, so each sample stands in its
    own slot and in the one before. So the marker is one row of the outer join: one whose window stays empty comes out
    once with NULL samples when the watermark passes it. Code 0 is no marker.
    """
    width = max(tmax - tmin, 1e-6)
    own = F.floor(_seconds("ts") / width).cast("bigint")
    s = samples.withWatermark("ts", delay).withColumn("slot", F.explode(F.array(own, own - 1)))
    m = markers.where(F.col("code") != 0).withWatermark("onset", delay)
    m = m.withColumn("slot", F.floor((_seconds("onset") + tmin) / width).cast("bigint"))
    low = F.expr(f"INTERVAL {int(round(tmin * 1e6))} MICROSECOND")
    high = F.expr(f"INTERVAL {int(round(tmax * 1e6))} MICROSECOND")
    left, right = m.alias("m"), s.alias("s")
    inside = (
        (F.col("m.recording_id") == F.col("s.recording_id"))
        & (F.col("m.slot") == F.col("s.slot"))
        & (F.col("s.ts") >= F.col("m.onset") + low)
        & (F.col("s.ts") < F.col("m.onset") + high)
    )
    return left.join(right, inside, "left_outer").select(
        F.col("m.recording_id").alias("recording_id"),
        F.col("m.code").alias("code"),
        F.col("m.onset").alias("onset"),
        F.col("s.row_id").alias("row_id"),
        F.col("s.ch").alias("ch"),
        _seconds("s.ts").alias("t"),
        F.col("s.v").alias("v"),
    )


def epoch_rows(joined: DataFrame, max_gap: float | None = None) -> DataFrame:
    """One row per marker from ``join_epochs``: samples in arrival order, mean, largest gap and status. On a stream the
    row appears when the watermark has passed the marker's window."""
    packed = joined.groupBy("recording_id", "code", "onset").agg(
        F.sort_array(F.collect_list(F.when(F.col("row_id").isNotNull(), F.struct("row_id", "t", "ch", "v")))).alias("samples")
    )
    steps = F.transform(
        F.sequence(F.lit(2), F.size("samples")),
        lambda i: F.element_at("samples", i)["t"] - F.element_at("samples", i - 1)["t"],
    )
    gap = F.when(F.size("samples") > 1, F.array_max(steps))
    status = F.when(F.size("samples") == 0, "empty")
    if max_gap is not None:
        status = status.when(F.col("max_gap") > max_gap, "dropout")
    mean = F.when(
        F.size("samples") > 0, F.aggregate("samples", F.lit(0.0), lambda a, s: a + s["v"]) / F.size("samples")
    )
    return packed.withColumn("max_gap", gap).select(
        "recording_id",
        "code",
        "onset",
        F.size("samples").alias("n_samples"),
        mean.alias("mean_v"),
        "max_gap",
        status.otherwise("ok").alias("status"),
        "samples",
    )


def close_run(done: DataFrame, markers: DataFrame, tail: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Result of a bounded run with one row for every marker: ``done`` is what the stream has put out, and ``tail``
    gives, as a batch, the rows of the markers that were still waiting when the input ended."""
    keys = ["recording_id", "code", "onset"]
    given = markers.where(F.col("code") != 0)
    numbered = Window.partitionBy(*keys).orderBy(F.lit(0))  # equal markers only
    came = done.select(*keys).withColumn("_nth", F.row_number().over(numbered))
    left = given.withColumn("_nth", F.row_number().over(numbered)).join(came, [*keys, "_nth"], "left_anti").drop("_nth")
    return done.unionByName(tail(left).select(*done.columns))


ASSEMBLED = (
    "recording_id long, code long, onset double, n_samples long, max_gap double, status string, "
    "ch array<string>, t array<double>, v array<double>"
)
BUCKET_KEY = "bucket long"
BUCKET = "row_id array<long>, ch array<string>, t array<double>, v array<double>"
PENDING_KEY = "onset double, code long"
PENDING = "times long"
#: Of a recording: newest sample, time back to which samples are held, first bucket held, least end of a waiting marker's
#: window, and the timer that is set.
SPAN = "last double, earliest double, low long, due double, alarm long"


class RetentionBuffer(StatefulProcessor):
    """Samples of a recording in time buckets, its waiting markers, and one event-time timer for what is due next."""

    def __init__(self, tmin: float, tmax: float, retention: float, max_gap: float | None, width: float):
        self.tmin, self.tmax, self.retention, self.max_gap, self.width = tmin, tmax, retention, max_gap, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", BUCKET_KEY, BUCKET)
        self.pending = handle.getMapState("pending", PENDING_KEY, PENDING)
        self.span = handle.getValueState("span", SPAN)

    def _bucket(self, t: float) -> int:
        return int(np.floor(t / self.width))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, earliest, low, due, alarm = self.span.get() or (float("-inf"), float("inf"), None, float("inf"), None)
        # a call to the state costs far more than the rows in it: what cannot be there is not asked for
        waiting, filled = due < float("inf"), low is not None
        marks: Counter[tuple[float, int]] = Counter()
        for pdf in rows:
            marker = pdf["code"].notna().to_numpy()
            t = pdf["t"].to_numpy(float)
            if marker.any():
                marks.update(zip(t[marker].tolist(), pdf["code"].to_numpy()[marker].astype("int64").tolist()))
            if marker.all():
                continue
            t = t[~marker]
            columns = [pdf["row_id"].to_numpy()[~marker].astype("int64"), pdf["ch"].to_numpy()[~marker].astype(str), t, pdf["v"].to_numpy()[~marker]]
            place = np.floor(t / self.width).astype("int64")
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order])) + 1
            for part in np.split(order, cuts):
                bucket = int(place[part[0]])
                held = (self.buckets.getValue((bucket,)) if filled else None) or ([], [], [], [])
                self.buckets.updateValue((bucket,), tuple([*old, *new[part].tolist()] for old, new in zip(held, columns)))
                low = bucket if low is None else min(low, bucket)
            filled = True
            last, earliest = max(last, float(t.max())), min(earliest, float(t.min()))
        for (onset, code), n in marks.items():
            seen = self.pending.getValue((onset, code)) if waiting else None
            self.pending.updateValue((onset, code), (n + (seen[0] if seen else 0),))
            due = min(due, onset + self.tmax)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() / 1000.0, last, earliest, low, due, alarm)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.span.exists():
            *held, _ = self.span.get()
            yield from self._advance(key, timerValues.getCurrentWatermarkInMs() / 1000.0, *held, None)

    def _window(self, t0: float, t1: float, read: dict) -> tuple[np.ndarray, list, list]:
        """Times, channels and values of the samples in [t0, t1) by time and row; ``read`` keeps the buckets that a later
        window, which begins no earlier, may need again."""
        first, times, ch, v = self._bucket(t0), [], [], []
        for gone in [i for i in read if i < first]:
            del read[gone]
        for i in range(first, self._bucket(t1) + 1):
            if i not in read:
                ids, names, at, values = self.buckets.getValue((i,)) or ((), (), (), ())
                at = np.array(at, float)
                order = np.lexsort((np.array(ids, "int64"), at))
                read[i] = at[order], [names[j] for j in order], [values[j] for j in order]
            at, names, values = read[i]
            cut = slice(*np.searchsorted(at, (t0, t1)))
            times.append(at[cut])
            ch += names[cut]
            v += values[cut]
        return np.concatenate(times), ch, v

    def _settle(self, rec: int, code: int, onset: float, earliest: float, ready: bool, read: dict) -> dict:
        t0, t1 = onset + self.tmin, onset + self.tmax
        hit, ch, v = self._window(t0, t1, read)
        gap = float(np.diff(hit).max()) if len(hit) > 1 else None
        if not ready:
            status = "not_ready"
        elif earliest > t0:
            status = "aged_out"
        elif not len(hit):
            status = "empty"
        elif self.max_gap is not None and gap is not None and gap > self.max_gap:
            status = "dropout"
        else:
            status = "ok"
        if status != "ok":
            ch, hit_t, v = [], [], []
        else:
            hit_t = hit.tolist()
        return {
            "recording_id": rec, "code": code, "onset": onset, "n_samples": len(hit), "max_gap": gap, "status": status,
            "ch": ch, "t": hit_t, "v": v,
        }

    def _advance(
        self, key, now: float, last: float, earliest: float, low: int | None, due: float, alarm: int | None
    ) -> Iterator[pd.DataFrame]:
        """Put out the markers that can be, drop the buckets nobody needs, and set the timer for what comes next."""
        if due <= min(last, now) or due + self.retention <= now:
            rec, out, due, read = int(key[0]), [], float("inf"), {}
            for (onset, code), (times,) in sorted(self.pending.iterator()):
                end = onset + self.tmax
                ready = end <= min(last, now)
                if ready or end + self.retention <= now:
                    out += [self._settle(rec, code, onset, earliest, ready, read)] * times
                    self.pending.removeKey((onset, code))
                else:
                    due = min(due, end)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ASSEMBLED.split(", ")])
        if due == float("inf") and last + self.retention <= now:
            self.buckets.clear()
            self.span.clear()
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            return
        keep_from = min(last - self.retention, now - self.retention, due - self.tmax + self.tmin)
        if low is not None and (low + 1) * self.width <= keep_from:
            for (bucket,) in sorted(self.buckets.keys()):
                low = bucket
                if (bucket + 1) * self.width > keep_from:
                    break
                self.buckets.removeKey((bucket,))
                earliest = max(earliest, (bucket + 1) * self.width)
            else:
                low = None
        # A window whose end the watermark has passed waits for samples or for the end of its grace; so do later ones.
        times = [due if due > now else due + self.retention, last + self.retention]
        times += [(low + 1) * self.width + self.retention] if low is not None else []
        ahead = [x for x in times if x > now and np.isfinite(x)]
        wanted = max(int(np.ceil(min(ahead, default=now) * 1000)), int(now * 1000)) + 1
        if wanted != alarm:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            self.handle.registerTimer(wanted)
        self.span.update((last, earliest, low, due, wanted))

    def close(self) -> None:
        pass


def assemble_epochs(
    samples: DataFrame,
    markers: DataFrame,
    tmin: float,
    tmax: float,
    retention: float = 30.0,
    max_gap: float | None = 0.1,
    delay: str = "10 seconds",
    bucket: float | None = None,
) -> DataFrame:
    """Epochs from a retention buffer per recording, with a status for every marker.

    A marker is settled once its recording's samples and the watermark have reached ``onset + tmax``, so that samples
    which arrive out of order within ``delay`` count however the input is cut into batches: ``ok``, ``empty``,
    ``dropout`` or ``aged_out`` (the buffer doesn't reach back to ``onset + tmin``). Later markers do not wait for
    earlier ones, and a marker that came twice comes out twice. The buffer lies in buckets of ``bucket`` seconds (half a
    window by default) in a map state: a micro-batch writes the buckets that it fills and reads those of the windows
    that it settles. Buckets leave ``retention`` seconds behind the newest sample and the watermark, but never while a
    waiting marker needs them. When a recording falls silent for ``retention`` past a marker's window, the marker comes
    out as ``not_ready``. What still waits when a bounded run ends is finished by ``close_run``. State lives in the
    RocksDB store, which ``session.configure`` sets.
    """
    s = samples.select("recording_id", F.col("ts").alias("at"), "row_id", "ch", "v", F.lit(None).cast("bigint").alias("code"))
    m = markers.where(F.col("code") != 0).select(
        "recording_id",
        F.col("onset").alias("at"),
        F.lit(None).cast("bigint").alias("row_id"),
        F.lit(None).cast("string").alias("ch"),
        F.lit(None).cast("double").alias("v"),
        "code",
    )
    events = s.unionByName(m).withWatermark("at", delay).withColumn("t", _seconds("at"))
    buffer = RetentionBuffer(tmin, tmax, retention, max_gap, bucket or max((tmax - tmin) / 2, 1e-3))
    return events.groupBy("recording_id").transformWithStateInPandas(buffer, ASSEMBLED, "Append", "EventTime")


def montage(epochs: DataFrame, want: Sequence[str]) -> DataFrame:
    """``x array<array<double>>`` of assembled epochs: the samples of each wanted channel in order of time, channels in
    the order wanted, names without regard to case. An epoch that lacks one fails the query with its name; epochs that
    were not put together (status other than ``ok``) have no ``x``."""
    names = F.transform("ch", lambda c: F.upper(F.trim(c)))
    wanted = F.lit([n.strip().upper() for n in want])
    missing = F.array_except(wanted, names)
    error = F.raise_error(F.concat(F.lit("requested channels not in stream: "), F.array_join(missing, ", ")))
    rows = F.arrays_zip(names.alias("c"), F.col("v").alias("v"))
    picked = F.transform(wanted, lambda w: F.transform(F.filter(rows, lambda r: r["c"] == w), lambda r: r["v"]))
    x = F.when(F.size(missing) > 0, error.cast("array<array<double>>")).otherwise(picked)
    return epochs.withColumn("x", F.when(F.col("status") == "ok", x)).drop("ch", "t", "v")
