"""Delta mining on a stream of full scans: correlated pairs from a bounded history of each sample, and their sessions.

The same definitions as in ``ionquarry.operators.deltas``, so that a replayed table gives the batch's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ionquarry.operators import deltas

PAIRS = "sample_id long, scan_id long, n long, mz1 double, mz2 double, correlation double"
_NAMES = [c.split()[0] for c in PAIRS.split(", ")]
_CACHED = ["sample_id", *[c.split()[0] for c in deltas.CACHED.split(", ")]]


def pairs_of(history: list[tuple[np.ndarray, np.ndarray]], top: int, least: float, correlation: float, ppm: float) -> list[tuple[float, float, float]]:
    """(mz1, mz2, correlation) of the last scan's top peaks, over the scans (mz, intensity, by m/z) of ``history``."""
    mz, y = history[-1]
    some = np.flatnonzero(y > least)
    some = some[np.lexsort((mz[some], -y[some]))][:top]
    tops, traces = np.unique(mz[some]), []
    for m in tops:
        low, high = m * (1 - ppm / 1e6), m * (1 + ppm / 1e6)
        traces.append([float(b[(a >= low) & (a <= high)].max(initial=0.0)) for a, b in history])
    out = []
    for i, (m1, t) in enumerate(zip(tops, traces, strict=True)):
        for m2, u in zip(tops[i + 1 :], traces[i + 1 :], strict=True):
            a, b = np.array(t), np.array(u)
            scale = a.std() * b.std()
            r = 1.0 if t == u else float(((a - a.mean()) * (b - b.mean())).mean() / scale) if scale > 0 else 0.0
            if r > correlation:
                out.append((float(m1), float(m2), r))
    return out


def _rocksdb(spark: SparkSession) -> None:
    """State of several columns needs the RocksDB store, which also keeps it on disk instead of on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _joined(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


class _Idle(StatefulProcessor):
    """State with one timer, set anew by each batch of rows: ``idle`` milliseconds after the latest time in them."""

    def __init__(self, time_col: str | None, idle: int) -> None:
        self.time_col, self.idle = time_col, idle

    def renew(self, rows: pd.DataFrame) -> None:
        if self.time_col is None:
            return
        at = int(rows[self.time_col].max().timestamp() * 1000) + self.idle
        timers = list(self.handle.listTimers())
        if not timers or max(timers) < at:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class ScanHistory(_Idle):
    """The last ``history`` scans of a sample, a state row each, and the open scan; a scan is judged when the next one comes or the sample falls idle."""

    def __init__(self, options: tuple, history: int, time_col: str | None, idle: int) -> None:
        super().__init__(time_col, idle)
        self.options, self.history = options, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "mz array<double>, intensity array<double>")
        self.open = handle.getValueState("open", "closed long, scan_id long, mz array<double>, intensity array<double>")

    def _judged(self, key: tuple, scans: list[tuple], n: int) -> list[tuple]:
        """Pairs of ``scans`` (scan_id, mz, intensity) that are complete, of which ``n`` came before."""
        held = [(np.array(m, float), np.array(y, float)) for m, y in self.held.get()]
        out = []
        for k, (scan, mz, y) in enumerate(scans, n + 1):
            mz, y = np.array(mz, float), np.array(y, float)
            order = np.lexsort((y, mz))
            held = [*held, (mz[order], y[order])][-self.history :]
            if len(held) == self.history:
                out += [(key[0], scan, k, *p) for p in pairs_of(held, *self.options)]
        self.held.put([(m.tolist(), y.tolist()) for m, y in held])
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _joined(rows)
        n, last, mz, y = self.open.get() if self.open.exists() else (0, None, [], [])
        scans = [] if last is None else [(last, list(mz), list(y))]
        for scan, group in frame.groupby("scan_id", sort=True):
            if last is not None and scan < last:
                continue
            if scan == last:
                scans[-1][1].extend(group["mz"])
                scans[-1][2].extend(group["intensity"])
            else:
                scans.append((int(scan), group["mz"].tolist(), group["intensity"].tolist()))
        out = self._judged(key, scans[:-1], n) if len(scans) > 1 else []
        if scans:
            scan, mz, y = scans[-1]
            self.open.update((n + len(scans) - 1, scan, [float(m) for m in mz], [float(v) for v in y]))
        self.renew(frame)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.open.exists():
            n, scan, mz, y = self.open.get()
            out = self._judged(key, [(scan, mz, y)], n)
        self.open.clear()
        self.held.clear()
        yield pd.DataFrame(out, columns=_NAMES)


def correlated_pairs(points: DataFrame, top: int = 1000, history: int = 10, least: float = 1e3, correlation: float = 0.9, ppm: float = 1.0, time_col: str | None = None, idle: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """Pairs of each scan of a stream of points (sample_id, scan_id, mz, intensity), scans in order within a sample.

    A sample's state is its last ``history`` scans and the open one, which a later scan closes; points of scans already
    closed are late and left out, as are points with a null. With ``time_col``, a timestamp, a sample of which nothing came for
    ``idle`` by the watermark has its last scan judged and its state dropped; without it the state stays and the last scan open. Spark drops rows at or
    before the watermark, so ``delay`` must be longer than the rows of one scan lie apart.
    """
    _rocksdb(points.sparkSession)
    kept = points.select("sample_id", "scan_id", "mz", "intensity", *[c for c in [time_col] if c]).dropna()
    if time_col:
        kept = kept.withWatermark(time_col, delay)
    state = ScanHistory((top, least, correlation, ppm), history, time_col, int(pd.Timedelta(idle).total_seconds() * 1000))
    return kept.groupBy("sample_id").transformWithStateInPandas(state, PAIRS, "append", "eventTime" if time_col else "none")


class HeldPairs(_Idle):
    """A sample's ``PairCache`` as state: a row for each bin of mz1, of which a batch reads and writes those its pairs reach."""

    _FIELDS = {"number": "long", "mz1": "double", "mz2": "double", "correlation": "double", "first": "long", "last": "long", "hits": "long"}

    def __init__(self, ppm: float, gap: int, every: int, time_col: str, idle: int) -> None:
        super().__init__(time_col, idle)
        self.ppm, self.gap, self.every = ppm, gap, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bins = handle.getMapState("bins", "bin long", ", ".join(f"{k} array<{t}>" for k, t in self._FIELDS.items()))
        self.seen = handle.getValueState("seen", "n long, number long")

    def _store(self, bin_: int, entries: list[list]) -> None:
        if entries:
            self.bins.updateValue((bin_,), tuple(list(c) for c in zip(*entries, strict=True)))
        elif self.bins.containsKey((bin_,)):
            self.bins.removeKey((bin_,))

    def _all(self) -> list[tuple[int, list[list]]]:
        return [(k[0], [list(e) for e in zip(*v, strict=True)]) for k, v in self.bins.iterator()]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _joined(rows)
        before, number = self.seen.get() if self.seen.exists() else (None, 0)
        cache = deltas.PairCache(self.ppm, self.gap)
        cache.count = number
        kept = frame if before is None else frame[frame["n"] >= before]
        homes = {cache.bin(m) for m in kept["mz1"].unique()}
        for b in sorted({b + d for b in homes for d in (-1, 0, 1)}):
            found = self.bins.getValue((b,))
            for entry in zip(*found, strict=True) if found else []:
                cache.put(list(entry))
        for n, mz1, mz2, r in kept.sort_values(["n", "mz1", "mz2", "correlation"])[["n", "mz1", "mz2", "correlation"]].itertuples(index=False):
            cache.add(int(n), mz1, mz2, r)
        for b, of in cache.held.items():
            self._store(b, [e for some in of.values() for e in some])
        out = []
        if len(kept):
            now = int(kept["n"].max())
            if before is None or now // self.every > before // self.every:
                out = self._spilled(now)
            self.seen.update((now, cache.count))
        self.renew(frame)
        yield pd.DataFrame(deltas.cached_rows(key[0], out), columns=_CACHED)

    def _spilled(self, now: int) -> list[list]:
        """Takes out the entries that no scan from ``now`` on can extend."""
        out = []
        for b, entries in self._all():
            gone = [e for e in entries if now - e[5] >= self.gap]
            if gone:
                out += gone
                self._store(b, [e for e in entries if now - e[5] < self.gap])
        return out

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = [e for _, entries in self._all() for e in entries]
        self.bins.clear()
        self.seen.clear()
        yield pd.DataFrame(deltas.cached_rows(key[0], out), columns=_CACHED)


def cached_sessions(pairs: DataFrame, time_col: str, ppm: float = 3.0, gap: int = 5, every: int = 10, idle: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """``operators.deltas.cached_sessions`` of a stream of pairs (sample_id long, n, mz1, mz2, correlation, ``time_col``), scans in order in a sample.

    An entry is given out once no later scan can extend it, looked at every ``every`` scans, or when nothing of its sample came
    for ``idle`` by the watermark; then the sample's state is dropped. Pairs of scans before the last one seen are late and
    left out, as are pairs with a null or an m/z of 0 or less. State is bounded by the pairs of the last ``every`` + ``gap``
    scans; rows at or before the watermark, ``delay`` behind the latest, are dropped. A sample, one run of one instrument, is one key, since each entry depends on those before it.
    """
    _rocksdb(pairs.sparkSession)
    kept = pairs.select("sample_id", "n", "mz1", "mz2", "correlation", time_col).dropna().filter("mz1 > 0 AND mz2 > 0").withWatermark(time_col, delay)
    state = HeldPairs(ppm, gap, every, time_col, int(pd.Timedelta(idle).total_seconds() * 1000))
    return kept.groupBy("sample_id").transformWithStateInPandas(state, f"sample_id long, {deltas.CACHED}", "append", "eventTime")


def sessions(pairs: DataFrame, time_col: str, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Sessions of pairs (sample_id, mz1, mz2) on a stream: hits and bounds, closed when nothing came for ``gap``, late rows up to ``delay``.

    m/z are equal to a thousandth of a Da; ``time_col`` is a timestamp, one second for each scan, say.
    """
    keyed = pairs.withWatermark(time_col, delay).withColumns({"mz1": F.round("mz1", 3), "mz2": F.round("mz2", 3)})
    window = F.session_window(F.col(time_col), gap)
    return keyed.groupBy("sample_id", "mz1", "mz2", window.alias("session")).agg(F.count(F.lit(1)).alias("hits"), F.max("correlation").alias("correlation"))
