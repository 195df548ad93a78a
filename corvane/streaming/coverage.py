"""A completeness gate on a stream of answers: one verdict for each pack, as soon as it can be given.

Every pack's expected pids and time limit are its initial state. A pack is complete when its last expected pid has come, and
timed out when the watermark passes its limit first; it is told once, either way. Answers after the limit are late, a pid's
second answer is double, and a pid that is not expected is stray: none of them counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corvane.sources.stores import shared_folder

VERDICT = "pack string, complete boolean, expected long, got long, missing long, double long, stray long, late long"
#: The state store that keeps timers and several states of a key (fixed value).
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that packs are dealt to by hash; a group's packs share their states. A checkpoint holds this number (fixed value).
GROUPS = 4096
#: Expected pids that lie in one entry of a state, about; and answers that are gathered before entries are changed.
CHUNK = 1024
GATHERED = 1 << 18


class CoverageGate(StatefulProcessor):
    """States of a group of packs: `wanted` (chunk: the tokens of pids that are still to come, and of those that have) and `packs`.

    `packs` has the limit in milliseconds and the counts of each pack, and the time of the group's one timer: the least limit
    of a pack that is not told. A call to a state costs far more than a look into a list, so calls are made per group and chunk.
    """

    COUNTS = ["expected", "got", "double", "stray", "late"]
    FIELDS = ["limit", "told", *COUNTS]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        tokens, numbers = ArrayType(StringType()), ArrayType(LongType())
        self.wanted = handle.getMapState("wanted", StructType([StructField("chunk", LongType())]), StructType([StructField("left", tokens), StructField("come", tokens)]))
        self.packs = handle.getValueState("packs", StructType([StructField("timer", LongType()), StructField("chunks", LongType()), StructField("pack", tokens), *[StructField(f, numbers) for f in self.FIELDS]]))

    def _load(self) -> tuple[int | None, int, dict[str, list]] | None:
        state = self.packs.get()
        if state is None:
            return None
        timer, chunks, packs, *columns = state
        return timer, chunks, {p: list(f) for p, *f in zip(packs, *columns)}

    def _store(self, timer: int | None, chunks: int, packs: dict[str, list]) -> None:
        """Keep the packs, and a timer at the least limit that is still open."""
        open_ = [f[0] for f in packs.values() if not f[1]]
        due = min(open_) if open_ else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.wanted.clear()
        self.packs.update((due, chunks, list(packs), *[list(c) for c in zip(*packs.values())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        timer, chunks, packs = self._load() or (None, int(initialState["chunks"].iloc[0]), {})
        for chunk, names, limits, tokens in zip(initialState["chunk"], initialState["packs"], initialState["limits"], initialState["tokens"]):
            self.wanted.updateValue((int(chunk),), (list(tokens), []))
            for pack, limit in zip(names, limits):
                packs.setdefault(pack, [int(limit), 0, 0, 0, 0, 0, 0])[2] += 1
        self._store(timer, chunks, packs)

    def _told(self, packs: dict[str, list], names: list[str]) -> Iterator[pd.DataFrame]:
        rows = []
        for pack in names:
            packs[pack][1] = 1
            _, _, expected, got, double, stray, late = packs[pack]
            rows.append([pack, got == expected, expected, got, expected - got, double, stray, late])
        if rows:
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in VERDICT.split(", ")])

    def _take(self, gathered: dict[int, list], packs: dict[str, list]) -> None:
        """Count gathered answers, chunk by chunk."""
        for chunk, answers in gathered.items():
            left, come = (set(x) for x in self.wanted.getValue((chunk,)) or ([], []))
            before = len(come)
            for pack, token in answers:
                if token in left:
                    left.remove(token)
                    come.add(token)
                    packs[pack][3] += 1
                else:
                    packs[pack][4 if token in come else 5] += 1
            if len(come) > before:
                self.wanted.updateValue((chunk,), (list(left), list(come)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        if state is None:  # packs that nobody expects
            for _ in rows:
                pass
            return
        timer, chunks, packs = state
        gathered, size, met = {}, 0, set()
        for frame in rows:
            for pack, token, at, mark in zip(frame["pack"], frame["token"], frame["at"], frame["mark"]):
                own = packs.get(pack)
                if own is None or own[1]:
                    continue
                met.add(pack)
                if at > own[0]:
                    own[6] += 1
                else:
                    gathered.setdefault(int(mark) % chunks, []).append((pack, token))
                    size += 1
            if size >= GATHERED:
                self._take(gathered, packs)
                gathered, size = {}, 0
        self._take(gathered, packs)
        yield from self._told(packs, [p for p in met if packs[p][2] == packs[p][3]])
        if met:
            self._store(timer, chunks, packs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All packs whose limit the watermark has passed; a timer that is set anew lies beyond it."""
        timer, chunks, packs = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        yield from self._told(packs, [p for p, f in packs.items() if not f[1] and (f[0] < now or f[0] <= expiredTimerInfo.getExpiryTimeInMs())])
        self._store(timer, chunks, packs)

    def close(self) -> None:
        pass


def coverage_verdicts(answers: DataFrame, expected: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A streaming frame of verdicts from answers (pack, pid, ts) and expected (pack, pid, limit: a timestamp of the pack)."""
    answers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    pack, pid = F.col("pack").cast("string"), F.col("pid").cast("string")
    token = F.concat_ws("|", F.length(pack), pack, pid)
    group = F.coalesce(F.crc32(pack.cast("binary")), F.lit(0).cast("long")) % GROUPS
    named = [group.alias("group"), pack.alias("pack"), token.alias("token"), F.crc32(token.cast("binary")).alias("mark")]
    came = answers.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(*named, F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "ts")
    once = expected.select(*named, F.unix_millis(F.col("limit").cast("timestamp")).alias("limit")).repartition("group").groupBy("group", "pack", "token", "mark").agg(F.min("limit").alias("limit"))
    sized = once.withColumns({"limit": F.min("limit").over(Window.partitionBy("group", "pack")), "chunks": F.ceil(F.count("*").over(Window.partitionBy("group")) / CHUNK)})
    listed = sized.groupBy("group", "chunks", (F.col("mark") % F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct("pack", "limit", "token")).alias("x"))
    start = listed.select("group", "chunks", "chunk", F.col("x.pack").alias("packs"), F.col("x.limit").alias("limits"), F.col("x.token").alias("tokens"))
    return came.groupBy("group").transformWithStateInPandas(CoverageGate(), VERDICT, "Append", "EventTime", initialState=start.groupBy("group"))


def run_gate(spark: SparkSession, answers: DataFrame, expected: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """All verdicts once the stream has been read to its present end; with the same `out` and `checkpoint` a later call goes on."""
    out, checkpoint = out or shared_folder(spark), checkpoint or shared_folder(spark)
    query = coverage_verdicts(answers, expected).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(VERDICT).parquet(out)
