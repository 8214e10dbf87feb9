"""Conversations as a stream: the memory of each is keyed state, three turns at most, which a timer clears."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TURN = "turn long, question string, answer string, law_number string"
KEPT, LONGEST = 3, 700
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def squeezed(text: str | None) -> str:
    """As functions.text.squeeze() has it."""
    out = " ".join(part for part in (text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\f\r"), " ")).split(" ") if part)
    return out


def remembered(turns: list[tuple]) -> str:
    """What earlier turns (turn, question, answer, law_number) say to a later one."""
    lines = [f"Tur {i} | Konu: {question}\nKanun: {'Kanun bilgisi yok' if law is None else law}\nÖnceki cevap özeti: {squeezed(answer)[:LONGEST]}" for i, (_, question, answer, law) in enumerate(turns, 1)]
    return "\n\n".join(lines)


class Memory(StatefulProcessor):
    """Gives each turn of a conversation the last turns before it. A conversation without turns for `idle_ms` is forgotten, if that is given."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.turns = handle, handle.getListState("turns", TURN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.turns.get()] if self.turns.exists() else []
        new = pd.concat(list(rows)).sort_values("turn", kind="stable")
        none = lambda v: None if v is None or v is pd.NA or v != v else v
        out = []
        for turn, question, answer, law in new[["turn", "question", "answer", "law_number"]].itertuples(index=False):
            out.append((key[0], int(turn), remembered(held)))
            held = [*held, (int(turn), none(question), none(answer), none(law))][-KEPT:]
        self.turns.put(held)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "memory"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.turns.clear()
        yield pd.DataFrame({"conv_id": pd.Series([], dtype="int64"), "turn": pd.Series([], dtype="int64"), "memory": pd.Series([], dtype="object")})

    def close(self) -> None:
        pass


def with_memory(turns: DataFrame, idle: int | None = None) -> DataFrame:
    """conv_id, turn, memory for a stream of turns (conv_id, turn, question, answer, law_number): the three turns before, in the order in which batches bring them, within a batch by turn.

    idle: milliseconds after which a conversation's memory is cleared; a stream with it never ends by itself, as timers may come due. A batch's turns of one conversation
    are sorted in one task: bound a source's batches."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keyed state with timers needs it
    columns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "question", "answer", "law_number")
    return columns.groupBy("conv_id").transformWithStateInPandas(Memory(idle), "conv_id long, turn long, memory string", "append", "none" if idle is None else "processingTime")


def remembered_table(spark: SparkSession, turns: DataFrame, path: str) -> DataFrame:
    """Run the stream over what its source has, into a table under path, and read that."""
    done = with_memory(turns).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema("conv_id long, turn long, memory string").parquet(f"{path}/rows")
