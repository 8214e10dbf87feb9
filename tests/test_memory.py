import random

import pandas as pd
from pyspark.sql import functions as F

from lodestone.operators.answers import follow_ups
from lodestone.streaming import memory

TURNS = "conv_id long, turn long, question string, answer string, law_number string"


def test_stream_remembers_what_the_window_does(spark, tmp_path):
    rng = random.Random(1)
    say = lambda: rng.choice([None, "", " a \t b\x0bc ", "x" * 900, "vergi\n\nborcu  ne", "İş 日本"])
    rows = [(c, t, say() or "?", say(), rng.choice([None, "213", "unknown"])) for c in range(12) for t in range(rng.randint(1, 9))]
    for part in (0, 1):  # later turns come in a later file
        spark.createDataFrame([r for r in rows if (r[1] > 3) == bool(part)], TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["conv_id"], r["turn"]): r["memory"] for r in memory.remembered_table(spark, stream, str(tmp_path / "out")).collect()}
    want = follow_ups(spark.createDataFrame(rows, TURNS)).select("conv_id", "turn", F.coalesce("memory", F.lit("")).alias("memory"))
    assert got == {(r["conv_id"], r["turn"]): r["memory"] for r in want.collect()}


class Held:
    """State and timers of one key."""

    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1000


def test_idle_conversations_are_forgotten():
    held, keeper = Held(), memory.Memory(500)
    keeper.init(held)
    turn = lambda n: iter([pd.DataFrame([(n, f"q{n}", "a", "1")], columns=["turn", "question", "answer", "law_number"])])
    said = [next(keeper.handleInputRows((7,), turn(n), held)) for n in range(6)]
    assert said[0]["memory"][0] == "" and said[5]["memory"][0].count("Tur ") == 3 and "q2" in said[5]["memory"][0]
    assert held.timers == [1500]
    assert len(next(keeper.handleExpiredTimer((7,), held, None))) == 0
    assert next(keeper.handleInputRows((7,), turn(9), held))["memory"][0] == ""
