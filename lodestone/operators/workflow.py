"""The document workflow as set operations: all documents of a stage go together, decisions are expressions over status and attempts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stages in their order (fixed values).
STAGES = ("ocr", "classification", "extraction", "validation", "rag", "summary", "routing", "writing")
MAX_ATTEMPTS = 12


@dataclass(frozen=True)
class Policy:
    """How often a stage is tried again, and what follows when that does not help: terminate, skip, or another stage."""

    stage: str
    retries: int = 1
    fallback: str = "skip"
    fallback_stage: str | None = None
    optional: bool = False
    timeout_seconds: int = 60


POLICIES = {s: Policy(s) for s in STAGES} | {"ocr": Policy("ocr", fallback="terminate", timeout_seconds=240), "rag": Policy("rag", timeout_seconds=120)}


def following(stage: str) -> str | None:
    i = STAGES.index(stage) + 1
    return STAGES[i] if i < len(STAGES) else None


def before(stage: str, available: bool, policies: dict[str, Policy] = POLICIES) -> tuple[str, str | None]:
    """(action, next stage) for a stage that is about to run."""
    if available:
        return "continue", stage
    p = policies[stage]
    return ("skip", following(stage)) if p.optional or p.fallback == "skip" else ("terminate", None)


def after(stage: Column, status: Column, retries: Column, requires_rag: Column, policies: dict[str, Policy] = POLICIES) -> Column:
    """struct(action, next) after an attempt. retries: how often the stage was tried again already; requires_rag: false after validation skips the passages."""
    out = None
    for s in STAGES:
        p, nxt = policies[s], following(s)
        move = lambda action, to: F.struct(F.lit(action).alias("action"), F.lit(to).cast("string").alias("next"))
        good = move("complete", None) if nxt is None else move("continue", nxt)
        if s == "validation":
            good = F.when(requires_rag == F.lit(False), move("continue", "summary")).otherwise(good)
        bad = move("skip", nxt) if p.fallback == "skip" else move("fallback", p.fallback_stage) if p.fallback == "fallback_stage" and p.fallback_stage else move("terminate", None)
        one = F.when(status == "success", good).when(retries < p.retries, move("retry", s)).otherwise(bad)
        out = F.when(stage == s, one) if out is None else out.when(stage == s, one)
    return out


class Registry:
    """Stages by name; a stage is a function DataFrame -> DataFrame that adds one struct column of its own name."""

    def __init__(self):
        self._stages: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str):
        def add(f):
            if name in self._stages:
                raise ValueError(f"stage {name} is registered already")
            self._stages[name] = f
            return f

        return add

    def get(self, name: str) -> Callable[[DataFrame], DataFrame]:
        if name not in self._stages:
            raise KeyError(f"no stage {name}; there are {', '.join(sorted(self._stages)) or 'none'}")
        return self._stages[name]

    def names(self) -> list[str]:
        return sorted(self._stages)


def run(requests: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], cut: Callable[[DataFrame], DataFrame], policies: dict[str, Policy] = POLICIES, id: str = "workflow_id") -> tuple[DataFrame, DataFrame]:
    """(states, history) of all requests. A stage gets the rows that are due for it and returns id, status and payload (a string);
    it cannot touch what other stages wrote. cut: writes a DataFrame and reads it back (a checkpoint), once a round.

    The driver loops over rounds, never over rows; a round runs every stage once on its rows. There are at most MAX_ATTEMPTS plus the number of stages."""
    state = requests.select(id, *(c for c in requests.columns if c != id)).withColumns({"stage": F.lit(STAGES[0]), "retries": F.lit(0), "outcome": F.lit("running"), "reason": F.lit(None).cast("string"), "payloads": F.create_map().cast("map<string,string>")})
    history = None
    state = cut(state)
    for turn in range(MAX_ATTEMPTS + len(STAGES)):
        due = [r["stage"] for r in state.where("outcome = 'running'").select("stage").distinct().collect()]  # stage names
        if not due:
            break
        done = []
        for s in sorted(due, key=STAGES.index):
            mine = state.where((F.col("outcome") == "running") & (F.col("stage") == s))
            action, nxt = before(s, s in stages, policies)
            if action != "continue":
                skipped = F.lit("running" if nxt else "completed" if action == "skip" else "terminated")
                done.append(mine.withColumns({"status": F.lit("skipped" if action == "skip" else "not_integrated"), "payload": F.lit(None).cast("string"), "stage2": F.lit(nxt or s), "retries2": F.lit(0), "outcome2": skipped, "reason2": F.lit(None if action == "skip" else f"{s} is not available").cast("string")}))
                continue
            got = stages[s](mine).select(id, F.col("status"), F.col("payload").cast("string").alias("payload"))
            rows = mine.join(got, id, "left").withColumn("status", F.coalesce("status", F.lit("failed")))
            rag = F.get_json_object("payload", "$.requires_rag").cast("boolean")
            d = after(F.lit(s), F.col("status"), F.col("retries"), rag, policies)
            rows = rows.withColumn("d", d)
            outcome = F.when(F.col("d.action") == "terminate", "terminated").when((F.col("d.action") == "complete") | F.col("d.next").isNull(), "completed").otherwise("running")
            done.append(rows.withColumns({"stage2": F.coalesce("d.next", F.lit(s)), "retries2": F.when(F.col("d.action") == "retry", F.col("retries") + 1).otherwise(0), "outcome2": outcome, "reason2": F.when(F.col("d.action") == "terminate", F.lit(f"{s} failed after retries"))}).drop("d"))
        moved = done[0]
        for x in done[1:]:
            moved = moved.unionByName(x)
        moved = cut(moved)
        log = moved.select(id, F.lit(turn).alias("round"), "stage", (F.col("retries") + 1).alias("attempt"), "status", "payload")
        history = log if history is None else history.unionByName(log)
        kept = F.map_filter("payloads", lambda k, v: k != F.col("stage"))
        moved = moved.withColumn("payloads", F.when(F.col("payload").isNotNull(), F.map_concat(kept, F.create_map("stage", "payload"))).otherwise(F.col("payloads")))
        moved = moved.drop("status", "payload", "stage", "retries", "outcome", "reason").withColumnsRenamed({"stage2": "stage", "retries2": "retries", "outcome2": "outcome", "reason2": "reason"})
        state = cut(state.where("outcome <> 'running'").unionByName(moved))
    late = F.when(F.col("outcome") == "running", "terminated").otherwise(F.col("outcome"))
    state = state.withColumns({"reason": F.when(F.col("outcome") == "running", "too many attempts").otherwise(F.col("reason")), "outcome": late})
    if history is None:
        history = requests.select(id, F.lit(0).alias("round"), F.lit("").alias("stage"), F.lit(0).alias("attempt"), F.lit("").alias("status"), F.lit(None).cast("string").alias("payload")).limit(0)
    return state, history


def collapsed(state: DataFrame, id: str = "workflow_id") -> DataFrame:
    """id and one column for each stage's payload."""
    return state.select(id, "outcome", *(F.col("payloads")[s].alias(s) for s in STAGES))
