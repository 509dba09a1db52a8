"""A graph of stages over one dictionary of lazy DataFrames, with a log from which it can go on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

State = dict[str, DataFrame]


@dataclass
class Stage:
    """What adds DataFrames to the state; it runs only if `when` holds."""

    name: str
    run: Callable[[State], State]
    when: Callable[[State], bool] = lambda state: True


class Cancelled(Exception):
    pass


@dataclass
class StageGraph:
    """Stages in order.  What each one adds is written below path and read again, so a restart
    recomputes a stage and those after it, and no others, and a lost executor costs one stage."""

    spark: SparkSession
    stages: list[Stage]
    path: str
    log: list[tuple[str, str]] = field(default_factory=list)
    cancelled: bool = False

    def cancel(self) -> None:
        """The next stage won't begin."""
        self.cancelled = True

    def status(self) -> dict[str, str]:
        """The last event of each stage; pending if there is none."""
        return {s.name: "pending" for s in self.stages} | dict(self.log)

    def run(self, state: State, start: str | None = None) -> State:
        """Runs all stages, or from one on with what the earlier ones have written; a failure is logged and raised."""
        names = [s.name for s in self.stages]
        first = names.index(start) if start else 0
        self.cancelled, self.log = False, [x for x in self.log if x[0] in names[:first]]
        before = dict(self.log)
        for k, stage in enumerate(self.stages):
            if k < first:
                if before.get(stage.name) == "completed":
                    state = state | self.stored(stage.name)
                continue
            if self.cancelled:
                self.log.append((stage.name, "cancelled"))
                raise Cancelled(stage.name)
            if not stage.when(state):
                self.log.append((stage.name, "skipped"))
                continue
            try:
                added = stage.run(state)
                for name, df in added.items():
                    df.write.mode("overwrite").parquet(f"{self.path}/{stage.name}/{name}")
                self.spark.createDataFrame([(n,) for n in added], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{stage.name}/names")
            except Exception:
                self.log.append((stage.name, "failed"))
                raise
            self.log.append((stage.name, "completed"))
            state = state | self.stored(stage.name)
        return state

    def stored(self, stage: str) -> State:
        names = [r[0] for r in self.spark.read.schema("name string").parquet(f"{self.path}/{stage}/names").collect()]  # a row for each DataFrame
        return {n: self.spark.read.parquet(f"{self.path}/{stage}/{n}") for n in names}
