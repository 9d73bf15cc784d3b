"""A pipeline of named steps over tables: steps grouped by level, hooks after each, states that say where to go on."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[DataFrame], DataFrame]
#: Level of the steps whose names hold a part, particular ones first.
LEVELS = (("longitudinal_registration", "patient"), ("registration", "study"), ("cubic_padding", "study"), ("skull_stripping", "study"), ("", "modality"))


def level_of(name: str) -> str:
    return next(level for part, level in LEVELS if part in name)


def grouped(names: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Runs of steps of one level, in order."""
    return [(level, list(run)) for level, run in groupby(names, level_of)]


@dataclass
class Registry:
    """Steps by a part of their name; the longest part that a name holds decides."""

    steps: dict[str, Step] = field(default_factory=dict)

    def register(self, part: str, step: Step) -> None:
        self.steps[part] = step

    def of(self, name: str) -> Step:
        found = [p for p in self.steps if p in name]
        if not found:
            raise KeyError(f"no step for {name}")
        return self.steps[max(found, key=len)]


@dataclass
class Runner:
    """Runs steps in order. With a folder, each step's table is written there and a step that is there already is not run again."""

    registry: Registry
    folder: str | None = None
    hooks: list[Callable[[str, DataFrame], None]] = field(default_factory=list)

    def done(self, spark: SparkSession, name: str) -> DataFrame | None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return spark.read.parquet(f"{self.folder}/{name}") if there else None

    def run(self, df: DataFrame, names: Sequence[str], dry: bool = False) -> DataFrame:
        for number, name in enumerate(names, 1):
            at = f"step{number}_{name}"
            if self.folder and not dry and (known := self.done(df.sparkSession, at)) is not None:
                df = known
                continue
            df = self.registry.of(name)(df)
            if self.folder and not dry:
                df.write.mode("overwrite").parquet(f"{self.folder}/{at}")
                df = df.sparkSession.read.parquet(f"{self.folder}/{at}")
            for hook in () if dry else self.hooks:
                hook(name, df)
        return df
