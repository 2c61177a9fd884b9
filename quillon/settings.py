"""Settings of the flows, as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Folders and the defaults of the named flows."""

    data_folder: str = "data"
    result_folder: str = "results"
    start: str = "2024-01-12"
    end: str = "2025-05-23"
    seed: int = 42
    base_paths: int = 1_000
    base_steps: int = 343
    scenario_steps: int = 252
    regime_paths: int = 5_000
    train_ratio: float = 0.8
    anchor: float = 10_000.0
    bootstrap_replicates: int = 1_000
    top_values: int = 10

    def path(self, *parts: str) -> str:
        return "/".join([self.result_folder, *parts])

    def source(self, *parts: str) -> str:
        return "/".join([self.data_folder, *parts])

    def ensure_directories(self, spark, names: tuple[str, ...] = ("eda", "eda_train", "variables", "simulator", "scenario")) -> list[str]:
        """Result folders in the file system that their address names, made where they are not there."""
        made = [self.path(name) for name in names]
        for folder in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
        return made
