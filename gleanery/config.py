"""Settings of the command line: a session's configuration and search defaults, from the environment where it has them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    master: str | None = field(default_factory=lambda: os.environ.get("GLEANERY_MASTER"))
    max_top_k: int = 50
    default_top_k: int = 5
    spark: dict[str, str] = field(default_factory=lambda: {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"})

    def session(self) -> SparkSession:
        b = SparkSession.builder.appName("gleanery").config(map=self.spark)
        return (b.master(self.master) if self.master else b).getOrCreate()
