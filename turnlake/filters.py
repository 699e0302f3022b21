"""The filter that every query over sessions takes: a range of days and a project."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Days are YYYY-MM-DD texts, both inclusive; what is None doesn't restrict."""

    since: str | None = None
    until: str | None = None
    project: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.since:
            df = df.where(F.col("date") >= self.since)
        if self.until:
            df = df.where(F.col("date") <= self.until)
        if self.project:
            df = df.where(F.col("project") == self.project)
        return df

    @classmethod
    def last_days(cls, n: int, today: date | None = None, project: str | None = None) -> Filters:
        """The last ``n`` days, today included."""
        return cls(since=str((today or date.today()) - timedelta(days=n - 1)), project=project)


EVERYTHING = Filters()
