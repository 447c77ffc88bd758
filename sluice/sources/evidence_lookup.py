"""Evidence kept for questions about single reports.

A classified corpus leaves window evidence for every report; a reviewer asks
about a few of them. Texts and evidence are stored in the same number of buckets
by report id, so a question opens at most one bucket of each table for an id,
joins them in place and moves nothing, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.windows import explain
from sluice.params import CascadeParams
from sluice.sources.reports import save_bucketed

MOST_IDS = 10_000


@dataclass(frozen=True)
class EvidenceTables:
    """Two catalog tables of one classified corpus."""

    spark: SparkSession
    name: str

    @property
    def texts(self) -> DataFrame:
        return self.spark.table(f"{self.name}_texts")

    @property
    def evidence(self) -> DataFrame:
        return self.spark.table(f"{self.name}_evidence")

    def of(self, ids: Sequence, params: CascadeParams) -> DataFrame:
        """report_id, chunk_evidence of the given reports, as explain() tells
        it. Ids that are not stored, and nulls, have no row; an id given twice
        has one. At most MOST_IDS ids: for more, read the tables and join."""
        wanted = sorted({i for i in ids if i is not None})
        if len(wanted) > MOST_IDS:
            raise ValueError(f"more than {MOST_IDS} ids: use explain() on joined tables")
        asked = F.col("report_id").isin(wanted)
        return explain(self.texts.filter(asked), self.evidence.filter(asked), params)


def save_evidence(
    reports: DataFrame, evidence: DataFrame, name: str, buckets: int, path: str | None = None
) -> EvidenceTables:
    """Store report_id, text and the window evidence of classify() or
    run_stages() under `name`. A report id occurs once among the reports; of
    rows that repeat one, one is kept. Choose buckets of about a gigabyte of
    text. A second call under the same name replaces the tables."""
    for part, df, then in (
        ("texts", reports.select("report_id", "text").dropDuplicates(["report_id"]), []),
        ("evidence", evidence.select("report_id", "chunk_index", "top_label", "score"), ["chunk_index"]),
    ):
        own = None if path is None else f"{path}/{part}"
        save_bucketed(df, f"{name}_{part}", "report_id", buckets, then, own)
    return EvidenceTables(reports.sparkSession, name)
