"""The complete detector run."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, functions as F

from viario.config import DETECTOR_COLUMNS, FOREST
from viario.functions.numbers import flag
from viario.operators.detect.fence import detect_iqr
from viario.operators.detect.forest import detect_forest
from viario.operators.detect.noise import detect_noise
from viario.operators.detect.score import add_score, anomalies_of, summaries
from viario.operators.detect.series import detect_along_series
from viario.operators.sampling import sample_stratified
from viario.sources.files import write_table
from viario.storage import materialise


class AnomalyDetector:
    """Runs all detectors on a master table and delivers the summaries.

    `max_rows` asks for a stratified sample first; 0, the default, looks at every row.
    `row_id` names columns that tell rows of one instant apart, `sizes` sets group_rows and
    block_rows of the windows.
    """

    def __init__(
        self, config: dict, row_id: list[str] | None = None, forest: dict | None = None,
        sizes: dict | None = None,
    ):
        processed = config["paths"].get("processed")
        self.models_path = processed and posixpath.join(str(processed), "models")
        self.anomalies_path = processed and posixpath.join(str(processed), "anomalies")
        self.row_id, self.forest, self.sizes = row_id, forest or FOREST, sizes

    def detect(self, df: DataFrame, max_rows: int = 0) -> DataFrame:
        """The table with the nine result columns."""
        rows = sample_stratified(df, max_rows, row_id=self.row_id)
        rows = materialise(rows, "sample") if max_rows > 0 else rows
        if "corredor" in df.columns:
            rows = detect_along_series(rows, row_id=self.row_id, sizes=self.sizes)
        else:
            rows = rows.withColumns({
                "z_score_anomaly": F.lit(False), "speed_drop_anomaly": F.lit(False),
                "speed_drop_pct": F.lit(None).cast("double"),
            })
        rows = materialise(detect_iqr(materialise(rows, "series")), "detectors")
        scored = detect_forest(rows, self.models_path, self.forest, self.row_id)
        return add_score(detect_noise(scored, places=rows))

    def run(self, df: DataFrame, max_rows: int = 0) -> dict:
        flagged = materialise(self.detect(df, max_rows), "flagged")
        if self.anomalies_path:
            write_table(anomalies_of(flagged), self.anomalies_path)
        return {**summaries(flagged), "flagged": flagged, "models_path": self.models_path}


def detector_breakdown(anomalies: DataFrame) -> DataFrame:
    """Rows and share per detector, one row each."""
    present = {n: c for n, c in DETECTOR_COLUMNS.items() if c in anomalies.columns}
    counts = anomalies.agg(
        F.count(F.lit(1)).alias("__all"),
        *[F.count_if(flag(anomalies, c)).alias(c) for c in present.values()],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("detector"), F.col(c).alias("n")) for n, c in present.items()])
    return counts.select("__all", F.inline(rows)).select(
        "detector", "n",
        (F.lit(100.0) * F.col("n") / F.greatest(F.col("__all"), F.lit(1))).alias("pct"),
    )
