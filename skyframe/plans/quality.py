"""Validation job over staged tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from skyframe.operators import quality as q
from skyframe.params import COUNTED_LABELS, Grid, SplitParams


def validate(staged: DataFrame, manifest: DataFrame, split_table: DataFrame, labels: DataFrame, grid: Grid, image_size: int,
             params: SplitParams = SplitParams(), files: DataFrame | None = None,
             required: Sequence[str] = COUNTED_LABELS) -> DataFrame:
    """All checks as rows (check, passed, detail); contents are reported only when files and schema pass.

    Missing columns and wrong types are seen before any row is read. Shapes, sizes, agreement and contents then come from one pass.
    """
    checks = [] if files is None else [q.check_files(files)]
    problems = q.contract_problems(staged)
    if problems:
        return q.report([*checks, q.fact(staged.sparkSession, "schema", problems)])
    if checks and not q.overall(checks[0]).first()["passed"]:
        return q.report([*checks, q.check_schema(staged, grid, image_size)])
    rows = q.check_rows(staged, manifest, grid, image_size, params)
    if not q.overall(rows["schema"]).first()["passed"]:
        return q.report([*checks, rows["schema"]])
    return q.report([*checks, rows["schema"], q.check_targetids(staged, split_table), rows["split_sizes"], rows["manifest_agreement"],
                     q.check_detections(manifest), rows["content"], q.check_labels(staged, labels, required)])


def require_valid(checks: DataFrame) -> None:
    """Raise with the names of the failed checks."""
    from skyframe.operators.joins import DataError
    verdict = q.overall(checks).first()
    if not verdict["passed"]:
        raise DataError(f"checks failed: {', '.join(verdict['failed'])}")
