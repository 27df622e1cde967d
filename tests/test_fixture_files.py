"""The files of the fixture's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from struklake.plans import fixtures


def test_even_files_without_a_shuffle(spark, sf_dir, monkeypatch):
    """Files hold so many lines at most, whatever the number of cores, and all lines are there."""
    monkeypatch.setattr(fixtures, "FILE_LINES", 1000)
    monkeypatch.setattr(fixtures, "_built", {})
    lines = fixtures.lines(spark, sf_dir)
    sizes = [r["count"] for r in lines.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == fixtures.build_lines(spark, sf_dir).count()
