"""How derived files are dealt out."""

import pytest

from tracewell.plans.findings_queries import call_files, returning_files


@pytest.mark.parametrize("files", [call_files, returning_files])
def test_files_are_dealt_out_over_all_cores(spark, sf_dir, files):
    """The table is one split; a core that parses all its files takes as many times as long as there are cores."""
    assert files(spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
