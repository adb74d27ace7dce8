import os

import pytest

from fathomline.llm import queries as q
from tests.compare import DATA, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", list(q.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, q.queries()[name], q.oracle_sql()[name]) == ([], [])


@pytest.mark.parametrize("name", [n for n in q.queries() if n not in q.oracle_sql()])
def test_runs(spark, name):
    assert q.queries()[name](spark, DATA).count() > 0 or name == "p9_matches"  # no leak among so few documents


def test_syntax_verdicts_agree_with_the_index(spark):
    """Files that do not parse have no chunks."""
    from fathomline.functions.current import current_rows

    bad = {r[0] for r in q.p5_found(spark, DATA).collect()}
    files = {r[0] for r in current_rows(spark.read.parquet(f"{DATA}/source_files.parquet"), ["file_path"], "modified_at", {}).collect()}
    chunked = {r[0] for r in spark.read.parquet(f"{DATA}/chunks.parquet").select("file_path").distinct().collect()}
    assert bad == files - chunked
