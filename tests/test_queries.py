"""Every registered query of the library that has SQL, held against DuckDB at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import compare  # noqa: E402
from corvane.registry import oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(oracle_sql())


@pytest.mark.skipif(not Path(SF).exists(), reason="fixture tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, queries()[name], oracle_sql()[name]).startswith("equal")


def test_registered_without_the_llm_subpackage():
    assert not any(n.startswith("op") or n == "pipeline" for n in queries())
    assert set(NAMES) <= set(queries()) and len(queries()) > 180
