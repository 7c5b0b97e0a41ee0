"""Every registered query of the library against its SQL, and those without SQL for rows."""

import pytest

from pagemill.plans import catalog
from tests import oracle


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    oracle.check(spark, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, oracle.SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_without_training_operators():
    """The rest must import and work where that subpackage and the pipeline are gone."""
    import subprocess
    import sys

    code = "import sys; sys.modules['pagemill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pii_sets' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
