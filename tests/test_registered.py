"""Every registered query against its SQL, and the shape of its plan."""

import io
import re
from contextlib import redirect_stdout

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import difference, duck

# The queries of the optional subpackage have tests of their own.
NAMES = sorted(name for name in queries() if not re.match(r"op\d+_|pipeline$", name))
CHECKED = sorted(set(oracle_sql()) & set(NAMES))


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    built = {}

    def get(name):
        if name not in built:
            built[name] = queries()[name](spark, sf_dir)
        return built[name]

    return get


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(name, frames, connection):
    assert difference(frames(name), connection, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(NAMES) - set(CHECKED)))
def test_gives_rows(name, frames):
    assert not frames(name).isEmpty()


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_pairing_of_everything(name, frames):
    text = io.StringIO()
    with redirect_stdout(text):
        frames(name).explain()
    plan = text.getvalue()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan, "row-at-a-time Python"
    # A window without partitioning may only add up the offsets of few groups:
    # task partitions, blocks of lengths, hash prefixes.
    for line in re.findall(r"Window \[.*\]", plan):
        # Without keys, the functions are followed by the sort order alone.
        keys, order = re.search(r"(\], \[[^\]]*)?\], \[([^\]]*)\]$", line).groups()
        if keys is None and re.search(r" (ASC|DESC) ", order):
            assert re.match(r"(_part|_block|_prefix)#", order), line


def test_entry(spark):
    row = entry(spark).first()
    assert row.questions == 40
    assert 0 < row.recall_at_1 <= row.recall_at_5 <= row.recall_at_10 <= 1


def test_only_sql_free_queries_lack_sql():
    assert set(NAMES) - set(CHECKED) == {
        "bounded_sample", "embed_batches", "ivf_fit", "length_quantiles_approx", "pq_search",
    }
