import os
import shutil
import subprocess
import sys

import pytest

from graphloom.plans import catalogue

from .compare import connection, spark_rows, sql_rows

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf):
    names, rows = spark_rows(catalogue.QUERIES[name](spark, sf))
    if name in catalogue.ORACLE_SQL:
        want_names, want = sql_rows(connection(sf), catalogue.ORACLE_SQL[name])
        assert names == want_names
        assert rows == want
    else:
        assert rows


def test_entry_works_without_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLE_SQL))], said.stderr


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_partitions_do_not_change_results(spark, sf, tmp_path):
    from graphloom.operators import canonical
    from graphloom.sources import adapters

    nodes = adapters.local_nodes(spark, sf)
    one = spark_rows(canonical.canonical_nodes(nodes.coalesce(1)).drop("aliases", "evidence_refs", "source_ids"))
    many = spark_rows(canonical.canonical_nodes(nodes.repartition(17)).drop("aliases", "evidence_refs", "source_ids"))
    assert one == many
