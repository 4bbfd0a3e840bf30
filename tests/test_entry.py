"""The driver's contract: each query against DuckDB on the same files."""

import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata")


def duckdb_rows(sql, sf_dir):
    with duckdb.connect() as con:
        for path in sf_dir.glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        result = con.execute(sql)
        return [c[0] for c in result.description], result.fetchall()


def test_entry_returns_rows(spark):
    result = contract.entry(spark)
    assert result.dtypes == [
        ("l_returnflag", "string"),
        ("l_linestatus", "string"),
        ("sum_qty", "double"),
        ("sum_base_price", "double"),
        ("count_order", "bigint"),
    ]
    assert result.count() > 0


def test_every_oracle_has_a_query():
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_can_do_without_the_training_data_operators(tmp_path):
    """The rest works where their folder and the pipeline are taken out."""
    repo = Path(contract.__file__).parent
    shutil.copytree(repo / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run.stdout.split() == ["shipped_line_summary"] * 2, run.stderr


@pytest.mark.skipif("op1_decontamination" not in contract.queries(), reason="no operators to miss a library")
def test_can_do_without_a_library_of_the_operators():
    code = "import sys; sys.modules['public_tokenizers'] = None\nimport __spark_entry__ as e; print(*e.queries())"
    repo = Path(contract.__file__).parent
    run = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True)
    assert run.stdout.split() == ["shipped_line_summary"] and "public_tokenizers" in run.stderr


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["shipped_line_summary"])
def test_query_equals_oracle(spark, name, sf):
    result = contract.queries()[name](spark, str(DATA / sf))
    columns, expected = duckdb_rows(contract.oracle_sql()[name], DATA / sf)
    assert result.columns == columns
    # Bit for bit, and as multisets, since a key may be null.
    assert Counter(map(tuple, result.collect())) == Counter(expected)
