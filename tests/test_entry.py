import ast
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

COLUMNS = {
    "p1_found": {"trade_arrival", "quote_id"}, "p2_found": {"source_table", "symbol"}, "p3_found": {"first_arrival", "arrival"},
    "p4_found": {"session_id", "venue", "symbol", "side", "price_e4", "size_e4"}, "p5_found": {"venue", "symbol", "window_start_us"},
    "p6_found": {"source_table", "record_id", "field_name"}, "p7_found": {"file_id"},
}
DATA = "/root/testdata/sf0.001"


def test_columns_of_the_found_queries(spark):
    import __spark_entry__ as e

    for name, columns in COLUMNS.items():
        assert set(e.queries()[name](spark, DATA).columns) == columns
    assert e.entry(spark).limit(1).count() == 1


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_texts_subpackage():
    for path in (ROOT / "tickforge").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path


def test_entry_works_without_it():
    code = "import sys; sys.modules['tickforge.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p8_ids' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_workers_get_the_package_wherever_the_driver_stands(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["p1_found"](spark, {DATA!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, capture_output=True)
