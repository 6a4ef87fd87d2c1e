import os
import subprocess
import sys

import pytest

from comparing import compare, connect
from corpuscope.llm.registered import LLM_ORACLES, LLM_QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_smallest_tables_match_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert compare(LLM_QUERIES[name](spark, folder), connect(folder), LLM_ORACLES[name]) is None


def test_all_numbered_and_the_pipeline_are_registered():
    numbers = {name.split("_")[0] for name in LLM_QUERIES} - {"pipeline"}
    assert numbers == {f"op{n}" for n in range(1, 14)} and "pipeline" in LLM_QUERIES


def test_entry_points_import_without_this_package(tmp_path):
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", "corpuscope"):
            (tmp_path / name).symlink_to(os.path.join(ROOT, name))
    (tmp_path / "corpuscope").mkdir()
    for name in os.listdir(f"{ROOT}/corpuscope"):
        if name != "llm":
            (tmp_path / "corpuscope" / name).symlink_to(f"{ROOT}/corpuscope/{name}")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import importlib.machinery as m;" \
           f" exec(open({str(tmp_path / '__spark_entry__.py')!r}).read().replace('os.path.abspath(__file__)', repr({str(tmp_path / 'x')!r})));" \
           " assert queries() and not any(n.startswith('op') and n[2].isdigit() for n in queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
