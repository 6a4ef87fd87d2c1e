"""Operators on executors that do not have the package: only the driver finds it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from corpuscope.session import get_spark
from corpuscope.llm import byte_bpe, collocations, conversations, pii, suffix_dedup, toxicity
spark = get_spark("far", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
rows = [(i, "en", ("vile scum rot. " if i % 3 == 0 else "a calm day. ") * 9 + f"mail a{{i}}@b.org " + "x" * 60) for i in range(60)]
docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
found = toxicity.toxicity(docs, labels).where("score >= 0").count()
assert found == 60, found
assert byte_bpe.byte_bpe(docs).where("n_tokens > 0").count() == 60
assert pii.find_personal_data(docs).where("size(base) = 1").count() == 60
assert collocations.collocations(docs).count() > 0
assert suffix_dedup.suffix_dedup(docs).where("n_removed > 0").count() == 59
talk = spark.createDataFrame([(1, t, "user", "Hi.") for t in range(4)], "conv_id long, turn long, role string, text string")
assert conversations.conversation_report(talk).head().duplicate == 3
empty = toxicity.toxicity(docs.selectExpr("doc_id", "'' AS text"), labels)
assert empty.where("score = 0").count() == 60
"""


def test_operators_run_where_only_the_driver_has_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
