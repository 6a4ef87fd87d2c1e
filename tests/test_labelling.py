"""The labelling job: nothing is labelled twice, whatever is run again."""

import os

import pytest

from comparing import compare, connect
from corpuscope.plans import relevance
from corpuscope.plans import model_queries  # noqa: F401  registers the query
from corpuscope.plans.registry import ORACLES, QUERIES

SAMPLE = "video_id string, title string, description string, transcript string, extra int"


def videos(spark, numbers):
    return spark.createDataFrame([(f"v{i}", f"title {i}", None, f"number {i}", 1) for i in numbers], SAMPLE)


def counting(folder, fails=False):
    """A labeller that notes how many prompts it saw in files; numbers that end in 3 get no label."""
    def scorer(prompts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(str(len(prompts)))
        if fails:
            raise RuntimeError("labeller is down")
        number = prompts.str.extract(r"number (\d+)", expand=False)
        return number.str[-1].map(lambda d: "none" if d == "3" else str(int(d) % 2))

    return scorer


def seen(folder):
    return sum(int(open(os.path.join(folder, f)).read()) for f in os.listdir(folder))


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def test_second_run_labels_nothing_and_new_rows_alone(spark, tmp_path, calls):
    job = relevance.LabellingJob(spark, str(tmp_path / "job"), rows_per_file=7, files_per_batch=2)
    assert job.labels().count() == 0 and job.rejects().count() == 0
    for _ in range(2):
        job.enqueue(videos(spark, range(40)))
        job.run(counting(calls))
    assert seen(calls) == 40
    nameless = spark.createDataFrame([(None, "no id", None, "number 7", 1)], SAMPLE)
    job.enqueue(videos(spark, [*range(30, 50), 45]).unionByName(nameless))
    job.run(counting(calls))
    assert seen(calls) == 50
    labels = {r.video_id: r.gpt_label for r in job.labels().collect()}
    assert labels == {f"v{i}": i % 2 for i in range(50) if i % 10 != 3} and job.labels().count() == 45
    assert sorted(r.video_id for r in job.rejects().collect()) == ["v13", "v23", "v3", "v33", "v43"]


def test_goes_on_after_a_failure_and_a_lost_checkpoint(spark, tmp_path, calls):
    root = str(tmp_path / "job")
    job = relevance.LabellingJob(spark, root, rows_per_file=10, files_per_batch=1)
    job.enqueue(videos(spark, range(20)))
    with pytest.raises(Exception, match="labeller is down"):
        job.run(counting(calls, fails=True))
    assert job.labels().count() == 0
    before = seen(calls)
    job.run(counting(calls), done=videos(spark, [4]))
    assert seen(calls) - before == 19 and job.labels().count() == 17 and job.rejects().count() == 2
    os.rename(f"{root}/checkpoint", str(tmp_path / "lost"))
    again = relevance.LabellingJob(spark, root)
    again.run(counting(calls), done=videos(spark, [4]))
    assert seen(calls) - before == 19 and again.labels().count() == 17


def test_one_shot_labels_keep_earlier_ones(spark, calls):
    earlier = spark.createDataFrame([("v2", 9)], "video_id string, gpt_label int")
    found = relevance.label_sample(videos(spark, range(5)), earlier, counting(calls))
    assert {r.video_id: r.gpt_label for r in found.collect()} == {"v0": 0, "v1": 1, "v2": 9, "v4": 0}


def test_flow_equals_sql(spark, sf_dir):
    assert compare(QUERIES["labelling_flow"](spark, sf_dir), connect(sf_dir), ORACLES["labelling_flow"]) is None
