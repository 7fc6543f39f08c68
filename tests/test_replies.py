"""The store of replies: nothing asked twice, failures kept apart."""

import os
import time

from textlab.operators import replies as R
from textlab.session import list_paths, scratch_path


def recorder(folder, broken=()):
    """A model that notes each call in a file of its own."""
    os.makedirs(folder, exist_ok=True)

    def ask(prompts):
        import uuid
        if any(p in broken for p in prompts):
            raise RuntimeError("no answer")
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(prompts))
        return [f"reply to {p}" for p in prompts]
    return ask


def asked(folder):
    return sorted(p for f in os.listdir(folder) for p in open(f"{folder}/{f}").read().split("\n"))


def test_each_prompt_is_asked_once_over_two_runs(spark, tmp_path):
    store, log = scratch_path(spark, "store"), str(tmp_path / "calls")
    rows = [(i, f"prompt {i % 40}") for i in range(100)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, prompt string")
    assert R.ask_missing(df.where("id < 30"), store, recorder(log), batch=7) == 30
    assert R.ask_missing(df, store, recorder(log), batch=7, round_calls=4) == 10
    assert R.ask_missing(df, store, recorder(log)) == 0
    assert asked(log) == sorted(f"prompt {i}" for i in range(40))
    got = {r["id"]: r["reply"] for r in R.attach_replies(df, store).collect()}
    assert got == {i: p and f"reply to {p}" for i, p in rows}


def test_a_failing_call_loses_nothing(spark, tmp_path):
    store, log = scratch_path(spark, "store"), str(tmp_path / "calls")
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id long, prompt string")
    assert R.ask_missing(df, store, recorder(log, {"p7"}), tasks=2, batch=5) == 20
    got = {r["id"]: r["reply"] for r in R.attach_replies(df, store).collect()}
    assert got == {i: None if i == 7 else f"reply to p{i}" for i in range(20)}
    assert [r["error"] for r in R.failed_prompts(spark, store).collect()] == ["RuntimeError: no answer"]
    assert R.ask_missing(df, store, recorder(log)) == 1 and R.failed_prompts(spark, store).count() == 0
    assert asked(log) == sorted(f"p{i}" for i in range(20))


def test_rounds_that_were_not_finished_do_not_count(spark, tmp_path):
    store = scratch_path(spark, "store")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    R.ask_missing(df, store, lambda ps: [p.upper() for p in ps])
    folder = [p for p in list_paths(spark, store) if "/round-" in p][0]
    os.remove(folder.removeprefix("file:") + "/_SUCCESS")
    assert R.stored_replies(spark, store).count() == 0
    assert R.ask_missing(df, store, lambda ps: [p.upper() for p in ps]) == 2


def test_wrong_number_of_replies_and_the_rate(spark, tmp_path):
    store = scratch_path(spark, "store")
    df = spark.createDataFrame([(i, f"p{i}") for i in range(8)], "id long, prompt string")
    R.ask_missing(df, store, lambda ps: ps[:1], tasks=1, batch=8)  # a batch that answers short is asked one by one
    assert R.stored_replies(spark, store).count() == 8
    begin = time.monotonic()
    R.ask_missing(df.selectExpr("id", "concat(prompt, '!') as prompt"), store, lambda ps: ps, tasks=1, per_second=4, batch=2)
    assert time.monotonic() - begin >= 1.5


def test_empty(spark):
    store = scratch_path(spark, "store")
    df = spark.createDataFrame([], "id long, prompt string")
    assert R.ask_missing(df, store, lambda ps: ps) == 0 and R.attach_replies(df, store).collect() == []
    assert R.failed_prompts(spark, store).collect() == []
