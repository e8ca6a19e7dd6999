"""Answers through a log: failures leave questions open, a rerun asks only those."""

import zlib

from complaintlens.operators import prompts


def test_rerun_asks_only_what_is_open(spark, tmp_path):
    # Made here, so that workers get them by value.
    def flaky():
        def answer(text):
            if zlib.crc32(text.encode()) % 3 == 0:
                raise TimeoutError("no answer")
            return text.upper()

        return answer

    def steady():
        return lambda text: text.upper()

    rows = [(i, f"prompt {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "question_id long, prompt string")
    log = str(tmp_path / "log")
    first = {r.question_id: (r.answer, r.attempts) for r in prompts.generate_logged(df, flaky, log).collect()}
    failing = {i for i, text in rows if zlib.crc32(text.encode()) % 3 == 0}
    assert failing and {i for i, (a, _) in first.items() if a is None} == failing
    second = {r.question_id: (r.answer, r.attempts) for r in prompts.generate_logged(df, steady, log).collect()}
    assert {i: a for i, (a, _) in second.items()} == {i: t.upper() for i, t in rows}
    assert {i: n for i, (_, n) in second.items()} == {i: 2 if i in failing else 1 for i, _ in rows}
    stored = spark.read.parquet(log)
    assert stored.count() == 60 + len(failing) and stored.filter("error IS NOT NULL").count() == len(failing)
    # A third run asks nothing.
    prompts.generate_logged(df, flaky, log).count()
    assert spark.read.parquet(log).count() == 60 + len(failing)
