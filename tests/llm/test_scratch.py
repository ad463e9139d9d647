"""Copies in the shared folder go when nothing needs them any more."""

import os

from lattica.llm import line_templates, simhash
from lattica.llm.common import materialize, scratch, shared_dir


def copies(spark):
    return {f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f.startswith("lattica-")}


def test_scopes(spark):
    shared_dir(spark)
    before = copies(spark)
    with scratch() as outer:
        a = materialize(spark.range(3))
        with scratch() as inner:
            materialize(spark.range(4))
            b = inner.keep(materialize(a.where("id > 0")))
        assert len(copies(spark) - before) == 2 and b.count() == 2
        c = outer.keep(materialize(b.where("id > 1")))
    assert len(copies(spark) - before) == 1 and c.count() == 1


def test_operators_leave_what_their_results_need(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven " + "x" * (i // 9)) for i in range(20)], "doc_id long, text string")
    before = copies(spark)
    made = [simhash.near_duplicates(docs), simhash.near_duplicates(docs, shingle=5, radius=20, verify=True), line_templates.dedup_lines(docs)]
    assert len(copies(spark) - before) <= 6
    assert [m.count() for m in made[:2]] == [20, 20] and made[2].count() >= 1
