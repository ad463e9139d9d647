"""Headlines and token kinds over all texts, accented ones included, against plain versions."""

import re

from lattica.plans import catalog


def test_headline(spark, sf):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r.item_id: r.h for r in catalog.queries()["F_text_headline"](spark, sf).collect()}
    assert got == {i: re.sub(r"(?i)\b(the|of)\b", r"<b>\1</b>", t) for i, t in texts.items()}


def test_parse(spark, sf):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r.item_id: r.n for r in catalog.queries()["F_text_parse"](spark, sf).collect()}
    assert got == {i: sum(w.isascii() for w in re.findall(r"[^\W\d_]+", t)) for i, t in texts.items()}
