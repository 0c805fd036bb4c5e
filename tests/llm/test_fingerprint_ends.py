"""The texts at the ends of ranges are never gathered in one task."""

import re

from barloom.llm import fingerprint


def test_no_text_in_the_window_over_all_ranges(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(400)], "doc_id long, text string").repartition(16)
    found = fingerprint.fingerprint_pairs(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[([^\]]*)\]", plan)
    assert windows and not any("head" in w for w in windows)
    got = {r["doc_id"]: r["near_next"] for r in found.collect()}
    assert got == {i: float(i % 2) for i in range(400)}
