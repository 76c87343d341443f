"""The mix shuffles a text once, however its small tables are joined."""

import re
from contextlib import redirect_stdout
from io import StringIO

from tallyframe.llm.mixing import mix_sources


def test_texts_are_shuffled_once(spark):
    rows = [(k % 30, "w " * (k % 9), None if k % 4 == 0 else f"s{k % 3}") for k in range(200)]
    docs = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = StringIO()
        with redirect_stdout(shown):
            mix_sources(docs).explain("formatted")
        found = mix_sources(docs).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\btext#", shown.getvalue())) == 1
    # sources of null included, no row is lost or doubled
    assert len(found) == 201 and sum(r.source is None for r in found) == 51
    sizes = {r.source: r.source_size for r in found}
    assert sizes == {s: sum(r.size for r in found if r.source == s) for s in sizes}
