"""Connected components: files of a round, and the start from groups that are known."""

import pytest
from test_corpora import docs

from spanfold.llm import common, jaccard
from spanfold.llm.common import Scratch, connected_components


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_a_round_writes_no_file_for_each_shuffle_partition(spark, monkeypatch, most):
    monkeypatch.setattr(common, "LINKS_A_FILE", most, raising=False)
    written = []

    def write(self, df, name="t", to=Scratch.write):
        out = to(self, df, name)
        written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "write", write)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.range(1, 200).selectExpr("id as a", "id - 1 as b").where("a % 50 != 0")
        got = {r.node: r.component for r in connected_components(Scratch(spark), links).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {n: n - n % 50 for n in range(200)}
    assert len(written) > 2 and max(written[1:]) <= max(spark.sparkContext.defaultParallelism, -(-196 // most))


def test_links_found_by_opening_join_groups_that_are_known(spark, monkeypatch):
    given = []

    def components(scratch, links, to=connected_components):
        given.append({(r.a, r.b) for r in links.collect()})
        return to(scratch, links)

    monkeypatch.setattr(jaccard, "connected_components", components)
    monkeypatch.setattr(jaccard, "_star", lambda shared, to=jaccard._star: to(shared).where("false"))  # copies alone are known
    words = [f"v{i}" for i in range(100)]
    text = lambda k: " ".join([*words[:k], "x", *words[k + 1 :]])
    rows = [(i, text(i // 2)) for i in range(20)] + [(100 + i, text(50)) for i in range(30)] + [(200, "a b c d e f")]
    got = {r.doc_id: r.component_id for r in jaccard.components(docs(spark, rows)).collect()}
    assert got == {i: 0 for i, _ in rows[:-1]} | {200: 200}
    assert len(given) == 2
    assert {b for a, b in given[1] if a >= 100 and b >= 100} == {100}  # no link of a copy but to its component
