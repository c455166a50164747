"""Numbers of links, against all pairs and the SQL."""

import os

import duckdb
import pytest
from test_corpora import docs, near_copies

from spanfold.llm import jaccard

SF = "/root/testdata/sf0.001"


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    counts = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                counts[a] += 1
                counts[b] += 1
    return sorted((-1 if i is None else i, len(sets[k]), counts[k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [3, 1024])
def test_links_inside_groups_are_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    base = [f"v{i}" for i in range(200)]
    close = [(10_000 + k, " ".join([*base[:k], "x", *base[k + 1 :]])) for k in range(0, 200, 10)]  # one group, all pairs link
    rows = near_copies(5, 150) + close + close[:3] + [(20_000, close[0][1]), (None, close[0][1]), (1, None), (2, ""), (6, "a"), (6, "a"), (6, close[1][1])]
    got = jaccard.linked(docs(spark, rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.n_links) for r in got.collect()) == brute_links(rows)


def test_no_texts_have_no_links(spark):
    assert jaccard.linked(docs(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_links_against_sql(spark):
    got = jaccard.op4_token_group_jaccard_links(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(jaccard.OP4_LINKS_SQL)
    assert got.columns == [c[0] for c in found.description]
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())
