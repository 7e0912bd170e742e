"""The number of links of op 1, against all pairs of rows."""

import pytest

from scorelake.llm import near_join as N

from test_near_join import SCHEMA, brute, corpus, shingles


def links(rows, k, num, den):
    sets = [shingles(t, k) if i is not None else set() for i, t in rows]
    near = lambda s, t: bool(s and t) and (c := len(s & t)) * den >= num * (len(s) + len(t) - c)
    return sorted((str(i), sum(near(s, t) for q, t in enumerate(sets) if q != p)) for p, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("tile", [12, 512])
def test_links_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE", tile)
    rows = corpus(5, 2, 110, (80,), (0.0, 0.01, 0.03)) + [(1000 + i, t) for i, t in corpus(3, 20, 6, (1, 2, 8, 25, 27, 150), (0.0, 0.01, 0.03))]
    rows += [(rows[0][0], rows[1][1]), (rows[0][0], rows[0][1]), (None, rows[0][1]), (5000, rows[0][1]), (5001, None)]
    frame = spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA).repartition(4)
    got = N.near_groups(frame, 3, 90, 100).collect()
    want = links(rows, 3, 90, 100)
    assert sorted((str(r.doc_id), r.n_links) for r in got) == want
    assert max(n for _, n in want) > 20
    whole = [r for r in rows if r[0] is not None]
    groups, _ = brute(whole, 3, 90, 100)
    kept = {r.doc_id for r in N.keep_one_of_each(frame, 3, 90, 100).collect()}
    assert kept - {None} == set(groups.values())
