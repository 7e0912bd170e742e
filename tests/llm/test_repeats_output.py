"""Kept texts and removed spans of op 2, row by row."""

import numpy as np

from scorelake.llm import repeats as R

from test_repeats import SCHEMA, corpus


def outputs(rows):
    first = {}
    for i, t in rows:
        b, k = (t or "").encode(), R.LAST if i is None else i
        for s in range(len(b) - R.SPAN + 1):
            first[b[s: s + R.SPAN]] = min(first.get(b[s: s + R.SPAN], k), k)
    for i, t in rows:
        b, k = (t or "").encode(), R.LAST if i is None else i
        cover = np.zeros(len(b) + 2, np.int8)
        for s in range(len(b) - R.SPAN + 1):
            if first[b[s: s + R.SPAN]] < k:
                cover[s + 1: s + 1 + R.SPAN] = 1
        edges = np.flatnonzero(np.diff(cover)).tolist()
        yield str(i), len(b), bytes(x for x, c in zip(b, cover[1:]) if not c), tuple(zip(edges[::2], edges[1::2]))


def test_kept_texts_and_spans(spark):
    p = "é" * 30 + " a passage of more than fifty bytes"
    rows = corpus(6) + [(9001, p), (9002, "è" + p[1:] + "."), (9001, p), (9003, p), (9003, p), (9004, None), (9004, "short"), (9005, "short"),
                        (None, p), (None, "only here: " + "q" * 70), (None, "only here: " + "q" * 70), (R.LAST, "only here: " + "q" * 70)]
    got = R.without_repeats(spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA).repartition(4)).collect()
    want = sorted(outputs(rows))
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.kept), tuple((x.begin, x.end) for x in r.spans)) for r in got) == want
    assert any(len(w[3]) > 1 for w in want)
