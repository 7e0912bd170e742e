"""Language filters and the discriminant against plain versions by definition."""
import math
import random
from collections import Counter

import numpy as np

from scorelake.llm import language as L
from scorelake.llm import quality as Q

MASK = (1 << 64) - 1


def plain_grams(text):
    raw = (text or "").encode()
    out = bytearray(b" ")
    for i, b in enumerate(raw):
        if 65 <= b <= 90:
            b += 32
        elif i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            b += 32
        elif not (97 <= b <= 122 or b >= 128):
            b = 32
        out.append(b)
    out += b" "
    return [int.from_bytes(out[i: i + 4], "little") for i in range(len(out) - 3) if 32 not in out[i + 1: i + 3]]


def places(gram, slots):
    x = gram
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    x ^= x >> 31
    step = x >> 32 | 1
    return [(x + i * step & MASK) % slots for i in range(L.HASHES)]


def plain_language(rows):
    """(languages, evidence of a text) from counts, shares and plain filters."""
    counts = {}
    for text, lang in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    counts = {k: c for k, c in counts.items() if c}
    total = {k: sum(c.values()) for k, c in counts.items()}
    langs = sorted(total, key=lambda k: (-total[k], k))
    share = lambda k, g: counts[k][g] / total[k]
    member = {k: {g for g in counts[k] if share(k, g) >= L.FLOOR and share(k, g) >= L.SHARE * max(share(o, g) for o in langs)} for k in langs}
    slots = 1 << max(10, math.ceil(math.log2(L.SLOTS_PER_GRAM * max(map(len, member.values())))))
    filters = {k: {p for g in member[k] for p in places(g, slots)} for k in langs}
    false = {k: (len(filters[k]) / slots) ** L.HASHES for k in langs}

    def evidence(text):
        g = plain_grams(text)
        hits = {k: sum(all(p in filters[k] for p in places(x, slots)) for x in g) for k in langs}
        return [max(hits[k] - len(g) * false[k], 0) / (1 - false[k]) for k in langs]

    return langs, evidence


def test_language_filters_against_plain_ones(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "Thing", "of ", "and"], "es": ["año", "ÑANDÚ", "que", "ción"], "xx": ["zz9zz", "ква", "-q-", "the"], None: ["none"]}
    rows = [("".join(rng.choice(parts[k]) + rng.choice([" ", "", ", "]) for _ in range(rng.randint(0, 25))), k) for k in parts for _ in range(60)]
    rows += [(None, "en"), ("", "es"), ("123", "xx")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    langs, evidence = plain_language(rows)
    model = L.fit(frame)
    assert model.langs == langs
    asked = [t for t, _ in rows[::3]] + ["x", "abcd", None, "É" * 30, "other letters entirely"]
    raw = [(t or "").encode() for t in asked]
    got = model.evidence(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    for t, row in zip(asked, got):
        assert np.allclose(row, evidence(t), atol=1e-9), t
    found = {r.doc_id: r for r in L.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(asked):
        e = evidence(t)
        if not any(c.isalpha() for c in t or ""):
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
        elif sum(e) > 0:
            assert found[i].lang_pred == langs[int(np.argmax(e))] and abs(found[i].score - max(e) / sum(e)) < 1e-9
        else:
            assert found[i].lang_pred == langs[0]


def test_discriminant_against_its_definition(spark):
    rng = random.Random(3)
    good, bad = ["plain", "words", "follow", "each", "other.", "The", "end,"], ["BUY", "$$$", "|", "now!!!", "9", "x|x"]
    texts = [" ".join(rng.choice(good if i % 3 else bad + good[:2]) for _ in range(rng.randint(5, 60))) for i in range(240)]
    labels = [(i, int(bool(i % 3))) for i in range(0, 240, 2)] + [(900, 1), (3, None)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = Q.fit(Q.text_statistics(docs), spark.createDataFrame(labels, "doc_id long, quality int"))

    def stats(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return Q.statistics(raw, np.array([0, len(raw)]))[0]

    x = np.array([stats(t) for t in texts])
    y = {i: q for i, q in labels if i < 240 and q is not None}
    own = {c: x[[i for i in y if y[i] == c]] for c in (0, 1)}
    mean = {c: own[c].mean(0) for c in own}
    cov = {c: sum(np.outer(v - mean[c], v - mean[c]) for v in own[c]) / len(own[c]) for c in own}
    pooled = sum(len(own[c]) * cov[c] for c in own) / sum(map(len, own.values()))

    def density(v, c):
        s = (1 - Q.POOLED - Q.DIAGONAL) * cov[c] + Q.POOLED * pooled + Q.DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(v))
        d = v - mean[c]
        return -0.5 * (d @ np.linalg.solve(s, d) + np.linalg.slogdet(s)[1])

    prior = len(own[1]) / (len(own[0]) + len(own[1]))
    want = [1 / (1 + math.exp(-max(-700, min(700, density(v, 1) - density(v, 0) + math.log(prior / (1 - prior)))))) for v in x]
    assert np.allclose(model.score(x), want, atol=1e-6)
