import random
import re
import string

from scorelake.llm import licenses as L

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, label string, votes int, tie int"


def base(text):
    w, places, labels = WORD.findall((text or "").translate(LOW)), [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i: i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(spark, texts):
    got = L.scan(spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.score == 1 or not r.base_labels
    return {r.doc_id: r for r in got}


def test_base_against_brute_force(spark):
    rng = random.Random(11)
    vocab = "cc by CC-BY general General_Public license public all ALL rights reserved lİcense byK é 3 the".split()
    check(spark, [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(300)])


def test_edges(spark):
    got = check(spark, [None, "", "!!!", "cc by", "-CC (by)", "cc by cc by", "cc\nbyé", "General Public License", "general public licence",
                        "x " * 200_000 + "all rights reserved", "cc by"])
    assert got[0].labels == "" and got[0].score == 0
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_templates_survive_an_inserted_word(spark):
    text = "Foo. Licensed under the Apache License, Version 2.0. " + "bar " * 30
    got = check(spark, [text, text.replace("Apache", "well known Apache"), "licensed under the sun", "version 2 0 " * 5, text + text])
    assert [got[i].labels for i in range(5)] == ["apache-2.0", "apache-2.0" if got[1].score >= L.COVER else "", "", "", "apache-2.0"]
    assert got[0].score == 1 and got[2].score < L.COVER
    long = next(k for k in L.TEMPLATES if L.TEMPLATES[k] == "bsd").split()
    broken = " ".join(long[:8] + ["oh"] + long[8:])
    assert check(spark, [broken])[0].labels == "bsd"


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "cc by", "", 0, 0), (None, "none", "", 0, 0), (3, "cc by", "", 0, 0), (3, "cc by", "", 0, 0), (3, "other", "", 0, 0)]
    got = sorted((str(r.doc_id), r.n_base) for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("3", 0), ("3", 1), ("3", 1), ("None", 0), ("None", 1)]


def brute_copies(text, words, k):
    """Plain diagonals, merged and verified: (first, last, score) of all candidates."""
    w = WORD.findall((text or "").translate(LOW))
    at, need, by = {}, len(words) - k + 1, {}
    for i in range(need):
        at.setdefault(tuple(words[i: i + k]), []).append(i)
    for pos in range(len(w) - k + 1):
        for t in at.get(tuple(w[pos: pos + k]), ()):
            by.setdefault(pos - t, set()).add((pos, t))
    out, group, last = [], [], None
    for d in [*sorted(by), None]:
        if d is None or (last is not None and d - last > L.GAP + need // L.GAP_A_WORD):
            if group:
                hits = [h for g in group for h in by[g]]
                first, end = min(p for p, _ in hits), max(p for p, _ in hits) + k - 1
                out.append((first, end, min(len({t for _, t in hits}) / need, 1.0, (len(hits) + k - 1) / (end - first + 1))))
            group = []
        group.append(d)
        last = d
    return out


def test_labels_and_spans_against_plain_diagonals(spark):
    rng = random.Random(4)
    own = {"mine": " ".join(f"w{rng.randint(0, 60)}" for _ in range(200)), "loops": "a b c a b c a b d a b c a b c e " * 5}
    def broken(words, every):
        out = []
        for i, x in enumerate(words):
            if every and i % every == every - 1:
                out += rng.choice([[], [x, "zz"], ["yy"]])
            else:
                out.append(x)
        return out
    texts = []
    for base, label, words in L.templates(own):
        for every in (0, 40, 12, 5):
            texts.append(" ".join([*(["pad"] * rng.randint(0, 9)), *broken(words, every), *(["end"] * rng.randint(0, 9))]))
        texts.append(" ".join(words[: len(words) // 2]))
        texts.append(" ".join([*words, "between", *words]))
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA), own=own).collect()}
    for i, t in enumerate(texts):
        want = [(f, e, label, s) for base, label, words in L.templates(own) if not base for f, e, s in brute_copies(t, words, L.LONG_GRAM if len(words) >= L.LONG else L.SHORT_GRAM) if s >= L.COVER]
        mine = [(x.first, x.last, x.label, x.score) for x in got[i].spans if not (x.label in L.BASE.values() and x.score == 1.0 and x.last - x.first < 4)]
        assert [x[:3] for x in mine] == sorted(x[:3] for x in want), t[:80]
        assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(mine, sorted(want)))


def test_a_long_template_with_inserted_words_is_found_and_a_half_is_not(spark):
    words = [f"word{i}" for i in range(200)]
    inserted = " ".join(x for i, w in enumerate(words) for x in ([w, "more"] if i % 40 == 20 else [w]))
    frame = spark.createDataFrame([(0, "lead " + inserted, "", 0, 0), (1, " ".join(words[:100]), "", 0, 0), (2, " ".join(reversed(words)), "", 0, 0), (3, L.TEXTS["mit"], "", 0, 0)], SCHEMA)
    got = {r.doc_id: r for r in L.scan(frame, own={"own": " ".join(words)}).collect()}
    assert got[0].labels == "own" and [(x.first, x.last) for x in got[0].spans] == [(1, 205)] and got[0].score > 0.9
    assert got[1].labels == "" and abs(got[1].score - 97 / 197) < 1e-9 and got[2].labels == ""
    assert got[3].labels == "mit" and got[3].score == 1.0
