"""Key reconciliation: fuzzy name matching and vocabulary checks.

Similarity is ``1 − levenshtein(a, b) / max(|a|, |b|)``; a pair matches at
``sim ≥ cutoff``.  Candidate pairs come from an equi-join on *rare* positional
bigrams (prefix filtering), never from a cross product:

* if ``lev(a, b) ≤ k`` the strings share at least ``M − 1 − 2k`` positional
  bigrams, ``M = max(|a|, |b|)`` (q-gram count filter, q = 2);
* with ``k = ⌊(1 − cutoff)·M⌋`` that bound τ is ≥ 1 for every cutoff ≥ 0.8
  and M ≥ 2, and for M ≤ 1 only equal strings match (handled by the exact
  pass) — so the filter loses no true match;
* if two token sets share ≥ τ tokens, their first ``|A| − τ + 1`` tokens in a
  global order (rarest first) intersect, so each string only indexes that
  prefix — and the prefix holds its rarest tokens, which keeps join groups
  small.

Every window is partitioned by one string (bounded by its length) or one
probe key (bounded by its candidates).  Only *distinct* keys enter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed


def _tau_column(length_col: str, cutoff: float):
    """Lower bound of the bigram overlap any partner of a string must share.

    A partner has M = max(|a|, |b|) ≤ |a| / cutoff, so k ≤ ⌊(1 − c)·|a| / c⌋ and
    τ ≥ |a| − 1 − 2·⌊(1 − c)·|a| / c⌋.  For c ≥ 0.8 this is ≥ 1 whenever
    |a| ≥ 2 (and a 1-character string can only match itself exactly).
    """
    L = F.col(length_col)
    return L - F.lit(1) - F.lit(2) * F.floor(L * F.lit((1.0 - cutoff) / cutoff) + F.lit(1e-12))


def _tokens(df: DataFrame, col: str) -> DataFrame:
    """(s, gram, occ): positional bigrams; ``occ`` numbers repeats of a gram."""
    t = (df.select(F.col(col).alias("s")).filter(F.length("s") >= 2)
         .select("s", F.explode(F.sequence(F.lit(0), F.length("s") - 2)).alias("i")))
    t = t.withColumn("gram", F.substring("s", F.col("i") + 1, 2))
    occ = F.row_number().over(Window.partitionBy("s", "gram").orderBy("i"))
    return t.withColumn("occ", occ).drop("i")


def _prefixes(tok: DataFrame, freq: DataFrame, cutoff: float) -> DataFrame:
    t = tok.join(freq, ["gram", "occ"])
    t = t.withColumn("_len", F.length("s")).withColumn("_tau", _tau_column("_len", cutoff))
    keep = (F.col("_len") - F.lit(1)) - F.col("_tau") + F.lit(1)
    w = Window.partitionBy("s").orderBy("freq", "gram", "occ")
    return (t.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
            .select("s", "gram", "occ"))


def candidate_pairs(probe: DataFrame, ref: DataFrame, cutoff: float) -> DataFrame:
    """Distinct (a, b) pairs that may reach ``cutoff``; exact for cutoff ≥ 0.8."""
    if cutoff < 0.8:
        raise ValueError("bigram prefix filtering is exact only for cutoff >= 0.8")
    tp, tr = _tokens(probe, "a"), _tokens(ref, "b")
    freq = tp.unionByName(tr).groupBy("gram", "occ").agg(F.count(F.lit(1)).alias("freq"))
    pp = _prefixes(tp, freq, cutoff).withColumnRenamed("s", "a")
    rp = _prefixes(tr, freq, cutoff).withColumnRenamed("s", "b")
    pairs = pp.join(rp, ["gram", "occ"]).select("a", "b").distinct()
    la, lb = F.length("a"), F.length("b")
    m = F.greatest(la, lb)
    k = F.floor(m * F.lit(1.0 - cutoff) + F.lit(1e-12))
    return pairs.filter(F.abs(la - lb) <= k)


def similarity(a, b):
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def best_match(probe: DataFrame, ref: DataFrame, cutoff: float = fixed.FUZZY_CUTOFF) -> DataFrame:
    """(a, b, sim): best ``ref`` key per ``probe`` key, ties to the smaller b."""
    cand = candidate_pairs(probe, ref, cutoff)
    scored = cand.withColumn("sim", similarity(F.col("a"), F.col("b"))).filter(F.col("sim") >= cutoff)
    w = Window.partitionBy("a").orderBy(F.col("sim").desc(), F.col("b"))
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def fuzzy_map(inputs: DataFrame, canonical: DataFrame, cutoff: float = fixed.FUZZY_CUTOFF) -> DataFrame:
    """Input key → model feature.  Exact names pass through, the rest take
    the best fuzzy match at ``cutoff``; unmatched keys are kept as they are."""
    keys = inputs.select(F.col("input").alias("a")).distinct()
    ref = canonical.select(F.col("canonical").alias("b")).distinct()
    exact = keys.join(ref, keys.a == ref.b, "left_semi")
    rest = keys.join(ref, keys.a == ref.b, "left_anti")
    fuzzy = best_match(rest, ref, cutoff)
    out_exact = exact.select(F.col("a").alias("input"), F.col("a").alias("mapeado"),
                             F.lit(1.0).alias("sim"), F.lit("exacto").alias("tipo"))
    matched = rest.join(fuzzy, "a", "left")
    out_rest = matched.select(
        F.col("a").alias("input"), F.coalesce("b", "a").alias("mapeado"),
        C.r6("sim").alias("sim"),
        F.when(F.col("b").isNotNull(), F.lit("difuso")).otherwise(F.lit("sin_match")).alias("tipo"))
    return out_exact.unionByName(out_rest)


#: Edits within which a key is first compared with a vocabulary.
NEAR = 2


def _once(value, body):
    """``body(value)`` with ``value`` worked out once: a column that is named
    twice inside a lambda is worked out twice there."""
    return F.get(F.transform(F.array(value), body), 0)


def known_name(key, names: dict[str, str], cutoff: float = fixed.FUZZY_CUTOFF):
    """J2 inside a row: the code that ``names`` (a fixed vocabulary, name → code)
    gives a key, exactly or by its most similar name (ties to the smaller name)
    at ``cutoff``; null when there is none. Only keys without an exact match
    are compared, first as far as ``NEAR`` edits. A name farther away is at most
    |key| / (|key| + NEAR + 1) alike; only where nothing beats that, the key is
    compared as far as the cutoff allows: a key at least ``cutoff`` alike has
    |name| / cutoff characters at most, so the name bounds its distance."""
    ordered = sorted(names)
    codes = F.create_map(*[F.lit(x) for n in ordered for x in (n, names[n])])

    def sim(k, n: str, near: bool):
        far = int(len(n) * (1.0 - cutoff) / cutoff + 1e-9) if cutoff > 0 else None
        if not near and far is None:
            return similarity(k, F.lit(n))
        d = F.levenshtein(k, F.lit(n), NEAR if near else far)
        return F.when(d >= 0, F.lit(1.0) - d / F.greatest(F.length(k), F.lit(len(n))))

    def best(k, near: bool):
        return F.array_max(F.array(*[F.struct(sim(k, n, near).alias("sim"), F.lit(-i).alias("at"), F.lit(names[n]).alias("code")) for i, n in enumerate(ordered)]))

    def fuzzy(k):
        sure = lambda c: c["sim"] > F.length(k) / (F.length(k) + F.lit(NEAR + 1)) + F.lit(1e-12)
        found = _once(best(k, True), lambda c: F.when(sure(c), c).otherwise(best(k, False)))
        return _once(found, lambda c: F.when(c["sim"] >= cutoff, c["code"]))

    return _once(key, lambda k: F.coalesce(F.try_element_at(codes, k), fuzzy(k)))


def named_entries(data, names: dict[str, str], cutoff: float = fixed.FUZZY_CUTOFF):
    """A document's map of answer lists as an array of (code, key, values), in
    the order of arrival; the code is null where the vocabulary has no name."""
    return F.transform(F.map_entries(data), lambda e: F.struct(
        known_name(C.strip_likert_prefix(e["key"]), names, cutoff).alias("code"), e["key"].alias("key"), e["value"].alias("values")))


def last_entry(entries, code: str):
    """Of several inputs on one feature the last wins; null when there is none."""
    return F.try_element_at(F.filter(entries, lambda e: e["code"] == code), F.lit(-1))


def last_wins(inputs: DataFrame, doc: str, position: str, mapping: DataFrame, value: str) -> DataFrame:
    """J2's conflict rule on a table of inputs (``doc``, ``position``, input,
    ``value``): renamed by ``mapping`` (``fuzzy_map``'s input, mapeado), the
    value at the largest position stays for each document and feature."""
    named = inputs.join(mapping.select("input", "mapeado"), "input", "left").withColumn("feature", F.coalesce("mapeado", "input"))
    return named.groupBy(doc, "feature").agg(F.max_by(value, position).alias(value), F.count(F.lit(1)).alias("entradas"))


def fuzzy_reconcile(columns: DataFrame, features: DataFrame, cutoff: float = fixed.FUZZY_CUTOFF,
                    fail: bool = True) -> DataFrame:
    """Each expected feature → the input column that carries it.

    Exact names first (and they leave the candidate pool), then the best fuzzy
    match; a feature with no match raises at run time (``raise_error``)."""
    cols = columns.select(F.col("columna").alias("b")).distinct()
    feats = features.select(F.col("feature").alias("a")).distinct()
    exact = feats.join(cols, feats.a == cols.b, "left_semi")
    need = feats.join(cols, feats.a == cols.b, "left_anti")
    pool = cols.join(feats, cols.b == feats.a, "left_anti")
    fuzzy = best_match(need, pool, cutoff)
    out_exact = exact.select(F.col("a").alias("feature"), F.col("a").alias("columna"),
                             F.lit(1.0).alias("sim"), F.lit("exacto").alias("tipo"))
    matched = need.join(fuzzy, "a", "left")
    missing = F.concat(F.lit("no match for required column: "), F.col("a"))
    col = F.col("b") if not fail else F.when(F.col("b").isNotNull(), F.col("b")).otherwise(
        F.raise_error(missing).cast("string"))
    out_rest = matched.select(F.col("a").alias("feature"), col.alias("columna"), C.r6("sim").alias("sim"),
                              F.lit("difuso").alias("tipo"))
    return out_exact.unionByName(out_rest)


def vocab_gaps(df: DataFrame, column: str, vocabulary: list[str], field: str) -> DataFrame:
    """Stored values outside a vocabulary, with counts (left-anti against
    a broadcast of the fixed list)."""
    vocab = df.sparkSession.createDataFrame([(v,) for v in vocabulary], "valor string")
    vals = df.groupBy(F.col(column).alias("valor")).agg(F.count(F.lit(1)).alias("n"))
    return (vals.join(F.broadcast(vocab), "valor", "left_anti")
            .select(F.lit(field).alias("campo"), "valor", "n"))
