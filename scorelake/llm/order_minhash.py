"""Document fingerprints by order min-hash (op 5).

A text is a sequence of symbols: runs of up to 16 non-space characters, or
single characters of scripts written without spaces. Its k-mers (K = 2
symbols) get occurrence numbers, so that the second "of the" differs from the
first. One hash of (k-mer, number) deals them to ``SLOTS`` slots by its top
bits; a slot selects its ``PICK`` minimal ones, puts them back into text order
and hashes the tuple. Moving a passage therefore changes slots although the
set of k-mers stays, which makes the likeness of two fingerprints - equal
slots over slots used by either - follow edit distance.

Everything happens inside the row with array functions: longs that carry
38 hash bits and 26 position bits are sorted, never rows, and nothing is
exploded. Occurrence numbers come from the sorted array by a doubling search
over the run of equal k-mers.

One draw deals the k-mers to slots, so this is a variant: order min-hash as
published picks the minimal k-mers of the whole text for every sketch. A slot
of a long text sees a part of the k-mers; of a short text (under some 130
symbols) most slots hold one k-mer, whose tuple has no order, so that moving a
passage of a short text changes few slots (20 words with their halves swapped
are about 0.8 alike).

The next document in id order is found by dealing rows to ranges of ids (the
bounds are quantiles, four per shuffle partition) and lending each range the
first row of the following one.

Cases: null texts count as empty; texts without symbols have an empty
fingerprint, and two empty ones are alike (1.0), one empty and one not are
unlike (0.0); rows with equal ids are ordered by a hash of the text, null ids
come last; the next document of the only one is itself; an empty table gives
an empty result; other columns are not read. Positions are taken modulo 2**26:
beyond 67 million symbols a text's order is only partly used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import keyed, shuffle_partitions

SLOT_BITS, PICK = 6, 2
SLOTS = 1 << SLOT_BITS
POS_BITS = 26
SYMBOL = "[^\\s\\u2E80-\\x{10FFFF}]{1,16}|\\S"
_POS = (1 << POS_BITS) - 1


def _slot(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - SLOT_BITS)


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array ``out``: (slot << 24 | 24 bits of the tuple's hash)
    of every used slot, ascending."""
    w, s, t, u = (f"_{out}_{x}" for x in "wstu")
    high, low = F.lit(-1 << POS_BITS), F.lit(_POS)
    df = df.withColumn(w, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOL), F.lit(0)))
    mers = F.transform(w, lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1)).bitwiseAND(high).bitwiseOR(i.cast("long").bitwiseAND(low)))
    df = df.withColumn(s, F.sort_array(mers)).drop(w)

    def equal(x: Column, i: Column, back: Column) -> Column:  # the k-mer at i - back is that at i
        return F.coalesce(F.shiftrightunsigned(F.get(F.col(s), i - back).bitwiseXOR(x), POS_BITS) == 0, F.lit(False))

    def number(x: Column, i: Column) -> Column:
        steps = F.array(*[F.lit(1 << b) for b in range(POS_BITS - 1, -1, -1)])
        far = F.aggregate(steps, F.lit(0), lambda d, b: F.when((i >= d + b) & equal(x, i, d + b), d + b).otherwise(d))
        near = [F.when(~equal(x, i, F.lit(d)), F.lit(d - 1)) for d in (1, 2, 3, 4)]
        return F.coalesce(reduce(lambda a, b: a.when(*b), [(~equal(x, i, F.lit(d)), F.lit(d - 1)) for d in (2, 3, 4)], near[0]), far)

    chosen = F.transform(s, lambda x, i: F.xxhash64(x.bitwiseAND(high), number(x, i)).bitwiseAND(high).bitwiseOR(x.bitwiseAND(low)))
    df = df.withColumn(t, F.sort_array(chosen)).drop(s)
    minimal = F.filter(t, lambda x, i: F.coalesce(_slot(F.get(F.col(t), i - PICK)) != _slot(x), F.lit(True)))
    df = df.withColumn(u, minimal).drop(t)

    def tuple_hash(x: Column, i: Column) -> Column:  # x is the first of its slot
        mine = F.filter(F.slice(u, i + 1, PICK), lambda y: _slot(y) == _slot(x))
        in_order = F.sort_array(F.transform(mine, lambda y: F.shiftleft(y, 64 - POS_BITS).bitwiseOR(F.shiftrightunsigned(y, POS_BITS))))
        return F.xxhash64(F.transform(in_order, lambda y: y.bitwiseAND(F.lit((1 << (64 - POS_BITS)) - 1)))).bitwiseAND(F.lit((1 << 24) - 1))

    first = lambda x, i: F.coalesce(_slot(F.get(F.col(u), i - 1)) != _slot(x), F.lit(True))
    slots = F.filter(F.transform(u, lambda x, i: F.when(first(x, i), F.shiftleft(_slot(x), 24).bitwiseOR(tuple_hash(x, i)))), lambda y: y.isNotNull())
    return df.withColumn(out, F.sort_array(slots)).drop(u)


def as_text(sig: Column) -> Column:
    """A signature as a string, 8 hex digits a used slot."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal slots over slots used by either; 1 if neither uses any."""
    slots = lambda s: F.transform(s, lambda x: F.shiftright(x, 24))
    used = F.size(a) + F.size(b) - F.size(F.array_intersect(slots(a), slots(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def _range_of(doc_id: Column, tie: Column, edges: Column, n: int) -> Column:
    """Number of ``edges`` (an ascending array of at most 2 n ids) that are at
    most ``doc_id``, by a doubling search; null ids come last, dealt by tie."""
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length(), -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda k, b: F.when(F.coalesce(F.get(edges, k + b - 1) <= doc_id, F.lit(False)), k + b).otherwise(k))
    last = F.lit(2 * n + 1) + F.floor((tie / F.lit(2.0 ** 63) + 1) / 2 * n).cast("int")
    return F.when(doc_id.isNull(), last).otherwise(found)


def with_next(rows: DataFrame, then) -> DataFrame:
    """``rows`` (doc_id, tie, text) through ``then``, which adds columns row by
    row, with ``next_<c>`` of the following row in (doc_id, tie) order, the
    first row following the last.

    Rows are dealt to ranges by ids' quantiles, a table of one row that the
    plan reads (no literal per range). Each range borrows the first row of the
    next one that has rows.
    """
    n = 4 * shuffle_partitions(rows.sparkSession)
    some = rows.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(16 * n)
    some = some.agg(F.sort_array(F.collect_list("doc_id")).alias("s"))  # 16 ids a range, whatever the input
    edges = some.select(F.array_distinct(F.filter(F.col("s"), lambda x, i: i % F.greatest(F.floor(F.size("s") / n), F.lit(1)) == 0)).alias("e")).scalar()
    ranged = rows.withColumn("edges", edges)
    ranged = ranged.withColumn("range", _range_of(F.col("doc_id"), F.col("tie"), F.col("edges"), n)).drop("edges")
    # one row per range: 3 n or so
    firsts = ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("f"))
    order = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy()))
    firsts = firsts.select(F.col("range").alias("own"), F.col("f.doc_id").alias("first_id"), F.col("f.tie").alias("first_tie"), before.alias("lender_of"))
    same = (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    lent = ranged.join(F.broadcast(firsts), same).groupBy("own").agg(F.first(F.struct("doc_id", "tie", "text", F.col("lender_of").alias("range"))).alias("r"))
    both = ranged.withColumn("lent", F.lit(False)).unionByName(lent.select("r.*", F.lit(True).alias("lent")))
    both = then(both)
    order = Window.partitionBy("range").orderBy("lent", F.col("doc_id").asc_nulls_last(), "tie")
    added = [c for c in both.columns if c not in ("doc_id", "tie", "range", "lent")]
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in added]).where("not lent").drop("lent", "range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next of every row; the edited text is the text with its
    last floor(n_chars / 2) characters replaced by as many of the next
    document's first (or all of them)."""
    rows = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    rows = with_next(rows, lambda both: with_signature(both, "text", "sig"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.select("doc_id", n.alias("n_chars"), "sig", "next_sig", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = with_signature(rows, "edited", "edited_sig")
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sig")).alias("fingerprint"),
                       as_text(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                       likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
