"""Path-dependent TreeSHAP for boosted trees as a table job.

For one leaf with value v (prediction × tree weight) whose path tests the
distinct features S (|S| = d), let I_j = 1 when the row satisfies every split
on j along the path and r_j = the product of cover fractions of the branches
taken at those splits.  The leaf adds to E[f(x) | x_T] the term
v·Π_{j∈T} I_j·Π_{j∈S\\T} r_j, so its Shapley share for j ∈ S is

    φ_j = v (I_j − r_j) Σ_k k!(d−k−1)!/d! · c_k,
    c_k = coefficient of z^k in Π_{i∈S, i≠j} (r_i + I_i z)

for any number of features on a path, and the base value is Σ v·Π r
(Lundberg et al., arXiv:1802.03888).

The shares of a tree depend only on the outcomes of its own tests: the row's
*signature* in that tree, a letter per split node. So the job is

1. every row's signatures, one per tree, in the row (rows × split nodes);
2. the distinct (tree, signature) pairs, few after a partial aggregate;
3. the shares of each pair once, from the tree's leaves;
4. the pairs joined back and summed over the trees of each row.

The shares of all features of a pair are one array, so step 4 adds arrays in a
partial aggregate and moves one row per row and task. The model (at most trees ×
2^depth leaves, fixed by hyper-parameters) is read from its saved node table
into tables of one row per tree. Spark's margin F gives p = 1/(1+e^(−2F)), so
shares are reported on the log-odds scale (×2).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import factorial

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, sized_broadcast


@dataclass
class Trees:
    """A model's trees: the tests of each, and all leaves with the conditions on
    their path: feature → fraction r and the tests' places and outcomes."""

    tests: list[list[tuple]] = field(default_factory=list)  # (feature, categorical, left categories, threshold)
    leaves: list[dict] = field(default_factory=list)


def trees_from_saved(spark, path: str) -> Trees:
    """Walk every tree of a saved GBT model (node table + tree weights)."""
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    weights = {r[0]: r[2] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}
    by_tree: dict[int, dict[int, object]] = {}
    for n in nodes:
        by_tree.setdefault(n["treeID"], {})[n["id"]] = n
    out = Trees()
    for number, (tree, tab) in enumerate(sorted(by_tree.items())):
        children = {c for n in tab.values() if n["leftChild"] >= 0 for c in (n["leftChild"], n["rightChild"])}
        tests: list[tuple] = []
        stack = [(next(i for i in tab if i not in children), {})]
        while stack:
            nid, conds = stack.pop()
            n = tab[nid]
            if n["leftChild"] < 0:
                out.leaves.append({"tree": number, "v": n["prediction"] * weights[tree], "conds": conds})
                continue
            sp, cover, at = n["split"], n["impurityStats"][0], len(tests)
            category = sp["numCategories"] > 0
            tests.append((sp["featureIndex"], category, sorted(sp["leftCategoriesOrThreshold"]) if category else [], 0.0 if category else float(sp["leftCategoriesOrThreshold"][0])))
            for child, outcome in ((n["leftChild"], "1"), (n["rightChild"], "0")):
                old = conds.get(sp["featureIndex"], {"r": 1.0, "at": []})
                share = tab[child]["impurityStats"][0] / cover if cover else 0.0
                stack.append((child, {**conds, sp["featureIndex"]: {"r": old["r"] * share, "at": [*old["at"], (at, outcome)]}}))
        out.tests.append(tests)
    return out


def base_value(trees: Trees) -> float:
    total = 0.0
    for leaf in trees.leaves:
        prod = leaf["v"]
        for c in leaf["conds"].values():
            prod *= c["r"]
        total += prod
    return 2.0 * total


TESTS = "tree int, tests array<struct<f:int, cat:boolean, set:array<double>, thr:double>>"
LEAVES = "tree int, leaves array<struct<v:double, c:array<struct<f:int, r:double, at:array<struct<i:int, is:string>>>>>>"


def _tests_table(spark, trees: Trees) -> DataFrame:
    return spark.createDataFrame(list(enumerate(trees.tests)), TESTS)


def _leaves_table(spark, trees: Trees) -> DataFrame:
    rows: dict[int, list] = {t: [] for t in range(len(trees.tests))}
    for leaf in trees.leaves:
        rows[leaf["tree"]].append((float(leaf["v"]), [(f, float(c["r"]), [(i + 1, o) for i, o in c["at"]]) for f, c in sorted(leaf["conds"].items())]))
    return spark.createDataFrame(list(rows.items()), LEAVES)


def signatures(xs, tests):
    """Outcomes of a tree's tests for the values ``xs``: "1" left, "0" right."""
    def left(t):
        x = F.get(xs, t["f"])
        return F.when(F.when(t["cat"], F.array_contains(t["set"], x)).otherwise(x <= t["thr"]), F.lit("1")).otherwise(F.lit("0"))
    return F.array_join(F.transform(tests, left), "")


def _leaf_shares(leaf, signature, depth: int):
    """(feature index, φ) of every feature on a leaf's path, for a signature."""
    holds = lambda c: F.forall(c["at"], lambda t: F.substring(signature, t["i"], F.lit(1)) == t["is"])
    path = F.transform(leaf["c"], lambda c: F.struct(c["f"].alias("f"), c["r"].alias("r"), F.when(holds(c), F.lit(1.0)).otherwise(F.lit(0.0)).alias("i")))
    shapley = F.array(*[F.array(*[F.lit(factorial(k) * factorial(d - k - 1) / factorial(d)) for k in range(d)]) for d in range(1, depth + 1)])

    def share(items, me):
        one = F.array(F.lit(1.0))
        # multiply (r + I z) of all the others: next c_k = c_k r + c_{k-1} I
        times = lambda c, x: F.transform(F.concat(c, F.array(F.lit(0.0))), lambda ck, k: ck * x["r"] + F.coalesce(F.get(c, k - 1), F.lit(0.0)) * x["i"])
        coef = F.aggregate(F.filter(items, lambda x: x["f"] != me["f"]), one, times)
        weights = F.get(shapley, F.size(items) - 1)
        total = F.aggregate(F.zip_with(coef, weights, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
        return leaf["v"] * (me["i"] - me["r"]) * total

    # bind the path once: it is used by every share
    return F.flatten(F.transform(F.array(path), lambda items: F.transform(items, lambda me: F.struct(me["f"].alias("f"), share(items, me).alias("phi")))))


def attributions(df: DataFrame, trees: Trees, index_cols: list[str], names: list[str], id_col: str = "id") -> DataFrame:
    """(id, feature, phi) on the log-odds scale; ``index_cols`` hold the
    model's input values in feature-index order. ``id_col`` names a row."""
    spark = df.sparkSession
    depth = max([1, *(len(leaf["conds"]) for leaf in trees.leaves)])
    xs = F.array(*[F.col(c).cast("double") for c in index_cols])
    table = _tests_table(spark, trees).agg(F.sort_array(F.collect_list(F.struct("tree", "tests"))).alias("t")).scalar()  # one row: the model
    rows = df.select(F.col(id_col).alias("id"), xs.alias("xs"), table.alias("model"))
    signs = F.transform("model", lambda t: F.struct(t["tree"].alias("tree"), signatures(F.col("xs"), t["tests"]).alias("sign")))
    rows = cut_lineage(rows.select("id", signs.alias("signs")))  # read by the distinct pairs and by the sums
    long = rows.select("id", F.inline("signs"))
    zero = F.array(*[F.lit(0.0) for _ in names])

    def add(total, leaf):
        # the leaf's shares by feature, added to the array of all features
        return F.zip_with(total, F.aggregate(_leaf_shares(leaf, F.col("sign"), depth), zero, lambda a, s: F.transform(
            a, lambda v, i: F.when(s["f"] == i, v + s["phi"]).otherwise(v))), lambda x, y: x + y)

    pairs = long.select("tree", "sign").distinct().join(F.broadcast(_leaves_table(spark, trees)), "tree")  # a row per tree of the model
    shares = cut_lineage(pairs.select("tree", "sign", F.aggregate("leaves", zero, add).alias("phi")))
    summed = long.join(sized_broadcast(shares), ["tree", "sign"]).groupBy("id").agg(*[F.sum(F.get("phi", i)).alias(f"s{i}") for i in range(len(names))])
    named = F.array(*[F.struct(F.lit(n).alias("feature"), (F.col(f"s{i}") * 2.0).alias("phi")) for i, n in enumerate(names)])
    return summed.select(F.col("id").alias(id_col), F.inline(named))


def save_model(model: GBTClassificationModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path
