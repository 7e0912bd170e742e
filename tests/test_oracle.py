"""Every registered query against its DuckDB twin on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import pytest

from scorelake.functions import fixed
from scorelake.operators.runs import GBT_CONFIGS
from scorelake.plans import registry

from conftest import SF_SMALL

registry.load_all()
NAMES = sorted(registry.QUERIES)


def of(columns, rows):
    return [dict(zip(columns, r)) for r in rows]


def scores(columns, rows):
    got = of(columns, rows)
    assert len({r["id"] for r in got}) == len(got) and {r["split"] for r in got} == {"train", "val", "test"}
    for r in got:
        assert 0 <= r["p_default"] <= 1 and r["trees_used"] >= 1
        if abs(r["p_default"] - 0.30) > 1e-6 and abs(r["p_default"] - 0.35) > 1e-6:
            assert r["tramo"] == next(t for bound, _, t, _ in fixed.POLICY if r["p_default"] < bound)


def importance(columns, rows):
    got = sorted(of(columns, rows), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 33)) and len({r["feature"] for r in got}) == 32
    assert sum(r["pct"] for r in got) == pytest.approx(100, abs=1e-4) or not any(r["pct"] for r in got)  # no split in a tiny table
    assert all(a["pct"] >= b["pct"] for a, b in zip(got, got[1:]))


def shares(columns, rows):
    got = of(columns, rows)
    assert len(got) == 32 * len({r["id"] for r in got}) and len({r["base_value"] for r in got}) == 1


def runs(columns, rows):
    got = {(r["run_name"], r["name"]): r["value"] for r in of(columns, rows)}
    for c in GBT_CONFIGS:
        assert got[c["name"], "param.trees"] == str(c["trees"]) and got[c["name"], "param.min_instances"] == str(c["min_instances"])
        assert 1 <= float(got[c["name"], "trees_used"]) <= c["trees"] and 0 <= float(got[c["name"], "auc_test"]) <= 1
        assert got[c["name"], "tag.ablation"] == c["tags"]["ablation"]


def synthetic(columns, rows):
    from scorelake.functions.fixed import LIKERT_LEVELS
    got = of(columns, rows)
    assert len({(r["origen"], r["j"]) for r in got}) == len(got) and len({r["label"] for r in got}) <= 1
    for r in got:
        assert all(r[c] in [*LIKERT_LEVELS, "Desconocido"] for c in fixed.ITEM_CODES) and r["distrito"] in fixed.TRAIN_DISTRICTS
        assert 10 <= r.get("edad", 10) < 90


def manifest(columns, rows):
    got = of(columns, rows)
    assert any(r["archivo"].endswith(".parquet") for r in got)
    assert all(r["existe"] and r["size_kb"] >= 0 and len(r["sha256"]) == 64 for r in got)


def audit(columns, rows):
    (r,) = of(columns, rows)
    assert r["n_files"] > 5 and (r["lost"], r["changed"], r["added"]) == (0, 0, 0)
    assert r["auc_drift"] == 0 and r["metric_drift"] == 0 and r["estado"] == "PRODUCTION READY"


INVARIANTS = {"audit_trees": audit, "gbt_score": scores, "gbt_importance": importance, "shap_tree": shares, "runs_gbt": runs, "smoten": synthetic, "smote_nc": synthetic, "artifact_manifest": manifest}


@pytest.fixture(scope="module")
def con():
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from oracle_check import duck
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    from oracle_check import compare, type_diff
    sdf = registry.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in sdf.collect()]
    sql = registry.ORACLE.get(name)
    if sql is None:
        INVARIANTS[name](sdf.columns, rows)
        return
    rel = con.execute(sql)
    msg = compare(sdf.columns, rows, [d[0] for d in rel.description], rel.fetchall())
    assert msg is None, msg
    assert not type_diff(sdf, rel.description)
