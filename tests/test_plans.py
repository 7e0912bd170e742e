"""Plan shape: no window over a whole table in one task, broadcasts where
the side is bounded, pruned scans."""

from scorelake.plans import registry

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _unpartitioned_windows(plan: str):
    return [ln for ln in plan.splitlines() if "Window [" in ln and "windowspecdefinition(" in ln
            and "windowspecdefinition(specifiedwindowframe" in ln.replace(" ", "")]


def test_split_has_no_single_partition_exchange(spark):
    registry.load_all()
    df = registry.QUERIES["split_60_20_20"](spark, SF_SMALL)
    plan = _plan(df)
    assert "SinglePartition" not in plan


def test_admin_latest_uses_top_n(spark):
    from scorelake.operators import report as R
    from scorelake.sources import testdata as td
    df = R.admin_latest(*(t(spark, SF_SMALL) for t in (td.users, td.evaluations, td.predictions)), 50)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().sparkPlan().toString()
    assert registry.QUERIES["admin_latest"](spark, SF_SMALL).count() == 50


def test_lineitem_scan_is_pruned(spark):
    registry.load_all()
    df = registry.QUERIES["predictions" if "predictions" in registry.QUERIES else "kpi_all"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    line = [ln for ln in plan.splitlines() if "lineitem" in ln and "ReadSchema" in ln]
    assert line and "l_comment" not in line[0] and "l_tax" not in line[0]


def test_items_lookup_is_broadcast(spark):
    registry.load_all()
    plan = registry.QUERIES["item_lookup"](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan


def _unpartitioned_window_lines(plan: str):
    import re
    out = []
    for ln in plan.splitlines():
        for m in re.finditer(r"windowspecdefinition\(([^,]*)", ln):
            first = m.group(1)
            if re.search(r" (ASC|DESC) NULLS", first) or first.startswith("specifiedwindowframe"):
                out.append(ln.strip())
    return out


# windows without PARTITION BY are allowed only over an already bounded input
BOUNDED_WINDOWS = {"topk_importance", "survey_topk_importance", "gbt_importance"}  # a rank over k rows, or one per feature
# rows read back from a stored table, or the model of gbt_score once more
SLOW = {"runs_gbt", "runs_log", "runs_compare", "shap_tree", "stream_score", "stream_quarantine", "stream_explained", "persist_three"}


def test_no_single_task_window_over_data(spark):
    registry.load_all()
    offenders = {}
    for name, fn in registry.QUERIES.items():
        if name in SLOW or name in BOUNDED_WINDOWS:
            continue
        lines = _unpartitioned_window_lines(_plan(fn(spark, SF_SMALL)))
        if lines:
            offenders[name] = lines[0][:160]
    assert not offenders, offenders
