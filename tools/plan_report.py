"""Write docs/PLANS.md: the physical operator tree of the headline jobs
(``explain("formatted")`` overview section) after one run at the given scale."""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(sf_dir: str = "/root/testdata/sf0.1") -> None:
    from scorelake.plans import registry
    from scorelake.session import build_session

    spark = build_session()
    registry.load_all()
    out = ["# Physical plans of the headline jobs", "",
           f"Operator trees from `explain(\"formatted\")` after running each job once on `{sf_dir}`",
           "(AQE final plans; generated by `tools/plan_report.py`).", ""]
    for name in registry.HEADLINE:
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n(")[0].rstrip().splitlines()
        if len(tree) > 70:
            tree = tree[:70] + [f"... ({len(tree) - 70} more lines: nested cached plans)"]
        scans = []
        for block in text.split("\n\n("):
            if block.split(")", 1)[-1].lstrip().startswith("Scan parquet"):
                keep = [ln for ln in block.splitlines()
                        if ln.startswith(("Location", "PushedFilters", "ReadSchema"))]
                loc = next((ln for ln in keep if ln.startswith("Location")), "")
                table = loc.rsplit("/", 1)[-1].rstrip("]") if loc else "?"
                line = f"* `{table}`: " + "; ".join(ln for ln in keep if not ln.startswith("Location"))
                if line not in scans:
                    scans.append(line)
        out += [f"## {name}", "", "```", *tree, "```", "", "Scans:", "", *scans, ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    open(path, "w").write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
