"""The audit of a stored pipeline: a changed node file, a lost stage and a
drifted metric each fail; manifest values as hashlib has them."""

import hashlib
import json
import shutil

from scorelake.operators import audit as A
from scorelake.operators import gbt as G
from scorelake.plans.model import FEATURES, split_frame
from scorelake.sources import files

from conftest import SF_SMALL


def test_a_pipeline_that_was_touched_fails(spark, tmp_path):
    rows = split_frame(spark, SF_SMALL, 20, 25).persist()
    model = G.fit(rows.where("split = 'train'"), FEATURES, 3, depth=2)
    paths = A.store_pipeline(model, 3, rows, FEATURES, f"file://{tmp_path}/good")

    def verdict(name, change):
        shutil.copytree(tmp_path / "good", tmp_path / name)
        change(tmp_path / name)
        return A.audit_pipeline(rows, FEATURES, {k: f"file://{tmp_path}/{name}/{k}" for k in paths}).first()

    good = A.audit_pipeline(rows, FEATURES, paths).first()
    assert good.estado == "PRODUCTION READY" and good.n_files > 5 and good.metric_drift == 0

    def node(folder):
        part = next(p for p in sorted((folder / "model").glob("stages/*/data/*.parquet")))
        part.write_bytes(part.read_bytes() + b"x")

    def node_and_checksum(folder):
        node(folder)
        for crc in folder.glob("model/stages/*/data/.*.crc"):
            crc.unlink()

    def stage(folder):
        first = sorted((folder / "model" / "stages").iterdir())[0]
        first.rename(folder / "elsewhere")

    def metric(folder):
        part = next((folder / "metrics").glob("part-*.json"))
        row = json.loads(part.read_text())
        part.write_text(json.dumps({**row, "f1_riesgo": row["f1_riesgo"] + 0.01}))
        for crc in (folder / "metrics").glob(".*.crc"):
            crc.unlink()

    unreadable = verdict("node", node)
    assert unreadable.lost == 1 and not unreadable.integrity_passed and unreadable.estado == "AUDIT FAILED"
    changed = verdict("sums", node_and_checksum)
    assert (changed.changed, changed.lost) == (1, 0) and not changed.integrity_passed and changed.estado == "AUDIT FAILED"
    lost = verdict("stage", stage)
    assert lost.lost >= 2 and lost.changed == 0 and lost.estado == "AUDIT FAILED"
    drifted = verdict("metric", metric)
    assert (drifted.lost, drifted.changed, drifted.added) == (0, 0, 0) and drifted.auc_drift == 0 and drifted.metric_drift > 0.009 and drifted.estado == "AUDIT FAILED"


def test_manifest_is_what_hashlib_says(spark, tmp_path):
    folder = tmp_path / "artefact"
    (folder / "deep" / "er").mkdir(parents=True)
    data = {"a.bin": b"y", "deep/b.bin": b"x" * 5000, "deep/er/c d.txt": "ñandú".encode()}
    for name, raw in data.items():
        (folder / name).write_bytes(raw)
    got = {r.path.split("/artefact/")[1].replace("%20", " "): r for r in files.artifact_manifest(spark, f"file://{folder}").collect()}
    assert set(got) == set(data)
    for name, raw in data.items():
        assert got[name].existe and got[name].sha256 == hashlib.sha256(raw).hexdigest() and got[name].size_kb == round(len(raw) / 1024, 2)
