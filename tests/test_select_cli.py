import json
import os
import tempfile

from labelforge.select import select_best


def _write(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")


def test_select_best_per_model(spark):
    d = tempfile.mkdtemp(prefix="lf-tune-")
    cfg = {"per_device_train_batch_size": 8, "learning_rate": 5.55e-05, "weight_decay": 0.25}
    _write(f"{d}/modelA/t0/result.json", [
        {"objective": 6.60, "trial_id": "a0", "timestamp": 10, "training_iteration": 1, "config": cfg},
        {"objective": 6.65, "trial_id": "a0", "timestamp": 20, "training_iteration": 2, "config": cfg}])
    _write(f"{d}/modelA/t1/result.json", [
        {"objective": 6.65, "trial_id": "a1", "timestamp": 30, "training_iteration": 1,
         "config": dict(cfg, per_device_train_batch_size=32)}])
    _write(f"{d}/modelB/t0/result.json", [{"objective": None, "trial_id": "b0", "timestamp": 99},
                                          {"objective": 6.1, "trial_id": "b1", "timestamp": 5}])
    _write(f"{d}/modelB/checkpoint_tmp/result.json", [{"objective": 9.9, "trial_id": "bx", "timestamp": 1}])
    best = {r.model: r for r in select_best(spark, d, skip_dir="checkpoint_tmp").collect()}
    assert best["modelA"].trial_id == "a1"            # tie on 6.65 -> newest timestamp
    assert best["modelA"].config.per_device_train_batch_size == 32
    assert best["modelB"].trial_id == "b1"            # null never wins, skipped dir ignored
    low = {r.model: r.trial_id for r in select_best(spark, d, mode="min", skip_dir="checkpoint_tmp").collect()}
    assert low["modelA"] == "a0"
