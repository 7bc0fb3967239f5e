"""Session helpers and small pure functions."""

from __future__ import annotations

import zlib

from usertrail.config import cluster_conf, ensure_checkpoint_dir
from usertrail.constants import PALETTE
from usertrail.operators.families import FamilyPlan


def test_cluster_conf_sizes_partitions():
    conf = cluster_conf(30 * 2**40)
    assert conf["spark.sql.shuffle.partitions"] == str(30 * 2**40 // (256 << 20))
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert cluster_conf(1)["spark.sql.shuffle.partitions"] == "200"


def test_checkpoint_dir_is_read_from_the_session(spark):
    path = ensure_checkpoint_dir(spark)
    assert path and spark.conf.get("spark.checkpoint.dir") == path
    assert spark.sparkContext.getCheckpointDir() is not None


def test_registry_slots_are_crc32_based():
    plan = FamilyPlan(("click", "view"), (), has_other=True)
    rows = {r[0]: r for r in plan.registry_rows()}
    for fam in ("click", "view"):
        slot = zlib.crc32(fam.encode()) % len(PALETTE)
        assert rows[fam][2] == slot and rows[fam][3:] == PALETTE[slot]
    assert rows["other"][1] == "Other" and rows["other"][2] == -1
