"""Command line and session helpers."""

import subprocess
import sys
import tempfile

from conftest import ROOT, SF_SMALL
from kipmart.session import CLUSTER_CONF, SESSION_CONF, ensure_checkpoint_dir


def test_checkpoint_dir_is_kept_once_set(spark):
    first = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == first


def test_job_settings_are_applied(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert "spark.sql.shuffle.partitions" in CLUSTER_CONF
    assert SESSION_CONF["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_cli_lists_and_runs():
    out = subprocess.run([sys.executable, "-m", "kipmart", "list"], cwd=ROOT, capture_output=True,
                         text=True, timeout=300)
    keys = out.stdout.split()
    assert "profit_by_month" in keys and len(keys) >= 90
    dest = tempfile.mkdtemp(prefix="cli-")
    run = subprocess.run([sys.executable, "-m", "kipmart", "run", "sales_monthly", "--data", SF_SMALL,
                          "--out", dest, "--format", "json", "--master", "local[2]"],
                         cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert "sales_monthly: written" in run.stdout
