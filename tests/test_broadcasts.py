"""Which joins the job settings let the planner broadcast before it has run anything."""

import pytest

from kipmart import session


@pytest.fixture
def job(spark):
    old = {k: spark.conf.get(k, None) for k in session.SESSION_CONF}
    session.apply_job_conf(spark)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_many_rows_in_a_small_file_are_not_broadcast(job, tmp_path):
    # 3 million keys: under a megabyte by the planner's estimate, 200 MB as a hash table
    path = str(tmp_path / "keys")
    job.range(3_000_000).selectExpr("id", "'x' as a", "'y' as b").coalesce(1).write.parquet(path)
    keys, lines = job.read.parquet(path).select("id"), job.read.parquet(path).selectExpr("id", "a as line")
    assert "Broadcast" not in _planned(lines.join(keys, "id"))
    assert "Broadcast" not in _planned(lines.join(keys, "id", "left_semi"))


def test_fixed_tables_are_broadcast(job, tmp_path):
    path = str(tmp_path / "categories")
    job.range(30).selectExpr("id", "'Brand' as name").write.parquet(path)
    big = job.range(10_000_000).selectExpr("id % 30 as id", "id as n")
    assert "Broadcast" in _planned(big.join(job.read.parquet(path), "id"))


def test_rows_that_turn_out_few_are_broadcast(job, tmp_path):
    path = str(tmp_path / "orders")
    job.range(200_000).selectExpr("id", "cast(id as string) as s", "uuid() as u").write.parquet(path)
    orders = job.read.parquet(path)
    few = orders.groupBy((orders.id % 40).alias("id")).count()
    j = orders.join(few, "id")
    j.collect()
    assert "BroadcastHashJoin" in j._jdf.queryExecution().executedPlan().toString()
