"""Branches of a target's particles through earlier snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmtide.plans.workspace import Workspace

#: A branch id is the halo plus this times the snapshot.
BRANCH = 10**16


def branch_ids(targets: DataFrame, members: DataFrame, snapshot: int) -> DataFrame:
    """Targets with ``branch``: the halo that holds the particle at a snapshot, made unique over snapshots; null if in none."""
    groups = members.groupBy("id").agg(F.min("halo_id").alias("__h"))
    return targets.join(groups, "id", "left").withColumn("branch", F.col("__h") + F.lit(snapshot) * F.lit(BRANCH)).drop("__h")


def counts(found: DataFrame) -> DataFrame:
    return found.where("branch is not null").groupBy("branch").agg(F.count("*").alias("n"))


def main_branch(found: DataFrame) -> DataFrame:
    """The branch with most particles; of equal ones the smallest."""
    return counts(found).agg(F.max_by("branch", F.struct("n", -F.col("branch"))).alias("branch"))


def follow(targets: DataFrame, members: DataFrame, snapshots: list[int]) -> DataFrame:
    """(id, branch): from the last snapshot back, each particle's branch outside the main one; null while it stays on the main branch."""
    work = Workspace(targets.sparkSession, "branches")
    # written once, as every snapshot reads it
    members = work.keep(members.select("snapshot", "id", "halo_id"))
    left, out = targets.select("id"), None
    for snapshot in sorted(snapshots, reverse=True):
        found = work.keep(branch_ids(left, members.where(F.col("snapshot") == snapshot), snapshot))
        main = main_branch(found).first()["branch"]
        stays = F.col("branch").isNull() | (F.col("branch").eqNullSafe(F.lit(main)))
        gone = found.where(~stays)
        out = gone if out is None else out.union(gone)
        left = found.where(stays).select("id")
    rest = left.withColumn("branch", F.lit(None).cast("long"))
    return rest if out is None else out.union(rest)
