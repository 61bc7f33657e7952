"""Row isolation on three axes, as predicates that reach the Parquet scan.

agent: exact; project: own bucket and the global one (''); channel: own and global.
None never filters; '' asks for the global bucket of a project, for nothing of an
agent but rows without one, and doesn't restrict channels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_visible(project: str | None, column: str = "project_id") -> Column:
    if project is None:
        return F.lit(True)
    return F.col(column) == "" if project == "" else F.col(column).isin(project, "")


def visible(agent: str | None = None, project: str | None = None, channel: str | None = None) -> Column:
    """The rows that a caller on these axes may read."""
    parts = [project_visible(project)] if project is not None else []
    if agent is not None:
        parts.append(F.col("agent_id") == agent)
    if channel:
        parts.append(F.col("channel").isin(channel, ""))
    return reduce(Column.__and__, parts, F.lit(True))


def written_axis(value: object) -> str:
    """What a write stores for an axis value."""
    return value if isinstance(value, str) else ""


def read_axis(value: object) -> str | None:
    """What a read filters by for an axis value."""
    return value if isinstance(value, str) else None


#: Permissions from none to most.
LEVELS = ("none", "read", "write", "admin")


def permissions(grants, demands):
    """(principal, agent_id, level) for every demand: an exact grant beats the wildcard's; a demand on '*' gets the least of all grants.

    grants: (principal, pattern, level as a number); demands: (principal, agent_id).
    """
    exact = grants.where("pattern <> '*'").groupBy("principal", F.col("pattern").alias("agent_id")).agg(F.max("level").alias("exact"))
    wild = grants.where("pattern = '*'").groupBy("principal").agg(F.max("level").alias("wild"))
    least = grants.groupBy("principal").agg(F.min("level").alias("least"))
    found = demands.join(exact, ["principal", "agent_id"], "left").join(wild, "principal", "left").join(least, "principal", "left")
    level = F.when(F.col("agent_id") == "*", F.when(F.col("wild").isNotNull(), F.col("least"))).otherwise(F.coalesce("exact", "wild"))
    return found.select("principal", "agent_id", F.coalesce(level, F.lit(0)).alias("level"))
