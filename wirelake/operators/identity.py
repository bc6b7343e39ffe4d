"""Names for addresses: building the table of identities and attaching it to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import text

#: An identity table up to this many rows is broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 500_000


def workload_of(kind: Column, owner: Column, pod: Column) -> Column:
    """The workload behind a pod's owner: a replica set's name without its hash."""
    return F.when(F.coalesce(owner, F.lit("")) == "", pod).when(kind == "ReplicaSet", F.regexp_replace(owner, "-[a-z0-9]+$", "")).otherwise(owner)


def build_identities(pods: DataFrame, services: DataFrame) -> DataFrame:
    """(ip, name, namespace, workload), one row per address.

    ``pods``: name, namespace, ips, hostNetwork, ownerKind, owner; ``services``: name, namespace,
    ips. Pods on the host's network and services without an address are left out; a pod wins over
    a service, and names decide between equals.
    """
    p = pods.filter(~F.coalesce("hostNetwork", F.lit(False))).select(F.explode("ips").alias("ip"), "name", "namespace", workload_of(F.col("ownerKind"), F.col("owner"), F.col("name")).alias("workload"), F.lit(0).alias("__rank"))
    s = services.select(F.explode("ips").alias("ip"), "name", "namespace", F.col("name").alias("workload"), F.lit(1).alias("__rank"))
    both = p.unionByName(s).filter("ip is not null and ip not in ('', 'None')")
    first = Window.partitionBy("ip").orderBy("__rank", "namespace", "name")
    return both.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "__rank")


def enrich(entries: DataFrame, identities: DataFrame) -> DataFrame:
    """Entries with blank names filled in from their addresses, at both ends.

    Name and namespace are set together and only where the name is blank, the workload only where
    it is. The table is broadcast if a bounded count finds it small.
    """
    small = identities.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for side in ("src", "dst"):
        ids = identities.select(F.col("ip").alias("__ip"), F.struct("name", "namespace", "workload").alias("__id"))
        entries = entries.join(F.broadcast(ids) if small else ids, F.col(f"{side}.ip") == F.col("__ip"), "left")
        found, blank = F.col("__id").isNotNull(), text(f"{side}.name") == ""
        new = F.col(side)
        new = new.withField("name", F.when(found & blank, F.col("__id.name")).otherwise(F.col(f"{side}.name")))
        new = new.withField("namespace", F.when(found & blank, F.col("__id.namespace")).otherwise(F.col(f"{side}.namespace")))
        new = new.withField("workload", F.when(found & (text(f"{side}.workload") == ""), F.col("__id.workload")).otherwise(F.col(f"{side}.workload")))
        entries = entries.withColumn(side, new).drop("__ip", "__id")
    return entries
