"""Clients of the interface: who may ask in which modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import fingerprint
from ..schema import ALL_MODES


def add(clients: DataFrame, asked: DataFrame) -> DataFrame:
    """clients (client_id, label, fingerprint, modes, revoked) with those asked for (label, fingerprint, modes): one whose certificate is known gets the new label and modes, and isn't revoked.

    No label, no modes, modes that don't exist, or what isn't a fingerprint is an error. New ones are numbered in the order of their fingerprints.
    """
    own = fingerprint(F.col("fingerprint"))
    bad = (F.coalesce("label", F.lit("")) == "") | own.isNull() | ~F.coalesce(F.col("modes").between(1, ALL_MODES), F.lit(False))
    new = asked.select(F.when(bad, F.raise_error(F.lit("label, certificate fingerprint and modes are required")).cast("string")).otherwise(own).alias("fingerprint"), F.col("label").alias("_label"), F.col("modes").cast("long").alias("_modes"))
    both = clients.join(new, "fingerprint", "full")
    top = clients.agg(F.coalesce(F.max("client_id"), F.lit(0)).alias("_top"))
    fresh = F.row_number().over(Window.partitionBy(F.col("client_id").isNull()).orderBy("fingerprint"))  # a table of people's certificates
    rows = both.withColumn("_n", fresh).crossJoin(F.broadcast(top))
    return rows.select(
        F.coalesce("client_id", F.col("_top") + F.col("_n")).cast("long").alias("client_id"),
        F.coalesce("_label", "label").alias("label"),
        "fingerprint",
        F.coalesce("_modes", F.col("modes").cast("long")).alias("modes"),
        F.when(F.col("_label").isNotNull(), False).otherwise(F.col("revoked")).alias("revoked"),
    )


def revoke(clients: DataFrame, ids: DataFrame) -> DataFrame:
    """clients with those of ids revoked; changed tells which weren't before."""
    rows = clients.join(ids.select("client_id").distinct().withColumn("_gone", F.lit(True)), "client_id", "left")
    gone = F.coalesce("_gone", F.lit(False))
    return rows.select("client_id", "label", "fingerprint", "modes", (F.col("revoked") | gone).alias("revoked"), (gone & ~F.col("revoked")).alias("changed"))


def allows(requests: DataFrame, clients: DataFrame, mode: Column | str = "mode") -> DataFrame:
    """requests (fingerprint, mode) with allowed: a full fingerprint of a client that isn't revoked and has the mode."""
    mode = F.col(mode) if isinstance(mode, str) else mode
    known = clients.where("NOT revoked").select("fingerprint", F.col("modes").alias("_modes"))
    rows = requests.join(known, "fingerprint", "left")
    return rows.withColumn("allowed", F.coalesce((F.length("fingerprint") == 95) & (mode != 0) & (F.col("_modes").bitwiseAND(mode) != 0), F.lit(False))).drop("_modes")
