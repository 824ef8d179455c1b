"""Joins J1-J12 that are not already part of another operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deliveries_with_courier(deliveries: DataFrame, couriers: DataFrame, nested: bool = False) -> DataFrame:
    """Every delivery with its courier's name and contact.

    The courier table is a dimension; AQE broadcasts it when its measured
    size is under the threshold, otherwise this stays a sort-merge join."""
    c = couriers.select("courier_id", F.col("name").alias("courier_name"),
                        F.col("contact_info").alias("courier_contact"))
    joined = deliveries.join(c, "courier_id", "inner")
    cols = ["delivery_id", "shipment_id", "courier_id", "status", "estimated_arrival", "actual_arrival",
            "created_at", "updated_at"]
    if nested:
        return joined.select(*cols, F.struct(F.col("courier_id").alias("courier_id"),
                                             F.col("courier_name").alias("name"),
                                             F.col("courier_contact").alias("contact_info")).alias("courier"))
    return joined.select(*cols, "courier_name", "courier_contact")


def split_by_parent(children: DataFrame, parents: DataFrame, fk: str, pk: str | None = None):
    """(accepted, rejected) = rows whose foreign key exists / not."""
    keys = parents.select(F.col(pk or fk).alias(fk))
    return children.join(keys, fk, "left_semi"), children.join(keys, fk, "left_anti")


def tokens_with_user(tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Refresh token joined to its user on refresh."""
    return tokens.join(users.select("user_id", "username", "role", F.col("is_active").alias("user_active")),
                       "user_id", "inner")
