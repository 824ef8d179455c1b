"""P13 and P15 through their indexes (``streaming.indexes``), after change sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolake.plans import queries_core  # noqa: F401  (its oracles are used below)
from cargolake.plans.catalog import REGISTRY, query
from cargolake.plans.queries_workers import scratch
from cargolake.streaming.indexes import PointIndex, TokenIndex

_ITEMS = ["item_id", "shipment_id", "name", "quantity", "weight"]
_SHIPMENTS = ["shipment_id", "origin", "destination"]


def _now_sql(table: str, changes: str, key: str, columns: list[str]) -> str:
    names = ", ".join(columns)
    return (f"WITH last AS (SELECT {names} FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY change_seq DESC) AS rn FROM {changes}) "
            f"WHERE rn = 1), now AS (SELECT {names} FROM last UNION ALL "
            f"SELECT {names} FROM {table} WHERE {key} NOT IN (SELECT {key} FROM last))")


def _holds(column: str, term: str) -> str:
    return f"list_contains(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'), '{term}')"


def _changed_index(t, rows, changes, key: str, columns: list[str], texts: list[str], name: str) -> TokenIndex:
    """``rows`` after two change sets (new versions of some rows, and new ones), the second applied twice."""
    index = TokenIndex.start(t.spark, scratch(t, name), rows.select(*columns), key, texts)
    for batch, versions in ((0, (1, 3)), (1, (2, 4)), (1, (2, 4))):
        index.apply(batch, changes.where(F.col("change_seq").isin(*versions)).select(*columns))
    return index


@query("P13_indexed_item_search", _now_sql("items", "item_rows", "item_id", _ITEMS) + f"""
SELECT * FROM now WHERE {_holds('name', 'red')} UNION ALL
SELECT * FROM now WHERE {_holds('name', 'v2')} AND {_holds('name', 'red')}""")
def p13_items(t):
    """Of one word, and of two."""
    index = _changed_index(t, t.items, t.item_rows, "item_id", _ITEMS, ["name"], "item-index")
    return index.search("red").unionByName(index.search("V2", "red"))


@query("P13_indexed_place_search", _now_sql("shipments", "shipment_rows", "shipment_id", _SHIPMENTS) + f"""
SELECT * FROM now WHERE {_holds('origin', 'europe')} OR {_holds('destination', 'europe')}""")
def p13_places(t):
    index = _changed_index(t, t.shipments, t.shipment_rows, "shipment_id", _SHIPMENTS, ["origin", "destination"], "place-index")
    return index.search("europe")


@query("P15_indexed_points_in_box", REGISTRY["P15_points_in_box"].oracle)
def p15_box(t):
    """Points of which some arrive later, some were noted elsewhere at first, and some that never were are taken out."""
    points = t.delivery_tracking_points
    elsewhere = (-F.col("latitude")).cast("decimal(10,8)")
    first = points.where("tracking_id % 7 <> 0").withColumn("latitude", F.when(F.col("tracking_id") % 3 == 0, elsewhere).otherwise(F.col("latitude")))
    never = points.where("tracking_id % 5 = 0").withColumn("tracking_id", -F.col("tracking_id") - 1)
    index = PointIndex.start(t.spark, scratch(t, "point-index"), first.unionByName(never), "tracking_id")
    index.apply(0, points.where("tracking_id % 3 = 0"))
    index.apply(1, points.where("tracking_id % 7 = 0"), never.select("tracking_id"))
    return index.box(-10, 45, -30, 60)
