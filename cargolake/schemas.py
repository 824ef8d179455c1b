"""Fixed values that must equal the reference's for right results:
status vocabularies, event/command type lists, thresholds and defaults.
All comparisons of statuses are made after upper(trim()) (contradictions
C1-C4: the reference mixes lower-case enums and upper-case CHECK lists).
"""

from __future__ import annotations

# ---- fixed values: status vocabularies ------------------------------------
SHIPMENT_LIFECYCLE = ("CREATED", "RECEIVED", "READY_FOR_DELIVERY", "IN_TRANSIT", "DELIVERED", "COMPLETED")
SHIPMENT_CHECK = ("PENDING", "IN_TRANSIT", "DELIVERED", "CANCELLED", "DELAYED")
DELIVERY_LIFECYCLE = ("ASSIGNED", "IN_TRANSIT", "DELIVERED", "CONFIRMED")
DELIVERY_CHECK = ("ASSIGNED", "PICKED_UP", "IN_TRANSIT", "DELIVERED", "FAILED", "CANCELLED")
DELIVERY_ACTIVE = ("ASSIGNED", "PICKED_UP", "IN_TRANSIT")
INVENTORY_CHECK = ("RECEIVED", "STORED", "READY_FOR_DELIVERY", "SHIPPED")
SAGA_CHECK = ("STARTED", "COMPENSATING", "COMPLETED", "FAILED", "CANCELLED")
SAGA_ACTIVE = ("STARTED", "COMPENSATING")
SAGA_FINAL = ("COMPLETED", "FAILED", "CANCELLED")
STEP_CHECK = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "COMPENSATING", "COMPENSATED")
STEP_UNFINISHED = ("PENDING", "RUNNING", "COMPENSATING")
SAGA_EVENT_TYPES = ("SAGA_STARTED", "STEP_STARTED", "STEP_COMPLETED", "STEP_FAILED",
                    "COMPENSATION_STARTED", "COMPENSATION_COMPLETED", "SAGA_COMPLETED", "SAGA_FAILED")
TX_STATUS = ("PENDING", "CONFIRMED", "FAILED", "DROPPED")
USER_ROLES = ("admin", "operator", "viewer")

# ---- fixed values: event routing lists -------------------------------------
RECORDER_TARGET_EVENTS = ("shipment.created", "shipment.updated", "delivery.completed", "inventory.released")
COMPENSATION_TRIGGER_EVENTS = ("inventory.insufficient", "delivery.failed", "courier.unassigned",
                               "blockchain.verification_failed")
SAGA_START_EVENTS = ("shipment.created",)

# ---- fixed values: compensation strategies ---------------------------------
# trigger: commands in order, each with its reason (None: the event's own)
COMPENSATION = {
    "delivery.failed": (("courier.unassign", None), ("inventory.release", "Delivery failed rollback"),
                        ("shipment.cancel", "Delivery failed rollback")),
    "courier.unassigned": (("inventory.release", "Courier unassigned rollback"),
                           ("shipment.cancel", "Courier unassigned rollback")),
    "inventory.insufficient": (("shipment.cancel", "Inventory insufficient"),),
}
# command: topic, the saga's id that it is sent to, whether it is sent only where that id is known
COMMAND_TARGETS = {
    "courier.unassign": ("delivery.commands", "delivery_id", True),
    "inventory.release": ("inventory.commands", "warehouse_id", True),
    "shipment.cancel": ("shipment.commands", "shipment_id", False),
}

# ---- fixed values: thresholds ----------------------------------------------
STUCK_SAGA_SECONDS = 600           # 10 minutes
STUCK_TX_SECONDS = 1800            # 30 minutes
STEP_TIMEOUT_SECONDS = 3600
CONFIRMATIONS_REQUIRED = 6
PAGE_DEFAULT, PAGE_MAX = 50, 500
PENDING_BATCH = 50
TOKEN_LIFETIME_DAYS = 30
LATENCY_BUCKETS = (0.01, 0.05, 0.1, 0.3, 0.5, 1.0, 2.0, 5.0)
