"""Record types and the fixed tables that queries and operators look things up in."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

PAYLOAD = T.StructType([
    T.StructField("task_id", _S), T.StructField("vehicle_id", _S), T.StructField("event", _S), T.StructField("note", _S),
    T.StructField("origin", T.ArrayType(_D)), T.StructField("destination", T.ArrayType(_D)), T.StructField("origin_hub", _S), T.StructField("destination_hub", _S),
    T.StructField("priority", T.IntegerType()), T.StructField("payload_kg", _D), T.StructField("created_ms", _L), T.StructField("deadline_ms", _L),
    T.StructField("score", _D), T.StructField("silent_ms", _L),
])
JOURNAL = T.StructType([
    T.StructField("seq", _L), T.StructField("kind", _S), T.StructField("subject", _S), T.StructField("at_ms", _L),
    T.StructField("payload", PAYLOAD), T.StructField("trace_id", _S), T.StructField("span_id", _S), T.StructField("origin", _S),
])
MESSAGE = T.StructType([
    T.StructField("topic", _S), T.StructField("partition", _L), T.StructField("offset", _L), T.StructField("key", _S), T.StructField("msg_id", _S),
    T.StructField("payload", _S), T.StructField("headers", T.MapType(_S, _S)), T.StructField("created_at_ms", _L), T.StructField("attempt", _L),
])

#: Legal moves (from, event, to). QUEUE and RESUME stand for the top of the queue and pause stacks.
QUEUE, RESUME = "*QUEUE", "*RESUME"
TASK_MOVES = [
    ("PENDING", "ASSIGN", "ASSIGNED"), ("PENDING", "CANCEL", "CANCELLED"), ("PENDING", "FAIL", "FAILED"),
    ("ASSIGNED", "DISPATCH", "ENROUTE"), ("ASSIGNED", "START", "EXECUTING"), ("ASSIGNED", "ENQUEUE", "QUEUED"), ("ASSIGNED", "PAUSE", "PAUSED"), ("ASSIGNED", "REQUEUE", "PENDING"), ("ASSIGNED", "CANCEL", "CANCELLED"), ("ASSIGNED", "FAIL", "FAILED"),
    ("ENROUTE", "ENQUEUE", "QUEUED"), ("ENROUTE", "START", "EXECUTING"), ("ENROUTE", "PAUSE", "PAUSED"), ("ENROUTE", "REQUEUE", "PENDING"), ("ENROUTE", "CANCEL", "CANCELLED"), ("ENROUTE", "FAIL", "FAILED"),
    ("QUEUED", "PROCEED", QUEUE), ("QUEUED", "PAUSE", "PAUSED"), ("QUEUED", "REQUEUE", "PENDING"), ("QUEUED", "CANCEL", "CANCELLED"), ("QUEUED", "FAIL", "FAILED"),
    ("EXECUTING", "COMPLETE", "COMPLETED"), ("EXECUTING", "ENQUEUE", "QUEUED"), ("EXECUTING", "PAUSE", "PAUSED"), ("EXECUTING", "REQUEUE", "PENDING"), ("EXECUTING", "CANCEL", "CANCELLED"), ("EXECUTING", "FAIL", "FAILED"),
    ("PAUSED", "RESUME", "RECOVERING"), ("PAUSED", "REQUEUE", "PENDING"), ("PAUSED", "CANCEL", "CANCELLED"), ("PAUSED", "FAIL", "FAILED"),
    ("RECOVERING", "RECOVER", RESUME), ("RECOVERING", "REQUEUE", "PENDING"), ("RECOVERING", "CANCEL", "CANCELLED"), ("RECOVERING", "FAIL", "FAILED"),
]
VEHICLE_MOVES = [
    ("OFFLINE", "ONLINE", "IDLE"),
    ("IDLE", "ASSIGN", "ASSIGNED"), ("IDLE", "CHARGE", "CHARGING"), ("IDLE", "FAULT", "FAULT"), ("IDLE", "MAINTAIN", "MAINTENANCE"), ("IDLE", "HEARTBEAT_TIMEOUT", "OFFLINE"),
    ("ASSIGNED", "DISPATCH", "ENROUTE"), ("ASSIGNED", "ENQUEUE", "QUEUED"), ("ASSIGNED", "RELEASE", "IDLE"), ("ASSIGNED", "PAUSE", "PAUSED"), ("ASSIGNED", "FAULT", "FAULT"), ("ASSIGNED", "HEARTBEAT_TIMEOUT", "OFFLINE"),
    ("ENROUTE", "ENQUEUE", "QUEUED"), ("ENROUTE", "START", "EXECUTING"), ("ENROUTE", "RELEASE", "IDLE"), ("ENROUTE", "PAUSE", "PAUSED"), ("ENROUTE", "FAULT", "FAULT"), ("ENROUTE", "HEARTBEAT_TIMEOUT", "OFFLINE"),
    ("QUEUED", "PROCEED", QUEUE), ("QUEUED", "START", "EXECUTING"), ("QUEUED", "RELEASE", "IDLE"), ("QUEUED", "PAUSE", "PAUSED"), ("QUEUED", "FAULT", "FAULT"), ("QUEUED", "HEARTBEAT_TIMEOUT", "OFFLINE"),
    ("EXECUTING", "COMPLETE", "IDLE"), ("EXECUTING", "ENQUEUE", "QUEUED"), ("EXECUTING", "RELEASE", "IDLE"), ("EXECUTING", "PAUSE", "PAUSED"), ("EXECUTING", "FAULT", "FAULT"), ("EXECUTING", "HEARTBEAT_TIMEOUT", "OFFLINE"),
    ("PAUSED", "RESUME", "RECOVERING"), ("PAUSED", "RELEASE", "IDLE"), ("PAUSED", "FAULT", "FAULT"), ("PAUSED", "HEARTBEAT_TIMEOUT", "OFFLINE"),
    ("RECOVERING", "RECOVER", RESUME), ("RECOVERING", "RELEASE", "IDLE"), ("RECOVERING", "FAULT", "FAULT"), ("RECOVERING", "HEARTBEAT_TIMEOUT", "OFFLINE"),
    ("CHARGING", "CHARGE_DONE", "IDLE"), ("CHARGING", "FAULT", "FAULT"), ("CHARGING", "HEARTBEAT_TIMEOUT", "OFFLINE"),
    ("FAULT", "REPAIR", "MAINTENANCE"), ("FAULT", "RECOVER", "IDLE"), ("FAULT", "HEARTBEAT_TIMEOUT", "OFFLINE"),
    ("MAINTENANCE", "REPAIR_DONE", "IDLE"),
]
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
#: The vehicle event that an accepted task event brings about; what frees the vehicle.
TASK_TO_VEHICLE = {"ASSIGN": "ASSIGN", "DISPATCH": "DISPATCH", "ENQUEUE": "ENQUEUE", "PROCEED": "PROCEED", "START": "START", "PAUSE": "PAUSE", "RESUME": "RESUME", "RECOVER": "RECOVER", "COMPLETE": "COMPLETE", "CANCEL": "RELEASE", "FAIL": "RELEASE", "REQUEUE": "RELEASE"}
FREES = ("COMPLETE", "CANCEL", "FAIL", "REQUEUE")

#: Priorities, score weights, limits, alert rules (metric, rule, threshold, severity, cooldown ms), hubs, roads.
PRIORITY_LABELS = {1: "LOW", 2: "NORMAL", 3: "HIGH", 4: "URGENT", 5: "CRITICAL"}
WEIGHTS = {"priority": 1000.0, "idle": 50.0, "battery": 0.5, "distance": 1.0, "aging": 0.02}
BATTERY_FLOOR, HEARTBEAT_TIMEOUT_MS, MAX_RETRIES, PARTITIONS, LAG_LIMIT, CACHE_TTL_S, REORDER_WINDOW = 20.0, 5000, 3, 4, 200, 30, 64
PREEMPT_FROM, PREEMPT_MOST, CONGESTION = 3, 2, 260.0
ALERT_RULES = [("bus_backlog", 50.0, "WARNING", 2_000), ("vehicle_offline", 5_000.0, "CRITICAL", 20_000), ("task_timeout", 120_000.0, "WARNING", 300_000), ("dead_letter_depth", 0.0, "ERROR", 5_000)]
HUBS = [("A", 60.0, 60.0), ("B", 300.0, 60.0), ("C", 540.0, 60.0), ("D", 60.0, 340.0), ("E", 300.0, 340.0), ("F", 540.0, 340.0)]
ROADS = [("A", "B"), ("B", "C"), ("A", "D"), ("D", "E"), ("E", "F"), ("C", "F"), ("B", "E")]
