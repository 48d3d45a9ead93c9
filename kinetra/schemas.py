"""Record types as flat schemas; nested messages are flattened when they are read."""

from pyspark.sql import types as T

D, S, I, L, B = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


VECTOR = _fields(x=D, y=D, z=D)
VEHICLE_MESSAGE = _fields(id=S, position=VECTOR, velocity=VECTOR, acceleration=VECTOR, heading=D, size=D, type=S, timestamp=D)
VEHICLE = _fields(id=S, x=D, y=D, z=D, vx=D, vy=D, vz=D, ax=D, ay=D, az=D, heading=D, size=D, type=S, ts=D)
LOCATION_MESSAGE = _fields(vehicle_id=S, timestamp=D, position=VECTOR, velocity=VECTOR, heading=D, vehicle_type=S)
LOCATION = _fields(vehicle_id=S, ts=D, x=D, y=D, z=D, vx=D, vy=D, vz=D, heading=D, vehicle_type=S)
RISK = _fields(risk_id=S, vehicle_id=S, other_vehicle_id=S, time_to_collision=D, distance=D, relative_speed=D, risk_level=D, cx=D, cy=D, cz=D, ts=D, is_predicted=B)
LOOKAHEAD_RISK = _fields(risk_id=S, ts=D, vehicle_id1=S, vehicle_id2=S, risk_level=D, estimated_collision_time=D, px=D, py=D, pz=D, relative_velocity=D, time_to_collision=D)
ALERT = _fields(alert_id=S, vehicle_id=S, other_vehicle_id=S, risk_level=D, time_to_collision=D, message=S, priority=I, ts=D, acknowledged=B)
TASK = _fields(task_id=S, task_type=S, priority=I, data=S, created_at=D, timeout=D)
TASK_RESULT = _fields(task_id=S, success=B, result=S, error=S, processing_time=D, completed_at=D)
NODE = _fields(node_id=S, host=S, port=I, status=S, grid_ids=T.ArrayType(S), load=D, capacity=D)
LOAD = _fields(node_id=S, cpu_usage=D, memory_usage=D, network_usage=D, disk_usage=D, queue_size=L, processing_rate=D, average_latency=D, ts=D)
MESSAGE = _fields(id=S, topic=S, key=S, value=S, headers=T.MapType(S, S), ts=D)
GRID_INFO = _fields(level=I, cx=I, cy=I, cz=I, center_x=D, center_y=D, center_z=D, size=D, vehicle_count=L, density=D)
SHARD = _fields(shard_id=I, node_id=S, vehicle_count=L, load=D, created_at=D)
PERFORMANCE = _fields(timestamp=D, throughput=D, avg_latency=D, p95_latency=D, p99_latency=D, max_latency=D, error_rate=D, cpu_usage=D, memory_usage=D)
