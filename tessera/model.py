"""Schemas of the cell table, its log and its control plane."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _B, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampNTZType()

#: The address of a cell; equality is on the columns, never on a joined string, so separators in names cannot collide.
ADDRESS = ["family", "key", "col"]

CELL = _struct(family=_S, key=_S, col=_S, value=_S)
COMMAND = _struct(seq=_L, op=_S, family=_S, key=_S, col=_S, value=_S)
LOG = _struct(shard=_I, idx=_L, term=_L, op=_S, family=_S, key=_S, col=_S, value=_S)
FLUSH_MARK = _struct(shard=_I, mark=_L)
CATALOG = _struct(table=_S, partitions=_I, replications=_I, version=_L, status=_S, ttl=_L, strategy=_S)
PLACEMENT = _struct(table=_S, replica=_I, partition=_I, node=_L, is_leader=_B, term=_L)
NODE = _struct(node=_L, endpoint=_S)
MIGRATION = _struct(trp=_S, source=_L, target=_L, progress=_D, completed=_B)
FOLLOWER = _struct(shard=_I, follower=_I, next=_L, match=_L)

OPERATIONS = ("GET", "PUT", "DELETE", "BATCH_PUT", "BATCH_GET", "BATCH_DELETE")
MIGRATION_STEPS = {"PENDING": ("LOCKED",), "LOCKED": ("COMMITTING", "ROLLBACK"), "COMMITTING": ("COMPLETED", "ROLLBACK"), "COMPLETED": (), "ROLLBACK": ("PENDING",)}
