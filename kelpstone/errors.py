"""Status codes, and exceptions that carry one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The codes and their names.
STATUS = {
    0: "OK", 1: "Unknown", 2: "InvalidArgument", 3: "DeadlineExceeded", 4: "NotFound", 5: "AlreadyExists", 6: "PermissionDenied", 7: "ResourceExhausted",
    8: "FailedPrecondition", 9: "Aborted", 10: "OutOfRange", 11: "Unimplemented", 12: "Internal", 13: "Unavailable", 14: "DataLoss", 15: "Unauthenticated",
    100: "StorageIoError", 101: "StorageCorruption", 102: "StorageFull", 103: "StorageNotFound",
    200: "RaftNotLeader", 201: "RaftLogCompacted", 202: "RaftElectionInProgress", 203: "RaftTimeout", 204: "RaftInvalidTerm",
    300: "VectorDimensionMismatch", 301: "VectorNotFound", 302: "VectorIndexFull",
    400: "NetworkTimeout", 401: "NetworkUnavailable", 402: "RouterShardNotFound",
}
CODES = {name: code for code, name in STATUS.items()}


class EngineError(Exception):
    def __init__(self, name: str, message: str = ""):
        self.name, self.code = name, CODES[name]
        super().__init__(f"{name}: {message}" if message else name)


def status_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("Unknown Code"))


def status_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATUS.items()), "code int, name string")
