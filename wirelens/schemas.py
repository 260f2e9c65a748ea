"""Record schemas and the checks that stand in for enumerated types.

Packets and log entries carry `ts_us` (microseconds since the epoch, UTC) as the comparison key.
`seq` is the arrival order inside a capture or log. Lists of addresses are kept in long form
(`MEMBERS`), because one flood alert may name millions of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the record formats.
FLAG_NAMES = {"S": "SYN", "A": "ACK", "R": "RST", "F": "FIN", "P": "PSH", "U": "URG"}
LOG_SEVERITIES = ["critical", "high", "medium", "low", "info"]
ALERT_SEVERITIES = ["critical", "high", "medium", "low"]
CATEGORIES = [
    "PORT_SCAN",
    "DDOS_ATTACK",
    "BRUTE_FORCE",
    "SUSPICIOUS_CONNECTION",
    "DNS_TUNNELING",
    "ANOMALOUS_TRAFFIC",
]
DETECTION_METHODS = ["rule", "ml", "both"]

PACKETS = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("tcp_flags", T.ArrayType(T.StringType())),
        T.StructField("payload_size", T.IntegerType()),
    ]
)

ARRIVAL = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("line", T.LongType())]
)

LOGS = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("seq", ARRIVAL),
        T.StructField("log_format", T.StringType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("raw_line", T.StringType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("alert_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("rule_ord", T.IntegerType()),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("n_source_ips", T.LongType()),
        T.StructField("source_set", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("n_dest_ips", T.LongType()),
        T.StructField("first_us", T.LongType()),
        T.StructField("last_us", T.LongType()),
        T.StructField("evidence", T.StringType()),
    ]
)

MEMBERS = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("alert_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def with_packet_defaults(df: DataFrame) -> DataFrame:
    """Fill the optional fields: no flags and payload 0."""
    return df.withColumns(
        {
            "tcp_flags": F.coalesce("tcp_flags", F.array().cast("array<string>")),
            "payload_size": F.coalesce("payload_size", F.lit(0)),
        }
    )


def packet_problem() -> Column:
    """First violated expectation of a packet row, NULL for a valid row."""
    required = ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "size"]
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in required]
    return F.coalesce(*checks)


def log_problem() -> Column:
    missing = [
        F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in ("source_ip", "message", "severity")
    ]
    return F.coalesce(
        *missing, F.when(~F.col("severity").isin(LOG_SEVERITIES), F.lit("severity unknown"))
    )


def alert_problem() -> Column:
    return F.coalesce(
        F.when(F.col("rule_name").isNull(), F.lit("rule_name missing")),
        F.when(
            F.col("severity").isNull() | ~F.col("severity").isin(ALERT_SEVERITIES),
            F.lit("severity unknown"),
        ),
    )


def threat_problem() -> Column:
    return F.coalesce(
        F.when(
            F.col("category").isNull() | ~F.col("category").isin(CATEGORIES),
            F.lit("category unknown"),
        ),
        F.when(
            F.col("severity_score").isNull() | ~F.col("severity_score").between(0, 100),
            F.lit("severity_score out of bounds"),
        ),
        F.when(
            F.col("severity_label").isNull() | ~F.col("severity_label").isin(ALERT_SEVERITIES),
            F.lit("severity_label unknown"),
        ),
        F.when(
            F.col("detection_method").isNull()
            | ~F.col("detection_method").isin(DETECTION_METHODS),
            F.lit("detection_method unknown"),
        ),
    )


def validate(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Split into valid rows and rejected rows with a `problem` column."""
    checked = df.withColumn("problem", problem)
    return (
        checked.filter(F.col("problem").isNull()).drop("problem"),
        checked.filter(F.col("problem").isNotNull()),
    )
