"""The tables a threat report is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.functions.text import grouped
from wirelens.operators.classify import recommendations
from wirelens.schemas import ALERT_SEVERITIES

# Fixed value: the label shown when there is no category.
NO_CATEGORY = "N/A"


def severity_counts(threats: DataFrame) -> DataFrame:
    """Totals per capture and label."""
    return threats.groupBy("capture_id").agg(
        F.count("*").alias("total_threats"),
        *[
            F.count_if(F.col("severity_label") == label).alias(f"{label}_count")
            for label in ALERT_SEVERITIES
        ],
    )


def top_category(threats: DataFrame, captures: DataFrame) -> DataFrame:
    """Most frequent category per capture; ties go to the one ranked first, none gives N/A."""
    place = F.concat(
        F.lpad((100 - F.col("severity_score")).cast("string"), 3, "0"), "group_key", "open_key"
    )
    counts = threats.groupBy("capture_id", "category").agg(
        F.count("*").alias("n"), F.min(place).alias("place")
    )
    best = counts.withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy("capture_id").orderBy(F.desc("n"), "place")
        ),
    ).filter("rank = 1")
    return (
        captures.select("capture_id")
        .join(best, "capture_id", "left")
        .select("capture_id", F.coalesce("category", F.lit(NO_CATEGORY)).alias("top_category"))
    )


def executive_facts(threats: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per capture: totals, top category, and the summary sentence."""
    counts = severity_counts(threats)
    zero = {c: 0 for c in counts.columns if c != "capture_id"}
    facts = (
        summary.join(counts, "capture_id", "left")
        .fillna(zero)
        .join(top_category(threats, summary), "capture_id")
    )
    sentence = F.format_string(
        "Analysis of %s packets over %s identified %d threats (%d critical, %d high). "
        "%s was the most prevalent threat category.",
        grouped("packet_count"),
        "time_range",
        "total_threats",
        "critical_count",
        "high_count",
        "top_category",
    )
    return facts.select(
        "capture_id",
        "packet_count",
        "time_range",
        "total_threats",
        "critical_count",
        "high_count",
        "medium_count",
        "low_count",
        "top_category",
        sentence.alias("sentence"),
    )


def first_sources(members: DataFrame, k: int) -> DataFrame:
    """The k first source addresses per threat; the limit is applied before the shuffle too."""
    place = Window.partitionBy("capture_id", "threat_id").orderBy("value")
    return (
        members.filter(F.col("role") == "source_ip")
        .withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= k)
        .groupBy("capture_id", "threat_id")
        .agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("first_ips"))
    )


def threat_table(
    threats: DataFrame,
    members: DataFrame,
    show_ips: int = 3,
    title_length: int | None = None,
    severities: list[str] | None = None,
) -> DataFrame:
    """Rows as shown in a report: label, category, title, first addresses, method.

    The compact form shows two addresses and cuts titles longer than 33 characters to 30. With
    `severities` only those labels are listed.
    """
    shown = threats if severities is None else threats.filter(
        F.col("severity_label").isin(severities)
    )
    title = F.col("title")
    if title_length is not None:
        title = F.when(
            F.length("title") > title_length,
            F.concat(F.substring("title", 1, title_length - 3), F.lit("...")),
        ).otherwise(title)
    more = F.col("n_source_ips") - show_ips
    ips = F.concat(
        F.coalesce("first_ips", F.lit("")),
        F.when(more > 0, F.format_string(" (+%d)", more)).otherwise(""),
    )
    return shown.join(
        first_sources(members, show_ips), ["capture_id", "threat_id"], "left"
    ).select(
        "capture_id",
        "threat_id",
        F.upper("severity_label").alias("severity"),
        "category",
        title.alias("title"),
        ips.alias("source_ips"),
        F.col("detection_method").alias("detection"),
        "severity_score",
        "group_key",
        "open_key",
    )


def compact_threat_table(threats: DataFrame, members: DataFrame) -> DataFrame:
    return threat_table(threats, members, show_ips=2, title_length=33)


def source_listing(threats: DataFrame, members: DataFrame) -> DataFrame:
    """Every source address of every threat, one row each; `N/A` for a threat without one."""
    sources = members.filter(F.col("role") == "source_ip").select(
        "capture_id", "threat_id", F.col("value").alias("ip")
    )
    return threats.join(sources, ["capture_id", "threat_id"], "left").select(
        "capture_id",
        "threat_id",
        F.upper("severity_label").alias("severity"),
        "category",
        "title",
        F.coalesce("ip", F.lit(NO_CATEGORY)).alias("source_ip"),
        F.col("detection_method").alias("detection"),
    )


def prioritised_recommendations(threats: DataFrame) -> DataFrame:
    """Recommendations numbered by severity, each once, at its first occurrence."""
    label_rank = F.array_position(
        F.array(*[F.lit(s) for s in ALERT_SEVERITIES]), F.col("severity_label")
    )
    # Threats of one category and label recommend the same; only the first of each matters.
    place = F.concat(
        F.lpad((100 - F.col("severity_score")).cast("string"), 3, "0"), "group_key", "open_key"
    )
    firsts = threats.groupBy("capture_id", "category", "severity_label").agg(
        F.min(place).alias("place")
    )
    rows = firsts.select(
        "capture_id",
        "severity_label",
        label_rank.alias("rank"),
        "place",
        F.posexplode(recommendations("category")).alias("pos", "recommendation"),
    )
    once = rows.withColumn(
        "seen",
        F.row_number().over(
            Window.partitionBy("capture_id", "recommendation").orderBy("rank", "place", "pos")
        ),
    ).filter("seen = 1")
    number = F.row_number().over(
        Window.partitionBy("capture_id").orderBy("rank", "place", "pos")
    )
    return once.select(
        "capture_id",
        number.cast("bigint").alias("number"),
        F.upper("severity_label").alias("priority"),
        "recommendation",
    )


def top_threats(threats: DataFrame, k: int = 10) -> DataFrame:
    """Details of the k first threats of each capture."""
    order = Window.partitionBy("capture_id").orderBy(
        F.desc("severity_score"), "group_key", "open_key"
    )
    return (
        threats.withColumn("number", F.row_number().over(order))
        .filter(F.col("number") <= k)
        .select(
            "capture_id",
            F.col("number").cast("bigint").alias("number"),
            "threat_id",
            "title",
            "description",
            "severity_score",
            "time_range",
        )
    )
