"""Traffic and log lines derived from an `events` table by projection only.

Ten personas, chosen by `event_id`, turn each event into one packet, so that the traffic grows with
the table and every rule has something to find. Nothing is shuffled or aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.session import adopt

EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z, start of the event stream


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adopt(spark).read.parquet(f"{sf_dir}/events.parquet")


def _numbered(ev: DataFrame) -> DataFrame:
    return ev.select(
        "event_id",
        "user_id",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
        (F.col("event_id") % 10).alias("persona"),
        (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US).alias("d"),
    )


def packets_from_events(ev: DataFrame, capture: str = "'events'") -> DataFrame:
    """Packets of one capture; `capture` is a SQL expression over the event columns."""
    return _numbered(ev).selectExpr(
        f"{capture} as capture_id",
        "event_id as seq",
        f"""{EPOCH_US} + case persona when 2 then d div 100000 when 3 then d div 1000000
            when 4 then d div 100000 when 5 then d div 10000
            when 6 then event_id * 1000000 + k * 10000 else d div 1000 end as ts_us""",
        """case persona when 0 then '192.168.1.100' when 1 then '192.168.1.101'
            when 2 then concat('172.16.0.', user_id % 15 + 1)
            when 3 then concat('172.16.1.', user_id % 15 + 1)
            when 4 then concat('172.16.2.', user_id % 15 + 1)
            when 5 then concat('10.0.0.', 90 + user_id % 2)
            when 6 then '192.168.1.50' when 7 then '192.168.1.30'
            else concat('192.168.1.', 10 + user_id % 40) end as src_ip""",
        """case persona when 0 then '10.0.0.1' when 1 then concat('10.0.1.', k)
            when 2 then '10.0.0.1' when 3 then '10.0.0.2' when 4 then '10.0.0.3'
            when 5 then '8.8.8.8' when 6 then '198.51.100.1' when 7 then '203.0.113.99'
            else concat('203.0.113.', k + 1) end as dst_ip""",
        """cast(case persona when 4 then 0 when 7 then 50000
            else 49152 + user_id % 1000 end as int) as src_port""",
        """cast(case persona when 0 then k + 1 when 1 then 22 when 2 then 80 when 3 then 9999
            when 4 then 0 when 5 then 53 when 6 then 4444 else 443 end as int) as dst_port""",
        """case persona when 3 then 'UDP' when 4 then 'ICMP' when 5 then 'DNS'
            else 'TCP' end as protocol""",
        """cast(case persona when 7 then 20000 + k * 100 when 5 then 68 + 2 * k
            else 40 + floor(value * 10) end as int) as size""",
        """case when persona in (3, 4, 5) then cast(array() as array<string>)
            when persona in (0, 1, 2) then array('SYN')
            when persona = 6 then array('PSH', 'ACK')
            when persona = 9 and k < 5 then array('FIN', 'PSH', 'URG')
            else array('SYN', 'ACK') end as tcp_flags""",
        """cast(case persona when 5 then 40 + 2 * k when 7 then 20000 + k * 100
            else floor(value * 10) end as int) as payload_size""",
    )


def syslog_lines_from_events(ev: DataFrame, capture: str = "'events'") -> DataFrame:
    """Raw syslog text, one line per event: (capture_id, source_file, seq, line)."""
    return ev.withColumn(
        "t",
        F.timestamp_micros(
            F.expr(
                f"{EPOCH_US} + (unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div 1000"
            )
        ),
    ).selectExpr(
        f"{capture} as capture_id",
        "'syslog' as source_file",
        "named_struct('block', 0L, 'line', event_id) as seq",
        """concat(date_format(t, 'MMM dd HH:mm:ss'), ' host', user_id % 3, ' ', case event_type
            when 'error' then concat('sshd[', 1000 + event_id,
                ']: Failed password for root from 10.99.88.', user_id % 16,
                ' port ', 40000 + event_id % 20000, ' ssh2')
            when 'signup' then concat('nginx: POST /', if(user_id % 2 = 0, 'login', 'auth'),
                '?u=', user_id, ' upstream error from 203.0.113.', user_id % 8)
            when 'purchase' then concat('sshd[', 1000 + event_id,
                ']: Accepted publickey for admin from 192.168.1.10 port ',
                40000 + event_id % 20000, ' ssh2')
            when 'view' then concat('kernel: [', event_id,
                '.5] EXT4-fs warning: mounting unchecked fs')
            else concat('CRON[', event_id, ']: (root) CMD (/usr/bin/check)') end) as line""",
    )


def access_lines_from_events(ev: DataFrame, capture: str = "'events'") -> DataFrame:
    """Raw access-log text, one line per event: (capture_id, source_file, seq, line)."""
    return ev.withColumn(
        "t",
        F.timestamp_micros(
            F.expr(
                f"{EPOCH_US} + (unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div 1000"
            )
        ),
    ).selectExpr(
        f"{capture} as capture_id",
        "'access' as source_file",
        "named_struct('block', 0L, 'line', event_id) as seq",
        """concat('203.0.113.', user_id % 8, ' - - [', date_format(t, 'dd/MMM/yyyy:HH:mm:ss'),
            ' +0100] "', case event_type
            when 'error' then 'GET /../../etc/passwd HTTP/1.1" 403 '
            when 'signup' then 'POST /api/login HTTP/1.1" 503 '
            when 'purchase' then 'GET /wp-admin HTTP/1.1" 404 '
            when 'view' then 'GET /about?page=2 HTTP/1.1" 200 '
            else 'POST /api/login HTTP/1.1" 401 ' end,
            if(event_id % 17 = 0, '-', cast(floor(value * 10) as string)),
            ' "-" "Mozilla/5.0"') as line""",
    )


def frames_from_packets(packets: DataFrame) -> DataFrame:
    """Ethernet frames (capture_id, seq, ts_us, link, frame) with the packets' headers.

    Payloads are zeros, as many as `payload_size`.
    """
    hex_ip = "upper(array_join(transform(split({0}, '[.]'), o -> lpad(hex(cast(o as bigint)), 2, '0')), ''))"
    flags = " + ".join(
        f"if(array_contains(tcp_flags, '{name}'), {bit}, 0)"
        for name, bit in (("FIN", 1), ("SYN", 2), ("RST", 4), ("PSH", 8), ("ACK", 16), ("URG", 32))
    )
    return (
        packets.selectExpr(
            "*",
            "payload_size as body",
            "case protocol when 'TCP' then 20 else 8 end as head",
            "lpad(hex(src_port), 4, '0') as sp",
            "lpad(hex(dst_port), 4, '0') as dp",
        )
        .selectExpr(
            "capture_id",
            "seq",
            "ts_us",
            "1 as link",
            f"""unhex(concat(
                '0000000000000000000000000800',
                '4500', lpad(hex(20 + head + body), 4, '0'), '0000000040',
                case protocol when 'TCP' then '06' when 'ICMP' then '01' else '11' end, '0000',
                {hex_ip.format('src_ip')}, {hex_ip.format('dst_ip')},
                case protocol when 'TCP' then concat(sp, dp, '000000000000000050',
                        lpad(hex({flags}), 2, '0'), '000000000000')
                    when 'ICMP' then '0800000000000000'
                    else concat(sp, dp, lpad(hex(8 + body), 4, '0'), '0000') end,
                repeat('00', body))) as frame""",
        )
    )
