"""DuckDB statements that give the same rows as the registered queries, straight from the tables.

Each statement is put together from common table expressions (CTEs); `statement` adds those that a
body needs, with everything they need in turn.
"""

from __future__ import annotations

import re

EPOCH_US = 1704067200000000

CTES: dict[str, str] = {}

CTES["numbered"] = f"""
select event_id, user_id, value, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k,
       event_id % 10 persona, epoch_us(ts) - {EPOCH_US} d
from events"""

CTES["packets"] = f"""
select 'events' as capture_id, event_id as seq,
  {EPOCH_US} + case persona when 2 then d//100000 when 3 then d//1000000 when 4 then d//100000
    when 5 then d//10000 when 6 then event_id*1000000 + k*10000 else d//1000 end as ts_us,
  case persona when 0 then '192.168.1.100' when 1 then '192.168.1.101'
    when 2 then '172.16.0.'||(user_id%15+1) when 3 then '172.16.1.'||(user_id%15+1)
    when 4 then '172.16.2.'||(user_id%15+1) when 5 then '10.0.0.'||(90+user_id%2)
    when 6 then '192.168.1.50' when 7 then '192.168.1.30'
    else '192.168.1.'||(10+user_id%40) end as src_ip,
  case persona when 0 then '10.0.0.1' when 1 then '10.0.1.'||k when 2 then '10.0.0.1'
    when 3 then '10.0.0.2' when 4 then '10.0.0.3' when 5 then '8.8.8.8'
    when 6 then '198.51.100.1' when 7 then '203.0.113.99' else '203.0.113.'||(k+1) end as dst_ip,
  cast(case persona when 4 then 0 when 7 then 50000 else 49152+user_id%1000 end as int) as src_port,
  cast(case persona when 0 then k+1 when 1 then 22 when 2 then 80 when 3 then 9999 when 4 then 0
    when 5 then 53 when 6 then 4444 else 443 end as int) as dst_port,
  case persona when 3 then 'UDP' when 4 then 'ICMP' when 5 then 'DNS' else 'TCP' end as protocol,
  cast(case persona when 7 then 20000+k*100 when 5 then 68+2*k
    else 40+floor(value*10) end as int) as size,
  cast(case when persona in (3,4,5) then [] when persona in (0,1,2) then ['SYN']
    when persona=6 then ['PSH','ACK'] when persona=9 and k<5 then ['FIN','PSH','URG']
    else ['SYN','ACK'] end as varchar[]) as tcp_flags,
  cast(case persona when 5 then 40+2*k when 7 then 20000+k*100
    else floor(value*10) end as int) as payload_size
from numbered"""

CTES["line_times"] = f"""
select event_id, user_id, event_type, value,
       make_timestamp({EPOCH_US} + (epoch_us(ts) - {EPOCH_US})//1000) t
from events"""

CTES["syslog_lines"] = """
select event_id as line_no,
  strftime(t,'%b %d %H:%M:%S')||' host'||(user_id%3)||' '||case event_type
  when 'error' then 'sshd['||(1000+event_id)||']: Failed password for root from 10.99.88.'
    ||(user_id%16)||' port '||(40000+event_id%20000)||' ssh2'
  when 'signup' then 'nginx: POST /'||case when user_id%2=0 then 'login' else 'auth' end
    ||'?u='||user_id||' upstream error from 203.0.113.'||(user_id%8)
  when 'purchase' then 'sshd['||(1000+event_id)
    ||']: Accepted publickey for admin from 192.168.1.10 port '||(40000+event_id%20000)||' ssh2'
  when 'view' then 'kernel: ['||event_id||'.5] EXT4-fs warning: mounting unchecked fs'
  else 'CRON['||event_id||']: (root) CMD (/usr/bin/check)' end as line
from line_times"""

CTES["access_lines"] = """
select event_id as line_no,
  '203.0.113.'||(user_id%8)||' - - ['||strftime(t,'%d/%b/%Y:%H:%M:%S')||' +0100] "'||case event_type
  when 'error' then 'GET /../../etc/passwd HTTP/1.1" 403 '
  when 'signup' then 'POST /api/login HTTP/1.1" 503 '
  when 'purchase' then 'GET /wp-admin HTTP/1.1" 404 '
  when 'view' then 'GET /about?page=2 HTTP/1.1" 200 '
  else 'POST /api/login HTTP/1.1" 401 ' end
  ||case when event_id%17=0 then '-' else cast(cast(floor(value*10) as bigint) as varchar) end
  ||' "-" "Mozilla/5.0"' as line
from line_times"""

# The line formats, as the library reads them.
SYSLOG_RE = r"^(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[\d+\])?\s*:\s*(.*)"
ACCESS_RE = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(\d+)'
IPV4_RE = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"

CTES["syslog_fields"] = f"""
select line_no, line,
  regexp_extract(line, '{SYSLOG_RE}', 1) ts_raw, regexp_extract(line, '{SYSLOG_RE}', 2) host,
  regexp_extract(line, '{SYSLOG_RE}', 3) service, regexp_extract(line, '{SYSLOG_RE}', 4) message
from syslog_lines where regexp_matches(line, '{SYSLOG_RE}')"""

CTES["logs"] = f"""
select 'events' as capture_id, 'syslog' as source_file, 'syslog' as log_format, line_no, ts_raw,
  epoch_us(strptime('2024 '||ts_raw, '%Y %b %d %H:%M:%S')) as ts_us,
  coalesce(nullif(regexp_extract(message, '{IPV4_RE}', 0), ''), host) as source_ip, message,
  case when contains(lower(message),'segfault') or contains(lower(message),'kernel panic')
      then 'critical'
    when contains(lower(message),'failed password')
      or contains(lower(message),'authentication failure') then 'high'
    when contains(lower(message),'error') then 'medium'
    when contains(lower(message),'warning') then 'low' else 'info' end as severity,
  service, line as raw_line
from syslog_fields"""

CTES["access_logs"] = f"""
with f as (select line_no, line,
  regexp_extract(line, '{ACCESS_RE}', 1) ip, regexp_extract(line, '{ACCESS_RE}', 2) ts_raw,
  regexp_extract(line, '{ACCESS_RE}', 3) method, regexp_extract(line, '{ACCESS_RE}', 4) path,
  regexp_extract(line, '{ACCESS_RE}', 5) status
  from access_lines where regexp_matches(line, '{ACCESS_RE}'))
select 'events' as capture_id, 'access' as source_file, 'apache' as log_format, line_no, ts_raw,
  epoch_us(strptime(regexp_extract(ts_raw, '^[^ ]+'), '%d/%b/%Y:%H:%M:%S'))
    - 3600000000 as ts_us,
  ip as source_ip, method||' '||path||' → '||status as message,
  case when contains(path,'..') or contains(path,'etc/passwd') or contains(path,'etc/shadow')
      then 'high'
    when starts_with(status,'5') then 'medium'
    when status in ('403','404') and (contains(path,'/admin') or contains(path,'/wp-admin')
      or contains(path,'/phpmyadmin') or contains(path,'/.env') or contains(path,'/config'))
      then 'low'
    else 'info' end as severity,
  'httpd' as service, line as raw_line
from f"""

CTES["all_logs"] = "select * from logs union all select * from access_logs"


def iso(us: str) -> str:
    """SQL text of the ISO form of a microsecond column."""
    return (
        f"(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S')"
        f" || case when ({us}) % 1000000 <> 0 then '.' || strftime(make_timestamp({us}), '%f')"
        f" else '' end || '+00:00')"
    )


CTES["flows"] = """
select capture_id, src_ip, dst_ip, src_port, dst_port, protocol, count(*) as packet_count,
  cast(sum(size) as bigint) as total_bytes, min(ts_us) as start_us, max(ts_us) as end_us,
  (max(ts_us) - min(ts_us)) / 1e6 as duration_seconds
from packets group by all"""

CTES["origins"] = "select capture_id, min(ts_us) origin_us, max(ts_us) end_us from packets group by 1"


def greedy(keys: list[str], item: str, more_than: int, name: str) -> None:
    """Greedy windows by a recursive walk over the raw packets of every key."""
    cols = ", ".join(keys)
    same = " and ".join(f"p.{k} = w.{k}" for k in keys)
    CTES[f"{name}_walk"] = f"""
        with recursive walk as (
          select {cols}, min(ts_us) as o from packets group by all
          union all
          select {', '.join('w.' + k for k in keys)}, min(p.ts_us) as o
          from walk w join packets p on {same} and p.ts_us > w.o + 60000000
          group by {', '.join('w.' + k for k in keys)}
        ) select * from walk"""
    CTES[name] = f"""
        select {', '.join('p.' + k for k in keys)}, w.o as open_us, max(p.ts_us) as close_us,
          count(distinct p.{item}) as items, min(p.{item}) as first_item
        from packets p asof join {name}_walk w on {same} and p.ts_us >= w.o
        group by all having count(distinct p.{item}) > {more_than}"""


greedy(["capture_id", "src_ip", "dst_ip"], "dst_port", 20, "vertical_windows")
greedy(["capture_id", "src_ip", "dst_port"], "dst_ip", 10, "horizontal_windows")


def alert(
    rule, severity, category, key, description, source, n_source, dest, n_dest, first, last, evidence, body
) -> str:
    fields = ", ".join(f"'{k}': {v}" for k, v in evidence.items())
    return f"""
        select capture_id, concat_ws('|', '{rule}', {', '.join(key)}) as alert_id,
          '{rule}' as rule_name, '{severity}' as severity, '{category}' as category,
          {description} as description, {source} as source_ip,
          cast({n_source} as bigint) as n_source_ips, {dest} as dest_ip,
          cast({n_dest} as bigint) as n_dest_ips, {first} as first_us, {last} as last_us,
          cast(to_json({{{fields}}}) as varchar) as evidence
        from {body}"""


CTES["vertical_port_scan"] = alert(
    "vertical_port_scan", "high", "PORT_SCAN", ["src_ip", "dst_ip", "open_us"],
    "format('Vertical port scan from {} to {}: {} ports in {:.0f}s', src_ip, dst_ip, items,"
    " (close_us - open_us) / 1e6)",
    "src_ip", 1, "dst_ip", 1, "open_us", "close_us",
    {"scan_type": "'vertical'", "ports_scanned": "items", "target": "dst_ip",
     "duration_seconds": "(close_us - open_us) / 1e6"},
    "vertical_windows",
)
CTES["horizontal_port_scan"] = alert(
    "horizontal_port_scan", "high", "PORT_SCAN", ["src_ip", "dst_port", "open_us"],
    "format('Horizontal scan from {} on port {}: {} targets', src_ip, dst_port, items)",
    "src_ip", 1, "first_item", "items", "open_us", "close_us",
    {"scan_type": "'horizontal'", "targets_scanned": "items", "port": "dst_port"},
    "horizontal_windows",
)

SYN_ONLY = "(list_contains(tcp_flags,'SYN') and not list_contains(tcp_flags,'ACK'))"
XMAS = "(list_contains(tcp_flags,'FIN') and list_contains(tcp_flags,'PSH') and list_contains(tcp_flags,'URG'))"
IS_DNS = "(upper(protocol) = 'DNS' or dst_port = 53)"

CTES["syn_scan"] = alert(
    "syn_scan", "medium", "PORT_SCAN", ["src_ip"],
    "format('SYN scan from {}: {:.0f}% SYN-only packets ({} total)', src_ip, ratio * 100, n)",
    "src_ip", 1, "d", "nd", "f", "l",
    {"scan_type": "'syn'", "syn_ratio": "cast(format('{:.3f}', ratio) as double)", "packet_count": "n"},
    f"""(select capture_id, src_ip, count(*) n, count_if{SYN_ONLY} / count(*) as ratio,
         min(dst_ip) d, count(distinct dst_ip) nd, min_by(ts_us, seq) f, max_by(ts_us, seq) l
         from packets where upper(protocol) = 'TCP' group by all
         having count(*) > 20 and count_if{SYN_ONLY} / count(*) > 0.8)""",
)
CTES["xmas_scan"] = alert(
    "xmas_scan", "high", "PORT_SCAN", ["src_ip"],
    "format('XMAS scan from {}: {} packets with FIN+PSH+URG', src_ip, n)",
    "src_ip", 1, "d", "nd", "f", "l", {"scan_type": "'xmas'", "packet_count": "n"},
    f"""(select capture_id, src_ip, count(*) n, min(dst_ip) d, count(distinct dst_ip) nd,
         min_by(ts_us, seq) f, max_by(ts_us, seq) l from packets where {XMAS} group by all)""",
)


def flood(kind: str, severity: str, test: str, packets: int, sources: int) -> None:
    unit = "req/s" if kind == "http" else "pkt/s"
    tail = " from {} sources" if kind in ("syn", "http") else ""
    extra = ", ns" if tail else ""
    evidence = {"flood_type": f"'{kind}'"}
    evidence["request_rate" if kind == "http" else "packets_per_second"] = "rate"
    if tail:
        evidence["source_count"] = "ns"
    if kind != "http":
        evidence["target"] = "dst_ip"
    CTES[f"{kind}_flood"] = alert(
        f"{kind}_flood", severity, "DDOS_ATTACK", ["dst_ip", "start_us"],
        f"format('{kind.upper()} flood targeting {{}}: {{}} {unit}{tail}', dst_ip, rate{extra})",
        "s", "ns", "dst_ip", 1, "start_us", "start_us", evidence,
        f"""(select capture_id, dst_ip, origin_us + b * 10000000 as start_us, n / 10 as rate, s, ns
             from (select capture_id, origin_us, (ts_us - origin_us) // 10000000 as b, dst_ip,
                     count(*) n, count(distinct src_ip) ns, min(src_ip) s
                   from packets join origins using (capture_id) where {test} group by all)
             where n > {packets} and ns > {sources})""",
    )


flood("syn", "critical", SYN_ONLY, 100, 5)
flood("udp", "critical", "upper(protocol) = 'UDP'", 500, 0)
flood("icmp", "high", "upper(protocol) = 'ICMP'", 50, 0)
flood("http", "critical", "dst_port in (80, 443)", 100, 5)


def bursts(name: str, body: str, key: str, at_least: int) -> None:
    """First event whose following inclusive minute holds enough events."""
    CTES[name] = f"""
        select capture_id, {key}, min_by(n, ts_us) n, min(ts_us) t0, min_by(e, ts_us) t1 from (
          select capture_id, {key}, ts_us, count(*) over w as n, max(ts_us) over w as e
          from ({body}) where ts_us is not null window w as (partition by capture_id, {key} order by ts_us
            range between current row and 60000000 following))
        where n >= {at_least} group by all"""


CTES["ssh_entries"] = "select * from logs where contains(lower(service),'ssh') and severity='high'"
CTES["login_entries"] = """
select *, case when regexp_matches(message, '(^|\\s)/') then
    regexp_extract(message, '(?:^|\\s)(/[^\\s?]*)', 1) else '/unknown' end as path
from logs where contains(message,'POST')
  and (contains(lower(message),'login') or contains(lower(message),'auth')) and severity <> 'info'"""
bursts("ssh_bursts", "select * from ssh_entries", "source_ip", 5)
bursts("login_bursts", "select * from login_entries", "source_ip", 10)
CTES["dns_packets"] = f"select * from packets where {IS_DNS}"
bursts("dns_bursts", "select * from dns_packets", "src_ip", 101)

CTES["ssh_brute_force"] = alert(
    "ssh_brute_force", "high", "BRUTE_FORCE", ["source_ip"],
    "format('SSH brute force from {}: {} failed attempts in {:.0f}s', source_ip, n, (t1 - t0) / 1e6)",
    "source_ip", 1, "cast(null as varchar)", 0, "f", "l",
    {"attack_type": "'ssh'", "attempts": "n", "duration_seconds": "(t1 - t0) / 1e6",
     "target_service": "'sshd'"},
    """(select capture_id, source_ip, n, t0, t1, min_by(ts_us, line_no) f, max_by(ts_us, line_no) l
        from ssh_entries join ssh_bursts using (capture_id, source_ip) group by all)""",
)
CTES["http_brute_force"] = alert(
    "http_brute_force", "high", "BRUTE_FORCE", ["source_ip"],
    "format('HTTP login brute force from {}: {} attempts', source_ip, n)",
    "source_ip", 1, "cast(null as varchar)", 0, "f", "l",
    {"attack_type": "'http_login'", "attempts": "n", "paths_targeted": "paths"},
    """(select capture_id, source_ip, n, count(distinct path) paths, min_by(ts_us, line_no) f,
          max_by(ts_us, line_no) l
        from login_entries join login_bursts using (capture_id, source_ip)
        group by capture_id, source_ip, n, t0, t1)""",
)
CTES["port_matches"] = """
select capture_id, seq, ts_us, src_ip, dst_ip, unnest([dst_port, src_port]) as port from packets"""
CTES["malicious_port"] = alert(
    "malicious_port", "high", "SUSPICIOUS_CONNECTION", ["port"],
    "format('Traffic on suspicious port {}: {} packets', port, n)",
    "s", "ns", "d", "nd", "f", "l",
    {"detection_type": "'malicious_port'", "port": "port", "connections": "n"},
    """(select capture_id, port, count(*) n, min(src_ip) s, count(distinct src_ip) ns,
          min(dst_ip) d, count(distinct dst_ip) nd, min_by(ts_us, seq) f, max_by(ts_us, seq) l
        from port_matches where port in (4444, 5555, 8888, 1337, 31337, 6667, 6697) group by all)""",
)
CTES["beaconing"] = alert(
    "beaconing", "critical", "SUSPICIOUS_CONNECTION", ["src_ip", "dst_ip"],
    "format('Potential C2 beaconing: {} -> {} (avg interval {:.1f}s, std {:.1f}s)',"
    " src_ip, dst_ip, mean, std)",
    "src_ip", 1, "dst_ip", 1, "f", "l",
    {"detection_type": "'beaconing'",
     "avg_interval_seconds": "cast(format('{:.2f}', mean) as double)",
     "std_deviation": "cast(format('{:.2f}', std) as double)", "beacon_count": "n"},
    """(select capture_id, src_ip, dst_ip, count(*) n, avg(gap) mean, stddev_samp(gap) std,
          min(ts_us) f, max(ts_us) l
        from (select *, (ts_us - lag(ts_us) over (partition by capture_id, src_ip, dst_ip
                order by ts_us)) / 1e6 as gap from packets)
        group by all having count(*) > 5 and stddev_samp(gap) < 5)""",
)
INTERNAL = """(regexp_matches({0}, '^10(\\.[0-9]+){{3}}$')
  or regexp_matches({0}, '^172\\.(1[6-9]|2[0-9]|3[01])(\\.[0-9]+){{2}}$')
  or regexp_matches({0}, '^192\\.168(\\.[0-9]+){{2}}$'))"""
CTES["data_exfiltration"] = alert(
    "data_exfiltration", "high", "SUSPICIOUS_CONNECTION",
    ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"],
    "format('Large outbound transfer: {} -> {} ({:,} bytes)', src_ip, dst_ip, total_bytes)",
    "src_ip", 1, "dst_ip", 1, "start_us", "end_us",
    {"detection_type": "'data_exfiltration'", "bytes_transferred": "total_bytes",
     "destination": "dst_ip"},
    f"""flows where total_bytes > 10000000 and {INTERNAL.format('src_ip')}
        and not {INTERNAL.format('dst_ip')}""",
)
CTES["dns_tunneling_volume"] = alert(
    "dns_tunneling_volume", "high", "DNS_TUNNELING", ["src_ip"],
    "format('DNS tunneling suspected from {}: {} queries in 60s', src_ip, n)",
    "src_ip", 1, "d", "nd", "t0", "t1",
    {"pattern": "'high_query_volume'", "queries_in_window": "n", "window_seconds": "60",
     "threshold": "100"},
    """(select capture_id, src_ip, n, t0, t1, min(dst_ip) d, count(distinct dst_ip) nd
        from dns_packets join dns_bursts using (capture_id, src_ip) group by all)""",
)
CTES["dns_tunneling_oversized_queries"] = alert(
    "dns_tunneling_oversized_queries", "high", "DNS_TUNNELING", ["src_ip"],
    "format('DNS tunneling suspected from {}: {} oversized queries (avg {:.0f} bytes payload)',"
    " src_ip, n, mean)",
    "src_ip", 1, "d", "nd", "f", "l",
    {"pattern": "'oversized_queries'", "large_query_count": "n",
     "average_payload_bytes": "cast(format('{:.1f}', mean) as double)",
     "payload_threshold_bytes": "100"},
    """(select capture_id, src_ip, count(*) n, avg(payload_size) mean, min(dst_ip) d,
          count(distinct dst_ip) nd, min(ts_us) f, max(ts_us) l
        from dns_packets where payload_size > 100 group by all having count(*) >= 20)""",
)

RULE_ORDER = [
    "vertical_port_scan", "horizontal_port_scan", "syn_scan", "xmas_scan", "syn_flood",
    "udp_flood", "icmp_flood", "http_flood", "ssh_brute_force", "http_brute_force",
    "malicious_port", "beaconing", "data_exfiltration", "dns_tunneling_volume",
    "dns_tunneling_oversized_queries",
]
SEVERITY_RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 99 end"
CTES["alerts"] = " union all ".join(
    f"select *, {i} as rule_ord from {r}" for i, r in enumerate(RULE_ORDER)
)

# Addresses of each alert in long form, from the raw packets.
CTES["members"] = f"""
select distinct capture_id, alert_id, role, value from (
  select capture_id, alert_id, 'source_ip' as role, source_ip as value from alerts where n_source_ips = 1
  union all
  select capture_id, alert_id, 'dest_ip', dest_ip from alerts where n_dest_ips = 1
  union all
  select a.capture_id, a.alert_id, 'dest_ip', p.dst_ip from alerts a join packets p
    on a.rule_name = 'horizontal_port_scan' and p.capture_id = a.capture_id
    and p.src_ip = a.source_ip and p.ts_us between a.first_us and a.last_us
    and a.alert_id = concat_ws('|', a.rule_name, p.src_ip, p.dst_port, a.first_us)
  union all
  select a.capture_id, a.alert_id, 'dest_ip', p.dst_ip from alerts a join packets p
    on p.capture_id = a.capture_id and p.src_ip = a.source_ip
    and ((a.rule_name = 'syn_scan' and upper(p.protocol) = 'TCP')
      or (a.rule_name = 'xmas_scan' and {XMAS})
      or (a.rule_name = 'dns_tunneling_volume' and {IS_DNS})
      or (a.rule_name = 'dns_tunneling_oversized_queries' and {IS_DNS} and p.payload_size > 100))
  union all
  select a.capture_id, a.alert_id, 'source_ip', p.src_ip from alerts a join packets p
    on p.capture_id = a.capture_id and p.dst_ip = a.dest_ip
    and p.ts_us >= a.first_us and p.ts_us < a.first_us + 10000000
    and ((a.rule_name = 'syn_flood' and {SYN_ONLY})
      or (a.rule_name = 'udp_flood' and upper(p.protocol) = 'UDP')
      or (a.rule_name = 'icmp_flood' and upper(p.protocol) = 'ICMP')
      or (a.rule_name = 'http_flood' and p.dst_port in (80, 443)))
  union all
  select m.capture_id, 'malicious_port|'||m.port, unnest(['source_ip', 'dest_ip']),
    unnest([m.src_ip, m.dst_ip])
    from port_matches m join alerts a on a.alert_id = 'malicious_port|'||m.port
  union all
  select capture_id, 'http_brute_force|'||source_ip, 'path', path
    from login_entries join login_bursts using (capture_id, source_ip)
)"""

# --- window features ---
CTES["windowed"] = """
select p.*, (ts_us - origin_us) // 60000000 as w from packets p join origins using (capture_id)"""
CTES["spine"] = """
select capture_id, origin_us, unnest(range(0, (end_us - origin_us) // 60000000 + 1)) as w from origins"""
CTES["port_entropies"] = """
select capture_id, w, -sum(c / n * log2(c / n)) as port_entropy from (
  select capture_id, w, dst_port, count(*) c, sum(count(*)) over (partition by capture_id, w) n
  from windowed group by capture_id, w, dst_port) group by all"""
CTES["flag_entropies"] = """
select capture_id, w, -sum(c / n * log2(c / n)) as tcp_flag_entropy from (
  select capture_id, w, flag, count(*) c, sum(count(*)) over (partition by capture_id, w) n
  from (select capture_id, w, unnest(tcp_flags) as flag from windowed)
  group by capture_id, w, flag) group by all"""
CTES["error_counts"] = """
select l.capture_id, cast(floor((l.ts_us - o.origin_us) / 60000000) as bigint) as w,
  count(*) as http_error_count
from logs l join origins o using (capture_id)
where l.severity in ('medium', 'high', 'critical') and l.ts_us is not null group by all"""
FEATURE_NAMES = [
    "packets_per_second", "unique_dst_ips", "unique_dst_ports", "syn_ratio", "rst_ratio",
    "icmp_ratio", "avg_packet_size", "packet_size_std", "small_packet_ratio",
    "large_packet_ratio", "unique_src_ips", "tcp_flag_entropy", "port_entropy",
    "dns_query_count", "http_error_count", "bytes_per_second", "connection_count",
    "avg_flow_packets",
]
CTES["occupied"] = """
select capture_id, w, count(*) / 60 as packets_per_second,
  count(distinct dst_ip) as unique_dst_ips, count(distinct dst_port) as unique_dst_ports,
  count_if(list_contains(tcp_flags,'SYN')) / count(*) as syn_ratio,
  count_if(list_contains(tcp_flags,'RST')) / count(*) as rst_ratio,
  count_if(protocol='ICMP') / count(*) as icmp_ratio,
  avg(size) as avg_packet_size, stddev_pop(size) as packet_size_std,
  count_if(size < 100) / count(*) as small_packet_ratio,
  count_if(size > 1400) / count(*) as large_packet_ratio,
  count(distinct src_ip) as unique_src_ips, count_if(protocol='DNS') as dns_query_count,
  sum(size) / 60 as bytes_per_second,
  count(distinct (src_ip, dst_ip, dst_port)) as connection_count,
  count(*) / count(distinct (src_ip, dst_ip, dst_port)) as avg_flow_packets
from windowed group by all"""
CTES["features"] = f"""
select s.capture_id, s.w, s.origin_us + s.w * 60000000 as window_start_us,
  {', '.join(f'case when o.w is null then 0.0 else cast(coalesce({c}, 0) as double) end as {c}' for c in FEATURE_NAMES)}
from spine s left join occupied o on o.capture_id = s.capture_id and o.w = s.w
left join port_entropies pe on pe.capture_id = s.capture_id and pe.w = s.w
left join flag_entropies fe on fe.capture_id = s.capture_id and fe.w = s.w
left join error_counts e on e.capture_id = s.capture_id and e.w = s.w"""
CTES["feature_stats"] = f"""
select capture_id, count(*) as n, {', '.join(f'avg({c}) as {c}_mean, stddev_pop({c}) as {c}_std' for c in FEATURE_NAMES)}
from features group by capture_id having count(*) >= 5"""


def scaled(c: str) -> str:
    constant = f"{c}_std <= abs({c}_mean) * 1e-12"
    return f"case when {constant} then 0.0 else ({c} - {c}_mean) / {c}_std end"


CTES["scaled"] = f"""
select capture_id, w, n, [{', '.join(scaled(c) for c in FEATURE_NAMES)}] as x
from features join feature_stats using (capture_id)"""
# Local outlier factor by comparing all windows.
CTES["near"] = """
select * from (
  select a.capture_id, a.w, b.w as nb, list_distance(a.x, b.x) as d, a.n,
    row_number() over (partition by a.capture_id, a.w order by list_distance(a.x, b.x), b.w) as r
  from scaled a join scaled b on a.capture_id = b.capture_id and a.w <> b.w)
where r <= least(20, n - 1)"""
CTES["k_distances"] = "select capture_id, w, max(d) as kd from near group by all"
CTES["densities"] = """
select n.capture_id, n.w, 1 / (avg(greatest(n.d, k.kd)) + 1e-10) as lrd
from near n join k_distances k on k.capture_id = n.capture_id and k.w = n.nb group by all"""
CTES["factors"] = """
select n.capture_id, n.w, avg(b.lrd) / any_value(a.lrd) as lof from near n
join densities a on a.capture_id = n.capture_id and a.w = n.w
join densities b on b.capture_id = n.capture_id and b.w = n.nb group by n.capture_id, n.w"""

CTES["contributions"] = " union all ".join(
    f"""select capture_id, w, {i} as idx, '{c}' as name,
    ({c} - {c}_mean) / case when {c}_std = 0 then 1e-10 else {c}_std end as z
    from features join feature_stats using (capture_id)"""
    for i, c in enumerate(FEATURE_NAMES)
)

# --- threats ---
CTES["candidates"] = f"""
select *, {SEVERITY_RANK} as sev_rank,
  concat_ws('.', '0', lpad(cast({SEVERITY_RANK} as varchar), 3, '0'),
    lpad(cast(rule_ord as varchar), 5, '0'), alert_id) as ord_key,
  case severity when 'critical' then 80 when 'high' then 60 when 'medium' then 40 else 20 end
    as severity_score,
  case category when 'PORT_SCAN' then 'Vertical Port Scan from '||source_ip
    when 'DDOS_ATTACK' then 'DDoS Attack targeting '||dest_ip
    when 'BRUTE_FORCE' then 'Brute Force from '||source_ip
    when 'SUSPICIOUS_CONNECTION' then 'Suspicious Connection to '||dest_ip
    when 'DNS_TUNNELING' then 'DNS Tunneling from '||source_ip end as title
from alerts"""
CTES["source_sets"] = """
select capture_id, alert_id, string_agg(value, ',' order by value) as source_set
from members where role = 'source_ip' group by all"""
CTES["grouped"] = """
select c.*, source_set, concat_ws('|', capture_id, category, source_set) as g,
  row_number() over (partition by capture_id, category, source_set order by ord_key) as pos
from candidates c join source_sets using (capture_id, alert_id)"""
# Walk the alerts of each group in order; an alert joins the first leader it overlaps.
CTES["walked"] = """
with recursive steps as (
  select g, pos, alert_id, alert_id as leader,
    [{'id': alert_id, 's': first_us, 'e': last_us}] as leaders
  from grouped where pos = 1
  union all
  select n.g, n.pos, n.alert_id,
    coalesce(list_filter(s.leaders, lambda h: h.s <= n.last_us and h.e >= n.first_us)[1].id,
      n.alert_id),
    case when len(list_filter(s.leaders, lambda h: h.s <= n.last_us and h.e >= n.first_us)) = 0
      then list_append(s.leaders, {'id': n.alert_id, 's': n.first_us, 'e': n.last_us})
      else s.leaders end
  from steps s join grouped n on n.g = s.g and n.pos = s.pos + 1
) select g, pos, alert_id, leader from steps"""
CTES["owners"] = """
select gr.capture_id, w.alert_id, w.leader as threat_id, gr.ord_key, gr.evidence,
  w.alert_id = w.leader as leads
from walked w join grouped gr using (g, pos)"""
CTES["islands"] = """
select *, sum(opens) over (partition by g order by first_us, ord_key) as island from (
  select *, case when first_us <= max(last_us) over (partition by g order by first_us, ord_key
    rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from grouped)"""
CTES["threats"] = f"""
select t.capture_id, o.threat_id, t.category, t.severity_score, t.severity as severity_label,
  t.title, t.description, 'rule' as detection_method, t.source_ip, t.n_source_ips,
  {iso('t.first_us')} || ' – ' || {iso('t.last_us')} as time_range, o.n_alerts,
  min(t.ord_key) over (partition by t.g) as group_key, t.ord_key as open_key
from (select threat_id, count(*) as n_alerts from owners group by all) o
join grouped t on t.alert_id = o.threat_id"""
CTES["threat_members"] = """
select distinct m.capture_id, o.threat_id, m.role, m.value
from members m join owners o using (capture_id, alert_id)"""
CTES["placed"] = """
select *, row_number() over (partition by capture_id
  order by severity_score desc, group_key, open_key) as place from threats"""

RECOMMENDATIONS = {
    "PORT_SCAN": [
        "Block source IP at firewall", "Review firewall rules for exposed ports",
        "Enable IDS/IPS signatures for scan detection"],
    "DDOS_ATTACK": [
        "Enable rate limiting on affected services", "Configure SYN cookies",
        "Contact upstream provider for traffic scrubbing"],
    "BRUTE_FORCE": [
        "Implement account lockout policies", "Enable fail2ban or similar",
        "Enforce strong passwords and MFA"],
    "SUSPICIOUS_CONNECTION": [
        "Isolate affected host for investigation",
        "Block communication to suspicious destination",
        "Conduct forensic analysis of the endpoint"],
    "DNS_TUNNELING": [
        "Block outbound DNS to untrusted resolvers; force traffic through internal DNS",
        "Inspect logs of the source host for unauthorised processes",
        "Add the destination domain(s) to a DNS sinkhole or blocklist"],
}
# The texts of RECOMMENDATIONS are fixed values: what the library recommends, word for word.
CTES["advice"] = " union all ".join(
    f"select '{c}' as category, {i} as pos, '{t}' as recommendation"
    for c, texts in RECOMMENDATIONS.items() for i, t in enumerate(texts)
)


def statement(body: str) -> str:
    """`body` with the CTEs it names, dependencies first."""
    needed: list[str] = []

    def visit(text: str, path: tuple[str, ...] = ()) -> None:
        words = set(re.findall(r"\b[a-z_]+\b", re.sub(r"'[^']*'", "", text)))
        for name in CTES:
            if name in words and name not in path and name not in needed:
                visit(CTES[name], (*path, name))
                needed.append(name)

    visit(body)
    if not needed:
        return body
    own = body.strip()
    rest = ", " + own[len("with ") :] if own.startswith("with ") else "\n" + own
    return "with " + ", ".join(f"{n} as ({CTES[n]})" for n in needed) + rest


ALERT_COLUMNS = (
    "capture_id, alert_id, rule_name, severity, category, description, source_ip, n_source_ips, "
    "dest_ip, n_dest_ips, first_us, last_us, evidence"
)
ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in FEATURE_NAMES)


def table(k: int, title: str = "title", where: str = "true") -> str:
    return f"""
      with ranked as (
        select threat_id, value,
          row_number() over (partition by threat_id order by value) as r
        from threat_members where role = 'source_ip'),
      firsts as (
        select threat_id, string_agg(value, ', ' order by value) as ips
        from ranked where r <= {k} group by threat_id)
      select capture_id, threat_id, upper(severity_label) as severity, category,
        {title} as title,
        coalesce(ips, '') || case when n_source_ips > {k}
          then ' (+' || (n_source_ips - {k}) || ')' else '' end as source_ips,
        detection_method as detection
      from threats left join firsts using (threat_id) where {where}"""


LOG_SELECT = "line_no, log_format, ts_raw, ts_us, source_ip, message, severity, service"

BODIES: dict[str, str] = {
    "packet_table": "select * replace (array_to_string(tcp_flags, '|') as tcp_flags) from packets",
    "decoded_labels": "select seq, protocol, array_to_string(tcp_flags, '|') as tcp_flags from packets",
    "packet_predicates": f"""
        select seq, cast({IS_DNS} as int) as is_dns, cast({SYN_ONLY} as int) as is_syn_only,
          cast({XMAS} as int) as is_xmas, cast(dst_port in (80, 443) as int) as is_web,
          cast({INTERNAL.format('src_ip')} as int) as src_internal,
          cast({INTERNAL.format('dst_ip')} as int) as dst_internal
        from packets""",
    "packet_filter": f"""
        select seq, ts_us, src_ip, dst_ip, dst_port, size from packets
        where protocol = 'TCP' and dst_port = 443 and src_ip = '192.168.1.15'
          and ts_us >= {EPOCH_US}""",
    "flows": """
        select capture_id, src_ip, dst_ip, src_port, dst_port, protocol, packet_count,
          total_bytes, start_us, end_us, duration_seconds from flows""",
    "protocol_distribution": """
        select capture_id, protocol, count(*) as packets from packets group by all""",
    "protocol_breakdown": """
        select capture_id, protocol, count(*) as packets,
          round(count(*) / sum(count(*)) over (partition by capture_id) * 100, 6) as share_pct
        from packets group by capture_id, protocol""",
    "top_ports": """
        select dst_port, count(*) as packets from packets group by 1
        order by packets desc, dst_port limit 15""",
    "capture_summary": f"""
        select capture_id, capture_id || coalesce((select ', ' || string_agg(distinct source_file, ', '
            order by source_file) from logs), '') as source_files,
          count(*) as packet_count, count(distinct src_ip) as unique_src_ips,
          count(distinct dst_ip) as unique_dst_ips,
          count(distinct src_ip) + count(distinct dst_ip) as unique_ips,
          string_agg(distinct protocol, ', ' order by protocol) as protocols,
          {iso('min_by(ts_us, seq)')} || ' – ' || {iso('max_by(ts_us, seq)')} as time_range,
          (select count(*) from logs) as log_entries
        from packets group by capture_id""",
    # Sketches of so few addresses are exact.
    "sketched_distincts": """
        select capture_id, count(*) as packets, count(distinct src_ip) as unique_src_ips,
          count(distinct dst_ip) as unique_dst_ips from packets group by capture_id""",
    "entity_features": " union all ".join(
        f"""
        select capture_id, w, {prefix} as prefix, {entity} as entity, count(*) as packets,
          sum(size) as bytes, count_if(list_contains(tcp_flags, 'SYN')) as syn_packets,
          count(distinct src_ip) as hosts, count(distinct dst_ip) as unique_dst_ips,
          count(distinct dst_port) as unique_dst_ports
        from windowed group by capture_id, w, {entity}"""
        for prefix, entity in (
            (32, "src_ip"),
            (24, "regexp_extract(src_ip, '^[0-9]+[.][0-9]+[.][0-9]+')"),
            (16, "regexp_extract(src_ip, '^[0-9]+[.][0-9]+')"),
        )
    ),
    "syslog_entries": f"select {LOG_SELECT} from logs",
    "access_entries": f"select {LOG_SELECT} from access_logs",
    "detected_formats": """
        select 'syslog' as source_file, 'syslog' as log_format where exists (from syslog_lines)
        union all
        select 'access', 'apache' where exists (from access_logs)""",
    "error_entries": """
        select line_no, source_file, severity, source_ip from all_logs
        where severity in ('critical', 'high') or (log_format = 'apache' and severity = 'medium')""",
    "mixed_file_entries": """
        select log_format, severity, service, count(*) as n from all_logs group by all""",
    "log_summary": """
        select capture_id, source_file, log_format, count(*) as entry_count,
          count_if(severity in ('critical', 'high')
            or (log_format = 'apache' and severity = 'medium')) as error_count,
          min_by(ts_raw, line_no) || ' – ' || max_by(ts_raw, line_no) as time_range
        from all_logs group by all""",
    "login_request_paths": "select line_no, source_ip, path from login_entries",
    "anchored_windows": """
        select capture_id, (ts_us - origin_us) // 10000000 as w, count(*) as packets
        from packets join origins using (capture_id) group by all""",
    "query_bursts": """
        select capture_id, src_ip, n as burst_n, t0 as first_us, t1 as last_us from dns_bursts""",
    "pair_gaps": """
        select capture_id, src_ip, dst_ip, count(*) as n, min(ts_us) as first_us,
          max(ts_us) as last_us,
          cast(round(cast(avg(gap) / 1e6 as decimal(28, 9)), 5) as double) as mean_gap_s,
          cast(round(cast(stddev_samp(gap) / 1e6 as decimal(28, 9)), 5) as double) as std_gap_s
        from (select *, ts_us - lag(ts_us) over (partition by capture_id, src_ip, dst_ip
                order by ts_us) as gap from packets)
        group by capture_id, src_ip, dst_ip""",
    "window_features": f"select capture_id, w, window_start_us, {ROUNDED} from features",
    "baseline_stats": f"""
        select capture_id, {', '.join(f'round(avg({c}), 6) as {c}' for c in FEATURE_NAMES)}
        from features group by capture_id""",
    **{rule: f"select {ALERT_COLUMNS} from {rule}" for rule in RULE_ORDER},
    "all_alerts": f"select {ALERT_COLUMNS}, {SEVERITY_RANK} as severity_rank from alerts",
    "alert_members": "select capture_id, alert_id, role, value from members",
    "user_rule": """
        select capture_id, 'large_icmp|'||src_ip as alert_id, 'large_icmp' as rule_name,
          'low' as severity, 'Large ICMP from '||src_ip as description, min(ts_us) as first_us,
          max(ts_us) as last_us
        from packets where protocol = 'ICMP' and size > 400 group by capture_id, src_ip""",
    "scaled_features": "select capture_id, w, "
    + ", ".join(f"round(x[{i + 1}], 5) as {c}" for i, c in enumerate(FEATURE_NAMES))
    + " from scaled",
    "outlier_factors": "select capture_id, w, round(lof, 5) as lof from factors",
    "contributing_features": """
        select capture_id, w, string_agg(format('{} ({:.1f}x {} baseline)', name, abs(z),
            case when z > 0 then 'above' else 'below' end), ', ' order by abs(z) desc, idx desc)
          as contributing
        from (select *, row_number() over (partition by capture_id, w
                order by abs(z) desc, idx desc) as r from contributions)
        where r <= 3 group by capture_id, w""",
    "threats": """
        select capture_id, threat_id, category, severity_score, severity_label, title,
          description, detection_method, source_ip, n_source_ips, time_range, n_alerts,
          group_key, open_key from threats""",
    "threats_whole_islands": """
        select capture_id, min_by(alert_id, lpad(cast(100 - severity_score as varchar), 3, '0')||ord_key)
            as threat_id, category, max(severity_score) as severity_score, count(*) as n_alerts
        from islands group by capture_id, category, g, island""",
    "threat_members": "select capture_id, threat_id, role, value from threat_members",
    "threat_evidence": """
        select capture_id, threat_id, key,
          min_by(value, case when leads then '0' else '1' end || ord_key) as value
        from (select capture_id, threat_id, leads, ord_key, unnest(json_keys(evidence)) as key,
                evidence from owners),
          lateral (select json_extract_string(evidence, '$.' || key) as value)
        group by capture_id, threat_id, key""",
    "severity_counts": """
        select capture_id, count(*) as total_threats,
          count_if(severity_label = 'critical') as critical_count,
          count_if(severity_label = 'high') as high_count,
          count_if(severity_label = 'medium') as medium_count,
          count_if(severity_label = 'low') as low_count
        from threats group by capture_id""",
    "executive_facts": f"""
        with s as (select capture_id, count(*) as packet_count,
            {iso('min_by(ts_us, seq)')} || ' – ' || {iso('max_by(ts_us, seq)')} as time_range
          from packets group by capture_id),
        c as (select capture_id, count(*) as total_threats,
            count_if(severity_label = 'critical') as critical_count,
            count_if(severity_label = 'high') as high_count,
            count_if(severity_label = 'medium') as medium_count,
            count_if(severity_label = 'low') as low_count from threats group by capture_id),
        k as (select capture_id, category, count(*) n, min(place) p from placed group by all),
        b as (select capture_id, category as top_category from k
          qualify row_number() over (partition by capture_id order by n desc, p) = 1)
        select s.*, total_threats, critical_count, high_count, medium_count, low_count,
          top_category,
          format('Analysis of {{:,}} packets over {{}} identified {{}} threats ({{}} critical, {{}} high). '
            || '{{}} was the most prevalent threat category.', packet_count, time_range,
            total_threats, critical_count, high_count, top_category) as sentence
        from s join c using (capture_id) join b using (capture_id)""",
    "threat_table": table(3),
    "compact_threat_table": table(
        2, "case when length(title) > 33 then left(title, 30) || '...' else title end"
    ),
    "critical_threats": table(3, where="severity_label = 'critical'"),
    "threat_sources": """
        select t.capture_id, t.threat_id, upper(severity_label) as severity, category, title,
          coalesce(m.value, 'N/A') as source_ip, detection_method as detection
        from threats t left join threat_members m
          on m.threat_id = t.threat_id and m.role = 'source_ip'""",
    "recommendations": """
        with r as (select p.capture_id, p.severity_label, p.place, a.pos, a.recommendation,
            case severity_label when 'critical' then 0 when 'high' then 1 when 'medium' then 2
              else 3 end as rk
          from placed p join advice a using (category)),
        o as (select * from r qualify row_number() over (
            partition by capture_id, recommendation order by rk, place, pos) = 1)
        select capture_id, row_number() over (partition by capture_id order by rk, place, pos)
            as number, upper(severity_label) as priority, recommendation from o""",
    "top_threats": """
        select capture_id, place as number, threat_id, title, description, severity_score,
          time_range from placed where place <= 10""",
}

# Replayed streams give out everything.


def streamed_flood(kind: str, test: str, packets: int, sources: int) -> str:
    return f"""
        select capture_id, '{kind}_flood' as rule_name, b * 10000000 as window_start, dst_ip,
          count(*) as packets, count(distinct src_ip) as sources, count(*) / 10 as rate
        from (select *, ts_us // 10000000 as b from packets where {test}) group by capture_id, b, dst_ip
        having count(*) > {packets} and count(distinct src_ip) > {sources}"""


CTES["sessions"] = """
select *, sum(opens) over (partition by capture_id, src_ip, dst_ip, src_port, dst_port, protocol
    order by ts_us) as session
from (select *, case when ts_us - lag(ts_us) over (partition by capture_id, src_ip, dst_ip,
      src_port, dst_port, protocol order by ts_us) < 300000000 then 0 else 1 end as opens
  from packets)"""
CTES["epoch_windows"] = "select *, ts_us // 60000000 as b from packets"
CTES["epoch_entropies"] = """
select capture_id, b, -sum(c / n * log2(c / n)) as h from (
  select capture_id, b, dst_port, count(*) c, sum(count(*)) over (partition by capture_id, b) n
  from epoch_windows group by capture_id, b, dst_port) group by all"""
CTES["epoch_flag_entropies"] = """
select capture_id, b, -sum(c / n * log2(c / n)) as fh from (
  select capture_id, b, flag, count(*) c, sum(count(*)) over (partition by capture_id, b) n
  from (select capture_id, b, unnest(tcp_flags) as flag from epoch_windows)
  group by capture_id, b, flag) group by all"""

BODIES.update(
    {
        "decoded_frames": """
        with f as (select *, payload_size as body,
          case protocol when 'TCP' then 20 else 8 end as head from packets)
        select capture_id, seq, ts_us, src_ip, dst_ip,
          case when protocol = 'ICMP' then 0 else src_port end as src_port,
          case when protocol = 'ICMP' then 0 else dst_port end as dst_port,
          case when protocol = 'TCP' and dst_port = 53 and body > 0 then 'DNS' else protocol end
            as protocol,
          14 + 20 + head + body as size, head + body as payload_size,
          array_to_string(list_filter(['FIN', 'SYN', 'RST', 'PSH', 'ACK', 'URG'],
            lambda x: list_contains(tcp_flags, x)), '|') as tcp_flags
        from f""",
        "streamed_floods": " union all ".join(
            [
                streamed_flood("syn", SYN_ONLY, 100, 5),
                streamed_flood("udp", "upper(protocol) = 'UDP'", 500, 0),
                streamed_flood("icmp", "upper(protocol) = 'ICMP'", 50, 0),
                streamed_flood("http", "dst_port in (80, 443)", 100, 5),
            ]
        ),
        "streamed_features": """
        with f as (select capture_id, b, round(count(*) / 60, 6) as packets_per_second,
          round(sum(size) / 60, 6) as bytes_per_second, count(distinct src_ip) as unique_src_ips,
          count(distinct dst_ip) as unique_dst_ips, count(distinct dst_port) as unique_dst_ports,
          round(count_if(list_contains(tcp_flags,'SYN')) / count(*), 6) as syn_ratio,
          round(count_if(list_contains(tcp_flags,'RST')) / count(*), 6) as rst_ratio,
          round(count_if(protocol = 'ICMP') / count(*), 6) as icmp_ratio,
          count_if(protocol = 'DNS') as dns_query_count,
          round(avg(size), 6) as avg_packet_size, round(any_value(h), 6) as port_entropy,
          round(stddev_pop(size), 6) as packet_size_std,
          round(count_if(size < 100) / count(*), 6) as small_packet_ratio,
          round(count_if(size > 1400) / count(*), 6) as large_packet_ratio,
          round(coalesce(any_value(fh), 0), 6) as tcp_flag_entropy,
          count(distinct (src_ip, dst_ip, dst_port)) as connection_count,
          round(count(*) / count(distinct (src_ip, dst_ip, dst_port)), 6) as avg_flow_packets
        from epoch_windows join epoch_entropies using (capture_id, b)
          left join epoch_flag_entropies using (capture_id, b) group by capture_id, b),
        e as (select capture_id, ts_us // 60000000 as b, count(*) as errors from logs
          where severity in ('medium', 'high', 'critical') and ts_us is not null group by all)
        select coalesce(f.capture_id, e.capture_id) as capture_id, coalesce(f.b, e.b) * 60000000 as window_start,
          {columns}
        from f full join e on f.capture_id = e.capture_id and f.b = e.b""".format(
            columns=", ".join(
                f"cast(coalesce(case when f.b is not null then {'errors' if c == 'http_error_count' else c} end, 0) as double) as {c}"
                for c in FEATURE_NAMES
            )
        ),
        "streamed_flows": """
        select capture_id, src_ip, dst_ip, src_port, dst_port, protocol, count(*) as packet_count,
          sum(size) as total_bytes, min(ts_us) as start_us, max(ts_us) as end_us
        from sessions
        group by capture_id, src_ip, dst_ip, src_port, dst_port, protocol, session""",
        "streamed_query_bursts": """
        select capture_id, src_ip as source, n as burst_n, t0 as first_us, t1 as last_us
        from dns_bursts""",
        "streamed_ssh_bursts": """
        select capture_id, source_ip as source, n as burst_n, t0 as first_us, t1 as last_us
        from ssh_bursts""",
        "streamed_http_bursts": """
        select capture_id, source_ip as source, n as burst_n, t0 as first_us, t1 as last_us
        from login_bursts""",
        "streamed_vertical_scans": """
        select capture_id, src_ip, dst_ip, items, open_us, close_us
        from vertical_windows""",
        "streamed_horizontal_scans": """
        select capture_id, src_ip, dst_port, items, open_us, close_us
        from horizontal_windows""",
        "streamed_beacons": """
        select capture_id, src_ip, dst_ip, count(*) as n, min(ts_us) as first_us,
          max(ts_us) as last_us,
          cast(round(cast(avg(gap) / 1e6 as decimal(28, 9)), 5) as double) as mean_gap_s,
          cast(round(cast(stddev_samp(gap) / 1e6 as decimal(28, 9)), 5) as double) as std_gap_s
        from (select *, ts_us - lag(ts_us) over (partition by capture_id, src_ip, dst_ip
                order by ts_us) as gap from packets)
        group by capture_id, src_ip, dst_ip
        having count(*) > 5 and stddev_samp(gap) < 5000000""",
    }
)


def oracle_sql() -> dict[str, str]:
    return {name: statement(body) for name, body in BODIES.items()}
