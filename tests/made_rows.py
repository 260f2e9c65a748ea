"""Rows that several tests make."""

T0 = 1773568800000000  # 2026-03-15T10:00:00Z


def packet(seq=0, at=0.0, us=None, capture_id="c", src="10.0.0.5", dst="203.0.113.9", sport=50000,
           dport=80, proto="TCP", size=60, flags=("SYN", "ACK"), payload=0):
    """One packet row; `at` is seconds after T0, `us` microseconds after T0."""
    ts = T0 + (round(at * 1e6) if us is None else us)
    return (capture_id, seq, ts, src, dst, sport, dport, proto, size, list(flags), payload)


def log(seq=0, at=0.0, source="198.51.100.7", message="Failed password for root", severity="high",
        service="sshd", capture_id="c"):
    ts = T0 + round(at * 1e6)
    return (capture_id, "f", (0, seq), "syslog", "raw", ts, source, message, severity, service, message)
