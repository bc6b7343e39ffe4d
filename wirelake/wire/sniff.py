"""Which protocol a connection speaks: by port, else by its first bytes."""

from __future__ import annotations

# Ports of protocols.
PORTS = {6379: "redis", 5672: "amqp", 5432: "postgres", 3306: "mysql", 27017: "mongodb", 9092: "kafka", 53: "dns"}


def by_port(sport: int, dport: int) -> str | None:
    return PORTS.get(dport) or PORTS.get(sport)


def by_content(data: bytes) -> str:
    """The likeliest protocol of the first bytes from a client."""
    if data.startswith(b"AMQP"):
        return "amqp"
    if len(data) >= 8 and data[4:8] in (b"\x00\x03\x00\x00", b"\x04\xd2\x16\x2f", b"\x04\xd2\x16\x2e", b"\x04\xd2\x16\x30"):
        return "postgres"
    if len(data) >= 5 and data[:1] in (b"Q", b"P", b"B", b"E", b"S", b"X", b"p") and data[1] == 0:
        return "postgres"
    if data[:1] in (b"*", b"+", b"-", b":", b"$") and b"\r\n" in data[:32]:
        return "redis"
    return "http"


def protocol(sport: int, dport: int, data: bytes) -> str:
    return by_port(sport, dport) or by_content(data)
