"""Packet captures as tables: the classic file format, Ethernet and raw IP, decoded and written in tasks.

A capture is read as a whole by one task, so files must be under 2 GB; larger ones are cut by the tool that took them.
"""

from __future__ import annotations

import os
import socket
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKETS = "file string, number long, timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, proto int, length int, packet binary"
# Magic numbers by the number of ticks in a second, link types, Ethernet types, and protocols whose headers begin with ports.
MICROS, NANOS = 0xA1B2C3D4, 0xA1B23C4D
ETHERNET, RAW = 1, 101
IPV4, IPV6, VLAN = 0x0800, 0x86DD, (0x8100, 0x88A8)
WITH_PORTS = (6, 17, 132)
#: Rows that a task hands on at once.
ROWS = 10_000
#: Packets of a written capture, at most.
MOST = 1_000_000


def addresses(packet: bytes, link: int = ETHERNET) -> tuple[str, str, int | None, int | None, int] | None:
    """Source, destination, ports (null without) and protocol of a packet; null if it isn't IP or is cut short."""
    at, kind = 0, None
    if link == ETHERNET:
        kind, at = int.from_bytes(packet[12:14], "big"), 14
        while kind in VLAN:
            kind, at = int.from_bytes(packet[at + 2 : at + 4], "big"), at + 4
    elif link == RAW and packet:
        kind = {4: IPV4, 6: IPV6}.get(packet[0] >> 4)
    if kind == IPV4 and len(packet) >= at + 20:
        proto, family, first, size = packet[at + 9], socket.AF_INET, at + 12, 4
        body = at + 4 * (packet[at] & 15)
        later = int.from_bytes(packet[at + 6 : at + 8], "big") & 0x1FFF  # a fragment but the first has no ports
    elif kind == IPV6 and len(packet) >= at + 40:
        proto, family, first, size, body, later = packet[at + 6], socket.AF_INET6, at + 8, 16, at + 40, 0
    else:
        return None
    src, dst = (socket.inet_ntop(family, packet[i : i + size]) for i in (first, first + size))
    if proto not in WITH_PORTS or later or len(packet) < body + 4:
        return src, dst, None, None, proto
    return src, dst, *struct.unpack("!HH", packet[body : body + 4]), proto


def packets_of(content: bytes) -> Iterator[tuple[float, int, int, bytes]]:
    """(time in seconds, length on the wire, link type, captured bytes) of a capture; a record that is cut short ends it."""
    for order in "<>":
        magic = struct.unpack(order + "I", content[:4])[0] if len(content) >= 24 else None
        if magic in (MICROS, NANOS):
            break
    else:
        raise ValueError("not a packet capture")
    ticks, link, at = 1e6 if magic == MICROS else 1e9, struct.unpack(order + "I", content[20:24])[0] & 0xFFFF, 24
    while at + 16 <= len(content):
        seconds, fraction, kept, length = struct.unpack(order + "IIII", content[at : at + 16])
        if at + 16 + kept > len(content):
            return
        yield seconds + fraction / ticks, length, link, content[at + 16 : at + 16 + kept]
        at += 16 + kept


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """One row a packet (see PACKETS), numbered in its file; packets that aren't IP have no addresses."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PACKETS.split(", ")]
        whole = {c: "Int32" for c in ("src_port", "dst_port", "proto")}
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = []
                for number, (at, length, link, packet) in enumerate(packets_of(content)):
                    rows.append((name, number, at, *(addresses(packet, link) or (None,) * 5), length, packet))
                    if len(rows) == ROWS:
                        yield pd.DataFrame(rows, columns=names).astype(whole)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype(whole)

    return found.mapInPandas(decode, PACKETS)


def write_pcap(packets: DataFrame, path: str, label: str | None = None, link: int = ETHERNET, most: int = MOST) -> None:
    """Captures below a folder that all tasks can reach, of `most` packets at most, in a folder for each label if there is one: rows with
    timestamp and packet.

    Packets are in order of time in each file; a task sorts with spilling and holds a batch of them. A repeated attempt writes the same files again.
    """
    from pyarrow import fs

    uri = path if "://" in path else f"file://{os.path.abspath(path)}"
    head = struct.pack("<IHHiIII", MICROS, 2, 4, 0, 0, 1 << 18, link)
    rows = packets.select("timestamp", "packet", (F.col(label) if label else F.lit(None)).cast("string").alias("label"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(uri)
        out, now, number, held, total = None, None, 0, 0, 0
        try:
            for batch in batches:
                for at, packet, name in zip(batch["timestamp"], batch["packet"], batch["label"]):
                    if out is None or name != now or held == most:
                        if out is not None:
                            out.close()
                        number, now, held = number + 1 if out is not None and name == now else 0, name, 0
                        there = f"{folder}/label={name}" if label else folder
                        store.create_dir(there)
                        out = store.open_output_stream(f"{there}/part-{TaskContext.get().partitionId():05d}-{number:05d}.pcap")
                        out.write(head)
                    at, packet = round(at * 1e6), bytes(packet)
                    out.write(struct.pack("<IIII", at // 1_000_000, at % 1_000_000, len(packet), len(packet)) + packet)
                    held, total = held + 1, total + 1
        finally:
            if out is not None:
                out.close()
        yield pd.DataFrame({"n": [total]})

    rows.sortWithinPartitions("label", "timestamp", "packet").mapInPandas(write, "n long").agg(F.sum("n")).collect()


@F.pandas_udf(T.BinaryType())
def header_packet(src: pd.Series, dst: pd.Series, src_port: pd.Series, dst_port: pd.Series, proto: pd.Series) -> pd.Series:
    """The least Ethernet packet with these IPv4 addresses, ports (where the protocol has them) and protocol."""

    def one(a: str, b: str, pa: int, pb: int, number: int) -> bytes:
        body = struct.pack("!HH", pa, pb) + bytes(16) if number in WITH_PORTS else bytes(8)
        ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, number, 0, socket.inet_aton(a), socket.inet_aton(b))
        return bytes(12) + struct.pack("!H", IPV4) + ip + body

    return pd.Series([one(*row) for row in zip(src, dst, src_port, dst_port, proto)], dtype=object)
