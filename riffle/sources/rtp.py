"""RTP packets from a UDP port as a stream: one row for each datagram. Made for one camera; a wall of cameras goes through a broker."""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class RtpPort(DataSource):
    """``spark.readStream.format("rtp_port").option("port", 6970).load()``: ``n, received_us, packet``."""

    @classmethod
    def name(cls) -> str:
        return "rtp_port"

    def schema(self) -> str:
        return "n long, received_us long, packet binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return RtpReader(self.options.get("host", "127.0.0.1"), int(self.options["port"]), float(self.options.get("wait", 0.5)))


class RtpReader(SimpleDataSourceStreamReader):
    """Reads what has come until nothing comes for ``wait`` seconds. Packets stay in memory until their batch is committed."""

    def __init__(self, host: str, port: int, wait: float):
        self.address, self.wait, self.at, self.kept, self.socket = (host, port), wait, 0, {}, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.address)
            self.socket.settimeout(self.wait)
        n = max(start["n"], self.at)
        try:
            while len(self.kept) < 10_000:
                packet = self.socket.recv(65_536)
                self.kept[n] = (n, time.time_ns() // 1000, packet)
                n += 1
        except TimeoutError:
            pass
        self.at = n
        return iter([self.kept[i] for i in range(start["n"], n) if i in self.kept]), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([self.kept[i] for i in range(start["n"], end["n"]) if i in self.kept])

    def commit(self, end: dict) -> None:
        self.kept = {i: row for i, row in self.kept.items() if i >= end["n"]}
