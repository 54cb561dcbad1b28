"""A line server as the head of a stream, and sinks over TCP."""

from __future__ import annotations

import logging
import socket
import threading
import time

from pyspark.sql import SparkSession

MOST_LINES = 10_000
MOST_HELD = 200_000


class LineServer:
    """Accepts up to ``max_connections`` clients and gathers their lines.

    While ``most_held`` lines wait to be forgotten no more are read, so that the network slows the clients down.
    """

    def __init__(self, host: str, port: int, max_connections: int = 10, read_timeout_ms: int = 0, most_held: int = MOST_HELD):
        self.read_timeout, self.most_held, self.closed = read_timeout_ms / 1000 or None, most_held, False
        self.lines: list[str] = []
        self.base = 0
        self.lock = threading.Condition()
        self.gate = threading.Semaphore(max_connections)
        self.server = socket.create_server((host, port))
        self.port = self.server.getsockname()[1]
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while True:
            try:
                peer, _ = self.server.accept()
            except OSError:
                return
            threading.Thread(target=self._serve, args=(peer,), daemon=True).start()

    def _serve(self, peer: socket.socket) -> None:
        peer.settimeout(self.read_timeout)
        with self.gate, peer, peer.makefile("r", encoding="utf-8", errors="replace", newline="\n") as f:
            try:
                for line in f:
                    with self.lock:
                        self.lock.wait_for(lambda: self.closed or len(self.lines) < self.most_held)
                        if self.closed:
                            return
                        self.lines.append(line.rstrip("\r\n"))
            except TimeoutError:
                return

    def take(self, at: int, most: int = MOST_LINES) -> list[str]:
        with self.lock:
            return self.lines[max(0, at - self.base) : max(0, at - self.base) + most]

    def forget(self, before: int) -> None:
        """Lines that are committed need no memory; positions stay."""
        with self.lock:
            del self.lines[: max(0, before - self.base)]
            self.base = max(self.base, before)
            self.lock.notify_all()

    def close(self) -> None:
        with self.lock:
            self.closed = True
            self.lock.notify_all()
        self.server.close()


class Spool:
    """Writes the lines that a server gathers to files of a shared folder, a new one every ``flush_ms``.

    A stream over the folder can be restarted, and reads the same lines again after a failure. A write that fails is
    tried again, as its lines are still held, and ``error`` holds the failure until one succeeds.
    """

    def __init__(self, spark: SparkSession, server: LineServer, folder: str, flush_ms: int = 200):
        self.jvm, self.server, self.folder, self.flush_ms, self.files, self.done = spark._jvm, server, folder, flush_ms, 0, 0
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))
        self.stopped, self.error = threading.Event(), None
        threading.Thread(target=self._run, daemon=True).start()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _run(self) -> None:
        while not self.stopped.wait(self.flush_ms / 1000):
            try:
                while self.flush() == MOST_LINES:  # more may wait
                    pass
                self.error = None
            except Exception as e:  # the store may be away for a while
                if self.error is None:
                    logging.getLogger(__name__).exception("lines can't be written to %s; trying again", self.folder)
                self.error = e

    def flush(self) -> int:
        """Write the waiting lines, at most ``MOST_LINES``; how many there were."""
        lines = self.server.take(self.done)
        if not lines:
            return 0
        name = f"lines-{self.files:09d}.txt"
        out = self.fs.create(self._path(f"_{name}"), True)
        out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
        out.close()
        self.fs.rename(self._path(f"_{name}"), self._path(name))
        self.files, self.done = self.files + 1, self.done + len(lines)
        self.server.forget(self.done)
        return len(lines)

    def stop(self) -> None:
        self.stopped.set()
        self.server.close()


class LineClient:
    """Writes lines to one peer, waiting for it to come up."""

    def __init__(self, host: str, port: int, timeout_ms: int = 5000):
        end = time.monotonic() + timeout_ms / 1000
        while True:
            try:
                self.socket = socket.create_connection((host, port), timeout=timeout_ms / 1000)
                return
            except OSError:
                if time.monotonic() > end:
                    raise
                time.sleep(0.05)

    def send(self, lines: list[str]) -> None:
        self.socket.sendall("".join(f"{x}\n" for x in lines).encode())

    def close(self) -> None:
        self.socket.close()


class Broadcaster:
    """Listens, and sends each line to all clients that are connected."""

    def __init__(self, host: str, port: int):
        self.server = socket.create_server((host, port))
        self.port = self.server.getsockname()[1]
        self.peers: list[socket.socket] = []
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while True:
            try:
                self.peers.append(self.server.accept()[0])
            except OSError:
                return

    def send(self, lines: list[str]) -> None:
        data = "".join(f"{x}\n" for x in lines).encode()
        for peer in list(self.peers):
            try:
                peer.sendall(data)
            except OSError:
                self.peers.remove(peer)

    def close(self) -> None:
        self.server.close()
