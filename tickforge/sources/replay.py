"""A stream of raw frames from recorded lines, standing in for a feed's socket."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class FrameReplay(DataSource):
    """``spark.dataSource.register(FrameReplay)``, then ``readStream.format("frame_replay")``.

    Options: ``path`` (a text file, a frame per line, readable by the driver), ``frames`` per micro-batch (1,000) and ``start_us``
    and ``step_us``, from which the time of receipt is counted. The offset is the line reached and its place in the file,
    so a batch reads no line before its own, and a query that starts again from its checkpoint neither loses nor repeats
    a frame. Empty lines are frames too; decoders report them.
    """

    @classmethod
    def name(cls) -> str:
        return "frame_replay"

    def schema(self) -> str:
        return "frame_id bigint, recv_us bigint, frame string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path = Path(options["path"])
        self.most = int(options.get("frames", "1000"))
        self.start, self.step = int(options.get("start_us", "0")), int(options.get("step_us", "1"))

    def initialOffset(self) -> dict:
        return {"line": 0, "byte": 0}

    def _rows(self, start: dict, lines: int) -> tuple[list[tuple], dict]:
        rows = []
        with self.path.open("rb") as file:
            file.seek(start["byte"])
            for i in range(start["line"], start["line"] + lines):
                if not (line := file.readline()):
                    break
                rows.append((i, self.start + i * self.step, line.decode("utf-8", "replace").rstrip("\r\n")))
            return rows, {"line": start["line"] + len(rows), "byte": file.tell()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._rows(start, self.most)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start, end["line"] - start["line"])[0])

    def commit(self, end: dict) -> None:
        pass
