"""A streaming source of text blocks (SDF, MOL2 or any other with a separator) that stops and goes on inside a file.

An offset is the number of a step. A step is a plan: which bytes of which files belong to it,
as many as max_bytes allows. Plans are files in the bookmark folder, written before Spark
records the step and never changed, so a step that is run again reads the same bytes. A
block belongs to the range in which it begins, so ranges need not know where blocks are.
"""

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start long, block string"
CHUNK = 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; file:/x is read as file:///x."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def blocks_of(read, begin: int, end: int, mark: bytes, leads: bool) -> Iterator[tuple[int, bytes]]:
    """(start, block) of the blocks that begin in bytes begin to end of a text, without a mark that ends them.

    read(at, n) gives up to n bytes from a place. A block begins at 0 and after each mark, or,
    if the mark leads, with each mark; what comes before the first is then no block. Memory is a block and a chunk.
    """
    at = max(0, begin - (0 if leads else len(mark)))
    held, base = b"", at
    start = 0 if begin == 0 and not leads else None
    look = 0  # from where in held the next mark is searched
    while True:
        chunk = read(base + len(held), CHUNK)
        held += chunk
        while (p := held.find(mark, look)) >= 0:
            bound = base + p + (0 if leads else len(mark))
            if start is not None:
                yield start, held[start - base : p]
            if bound >= end:
                return
            start = bound if bound >= begin else None
            look = p + len(mark)
        if not chunk:
            if start is not None and start < base + len(held):
                yield start, held[start - base :]
            return
        look = max(look, len(held) - len(mark) + 1)
        # What is no longer needed goes: all before the open block, or before a mark that may have begun.
        keep = max(0, (start - base) if start is not None else len(held) - len(mark) + 1)
        keep = min(keep, look)
        if keep:
            held, base, look = held[keep:], base + keep, look - keep


class Range(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class BlockReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.bookmark = options["path"], options["bookmark"]
        self.mark, self.leads = options.get("mark", "$$$$\n").encode(), options.get("leads", "false") == "true"
        self.ends, self.max_bytes, self.split_bytes = tuple(options.get("ends", ".sdf").split(",")), int(options.get("max_bytes", 1 << 34)), int(options.get("split_bytes", 1 << 26))
        self.done: dict[str, int] | None = None  # bytes of each file that plans have dealt with
        self.planned = 0

    # Only the driver's instance plans.
    def _plan_file(self, step: int) -> tuple[fs.FileSystem, str]:
        return _opened(f"{self.bookmark}/plan-{step:09d}.json")

    def _plan(self, step: int) -> list[tuple[str, int, int]]:
        system, at = self._plan_file(step)
        with system.open_input_stream(at) as f:
            return [tuple(x) for x in json.loads(f.read())]

    def _write(self, name: str, value) -> None:
        """A whole file or none: written beside its place and moved there."""
        system, at = _opened(f"{self.bookmark}/{name}")
        system.create_dir(posixpath.dirname(at), recursive=True)
        with system.open_output_stream(f"{at}.part") as f:
            f.write(json.dumps(value).encode())
        system.move(f"{at}.part", at)

    def _taken(self) -> int:
        system, at = _opened(f"{self.bookmark}/taken.json")
        if system.get_file_info(at).type == fs.FileType.NotFound:
            return 0
        with system.open_input_stream(at) as f:
            return json.loads(f.read())

    def _load(self) -> None:
        self.done = {}
        while True:
            system, at = self._plan_file(self.planned + 1)
            if system.get_file_info(at).type == fs.FileType.NotFound:
                return
            self._add(self._plan(self.planned + 1))

    def _add(self, plan) -> None:
        for file, _, end in plan:
            self.done[file] = max(end, self.done.get(file, 0))
        self.planned += 1

    def _next(self) -> list[tuple[str, int, int]]:
        """The next bytes, by file name; a compressed file is one range, however long."""
        system, at = _opened(self.folder)
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True))
        left, out = self.max_bytes, []
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            name = f.path.removeprefix(at).lstrip("/")
            if any(p.startswith(("_", ".")) for p in name.split("/")) or not name.removesuffix(".gz").endswith(self.ends):
                continue
            begin = self.done.get(name, 0)
            end = f.size if name.endswith(".gz") else min(f.size, begin + left)
            if begin < f.size and left > 0:
                out.append((name, begin, end))
                left -= end - begin
            if left <= 0:
                break
        return out

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        if self.done is None:
            self._load()
        taken = self._taken()
        if self.planned == taken and (plan := self._next()):
            self._write(f"plan-{self.planned + 1:09d}.json", plan)
            self._add(plan)
        return {"step": min(self.planned, taken + 1)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out, size = [], 0
        for step in range(start["step"] + 1, end["step"] + 1):
            for file, begin, stop in self._plan(step):
                cuts = [begin, stop] if file.endswith(".gz") else [*range(begin, stop, self.split_bytes), stop]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if not out or size + b - a > self.split_bytes:
                        out.append([])
                        size = 0
                    out[-1].append((file, a, b))
                    size += b - a
        if end["step"] > self._taken():
            self._write("taken.json", end["step"])
        return [Range(r) for r in out]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, at = _opened(self.folder)
        rows: list[tuple] = []
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["file", "start", "block"])

        for file, begin, end in partition.ranges:
            if file.endswith(".gz"):
                stream = system.open_input_stream(f"{at}/{file}", compression="gzip")
                read, begin, end = (lambda _, n, s=stream: s.read(n)), 0, 1 << 62
            else:
                stream = system.open_input_file(f"{at}/{file}")
                read = lambda place, n, s=stream: s.read_at(n, place) if place < s.size() else b""
            with stream:
                for start, block in blocks_of(read, begin, end, self.mark, self.leads):
                    if block.strip():
                        rows.append((file, start, block.decode("utf-8", "replace")))
                        held += len(block)
                        if held > 1 << 22 or len(rows) >= 10_000:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()


class BlockFiles(DataSource):
    """format("text_blocks"): rows (file, start, block) of the files below path.

    bookmark: a folder of this stream's own, on storage that lasts. mark: what ends a block,
    or begins it with leads = true. ends: the files' endings, by commas; .gz may follow. max_bytes: of a step.
    """

    @classmethod
    def name(cls) -> str:
        return "text_blocks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


def text_blocks(spark: SparkSession, folder: str, bookmark: str, mark: str = "$$$$\n", leads: bool = False, ends: str = ".sdf", max_bytes: int = 1 << 34, split_bytes: int = 1 << 26) -> DataFrame:
    """Stream of (file, start, block): file below the folder, the byte at which the block begins (of a .gz file's text), and its text.

    Files are whole once they appear; one that grows goes on where it ended. Files of any
    name may appear at any time. Each step takes at most max_bytes, or one compressed file. A
    stream that is stopped, in mid-file or not, goes on with the next block under the same bookmark and checkpoint; an
    interrupted step is run again as it was. The folder and the bookmark lie where pyarrow's file systems reach.
    """
    spark.dataSource.register(BlockFiles)
    rows = spark.readStream.format("text_blocks").option("bookmark", bookmark).option("mark", mark).option("leads", str(leads).lower()).option("ends", ends)
    return rows.option("max_bytes", max_bytes).option("split_bytes", split_bytes).load(folder)
