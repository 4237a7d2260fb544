"""Files delivered to a store and deleted from it, with a receipt for each.

A plan is a table; tasks put its files one by one, try each a few times, and
give a receipt. A failure is a row, not an error, so that one file stops no
other. Receipts are written before they are handed on, so that looking at them
twice delivers nothing twice; and a file that is there already, with the same
content, is not sent again, so that a task that runs again does no harm.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import written

ATTEMPTS = 3
#: Files of one batch that a task holds.
BATCH = 64
RECEIPT = "target string, status string, attempts int, bytes long, sha256 string"


class Store(Protocol):
    """Where files go. A store is sent to the tasks, so it opens its connections when it is used."""

    def digest(self, target: str) -> str | None:
        """The SHA-256 of what is at a target, None if nothing is."""

    def put(self, target: str, content: bytes) -> None:
        """Put content at a target, whole or not at all, in place of what is there."""

    def delete(self, target: str) -> None:
        """Delete what is at a target, if anything is."""


class FolderStore:
    """A folder of a file system that pyarrow knows by its address."""

    def __init__(self, root: str):
        self.root = root

    def _open(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")
        return fs, system, base

    def digest(self, target: str) -> str | None:
        fs, system, base = self._open()
        if system.get_file_info(f"{base}/{target}").type != fs.FileType.File:
            return None
        state = hashlib.sha256()
        with system.open_input_stream(f"{base}/{target}") as f:
            while block := f.read(1 << 20):
                state.update(block)
        return state.hexdigest()

    def put(self, target: str, content: bytes) -> None:
        _, system, base = self._open()
        path = f"{base}/{target}"
        system.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{hashlib.sha256(content).hexdigest()[:16]}.part"
        with system.open_output_stream(part) as f:
            f.write(content)
        system.move(part, path)

    def delete(self, target: str) -> None:
        fs, system, base = self._open()
        if system.get_file_info(f"{base}/{target}").type == fs.FileType.File:
            system.delete_file(f"{base}/{target}")


def _tried(act, attempts: int, wait: float) -> tuple[str, int]:
    """Status and number of attempts of an act."""
    for n in range(1, attempts + 1):
        try:
            return act(), n
        except Exception as e:  # a store's errors are of any kind, and become rows
            error = f"FAIL:{e}"
        if n < attempts:
            time.sleep(wait * n)
    return error, attempts


def deliver(plan: DataFrame, store: Store, attempts: int = ATTEMPTS, wait: float = 0.0) -> DataFrame:
    """A receipt (RECEIPT) for each target of plan(target, content: binary).

    status: OK, SKIP:there, or FAIL and why. Rows that repeat are one file; a
    target with different contents is not delivered at all, and neither is one
    without content. Rows without a target are left out.
    """
    rows = plan.where(F.col("target").isNotNull()).select("target", "content", F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256"))
    kinds = rows.groupBy("target").agg(F.min("sha256").alias("_a"), F.max("sha256").alias("_b"))
    torn = kinds.where(F.col("_a") != F.col("_b")).select("target")
    refused = torn.select("target", F.lit("FAIL:more than one content").alias("status"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("bytes"), F.lit("").alias("sha256"))
    sent = rows.join(torn, "target", "left_anti").dropDuplicates(["target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                out = []
                for target, content, digest in zip(*(c.to_pylist() for c in b.slice(k, BATCH).columns), strict=True):

                    def act(target=target, content=content, digest=digest) -> str:
                        if store.digest(target) == digest:
                            return "SKIP:there"
                        store.put(target, content)
                        return "OK"

                    status, n = ("FAIL:no content", 0) if content is None else _tried(act, attempts, wait)
                    out.append((target, status, n, len(content or b""), digest))
                yield _receipts(out)

    return written(sent.mapInArrow(run, RECEIPT).unionByName(refused), "receipts")


def remove(plan: DataFrame, store: Store, attempts: int = ATTEMPTS, wait: float = 0.0) -> DataFrame:
    """A receipt for each different path of plan(path) that is deleted; one that is not there is none to complain of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for target in b.column(0).to_pylist():

                def act(target=target) -> str:
                    store.delete(target)
                    return "OK"

                out.append((target, *_tried(act, attempts, wait), 0, ""))
            yield _receipts(out)

    paths = plan.where(F.col("path").isNotNull()).select(F.col("path").alias("target")).distinct()
    return written(paths.mapInArrow(run, RECEIPT), "receipts")


def _receipts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECEIPT.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
