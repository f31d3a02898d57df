"""Part files that tasks write to a folder all executors mount, whole or not at all."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


def write(rows: DataFrame, path: str, suffix: str, index_suffix: str, write_part: Callable[[Iterator, str, str], None]) -> None:
    """Writes each partition of rows by write_part(rows, file, index file) under names that are final once a part is whole.

    An existing folder is an error.  A failed job leaves no folder; a finished one
    holds _SUCCESS.
    """
    os.makedirs(path)

    def part(some: Iterator) -> None:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = os.path.join(path, f"part-{context.partitionId():05d}{suffix}")
        own = os.path.join(path, f".{context.taskAttemptId()}")
        write_part(some, own, own + ".index")
        os.replace(own + ".index", name + index_suffix)
        os.replace(own, name)

    try:
        rows.foreachPartition(part)
    except BaseException:
        shutil.rmtree(path, ignore_errors=True)
        raise
    with open(os.path.join(path, "_SUCCESS"), "wb"):
        pass
