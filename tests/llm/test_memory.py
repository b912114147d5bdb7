"""Python workers wait for their next task without the memory of the last one."""

import os
import re
import subprocess
import sys

import pyarrow as pa
import pytest

from reviewlake.llm import order_minhash
from reviewlake.llm.common import trimmed


class Caught:
    """Stands for the table: gives the function that Spark would run in a worker."""

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


def texts(n=6_000, batches=2):
    """Batches of texts of 400 words."""
    for k in range(batches):
        rows = [" ".join(f"w{(i * 7919 + j * (i % 13 + 1)) % 50_021}" for j in range(400)) for i in range(k * n, (k + 1) * n)]
        yield pa.RecordBatch.from_arrays([pa.array(range(k * n, (k + 1) * n), pa.int64()), pa.array(rows, pa.string())], ["doc_id", "text"])


def own_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024


def kept_mb(name):
    """MB that a task leaves in a fresh process; its rows come ready from a file, as from Spark."""
    path = f"/proc/self/fd/{os.memfd_create('rows')}"
    child = os.fork()
    if not child:
        with open(path, "wb") as f, pa.ipc.new_stream(f, next(texts(1)).schema) as out:
            for batch in texts():
                out.write_batch(batch)
        os._exit(0)
    os.waitpid(child, 0)
    task = getattr(order_minhash, name)(Caught())
    for _ in task(pa.ipc.open_stream(open(path, "rb"))):
        pass
    return own_mb()


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
@pytest.mark.parametrize("name", ["_sketched", "_words"])
def test_a_task_leaves_little(name):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"import sys; sys.path[:0] = [{root!r}, {os.path.dirname(os.path.abspath(__file__))!r}]; import test_memory as t; a = t.own_mb(); print(t.kept_mb({name!r}) - a)"
    told = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(told.stdout) < 30


def test_all_batches_pass_through_and_errors_too():
    @trimmed
    def work(batches):
        for x in batches:
            yield 10 // x

    assert list(work(iter([1, 2, 5]))) == [10, 5, 2]
    with pytest.raises(ZeroDivisionError):
        list(work(iter([1, 0])))
