"""Memory of Python workers."""

from __future__ import annotations

import subprocess
import sys

from scholarframe.plans.tables import ARROW_ROWS, settle
from tests.conftest import ROOT

_HELD = """
import random, re, sys
import pyarrow as pa
from scholarframe.llm import ngram_join
from scholarframe.plans.tables import *
step = {}
class Docs:
    def mapInArrow(self, f, schema):
        step["f"] = f
        raise StopIteration
try:
    ngram_join._candidates(Docs(), None, 4, 85)
except StopIteration:
    pass
def texts():
    rng = random.Random(1)
    for k in range(6):
        yield pa.record_batch([pa.array(range(2000)), pa.array([" ".join(str(rng.randrange(9999)) for _ in range(400)) for _ in range(2000)])], ["doc_id", "text"])
def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024
before = held()
for _ in step["f"](texts()):
    pass
print(held() - before)
"""


def test_a_worker_that_idles_holds_little():
    """The step that hashes all texts leaves its worker without the memory that its batches took; it kept 106 MB before."""
    run = subprocess.run([sys.executable, "-c", _HELD], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) < 60


def test_settle_with_small_arrow_batches(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], ["n"])

    before = spark.conf.get(ARROW_ROWS)
    got = settle(spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long"), "sizes", 300).collect()
    assert [r.n for r in got] == [300, 300, 300, 100] and spark.conf.get(ARROW_ROWS) == before
