"""Workers give back what a task has freed."""

import subprocess
import sys
from pathlib import Path

CODE = """
import numpy as np, psutil, pyarrow as pa
from larkspur.llm import texts

held = []

def run(batches):
    for batch in batches:
        parts = [np.ones(60000, np.uint8) for _ in range(2000)]  # too small to be mapped one by one
        held.append(parts[-1])  # what stays keeps the rest of the heap below it
        yield batch

work = getattr(texts, "trimmed", lambda run: run)(run)
batch = pa.record_batch([pa.array([1])], ["x"])
list(work(iter([])))
before = psutil.Process().memory_info().rss
assert len(list(work(iter([batch])))) == 1
print((psutil.Process().memory_info().rss - before) >> 20)
"""


def test_a_task_gives_its_memory_back():
    root = Path(__file__).resolve().parents[2]
    kept = int(subprocess.run([sys.executable, "-c", CODE], cwd=root, capture_output=True, text=True, check=True).stdout)
    assert kept < 40, f"{kept} MB of 114 kept"
