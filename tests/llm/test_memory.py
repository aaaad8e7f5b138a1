"""What a Python worker takes counts beside its executor's heap, and it keeps what it has taken."""

import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle

from copse.llm import common, packing
from copse.llm.queries import tokenizer_path

ROOT = Path(__file__).resolve().parents[2]
#: As a worker does it: the pickled task over a full batch.
TASK = """
import pickle, re, sys
import pyarrow as pa
batch = pa.ipc.open_stream(open("batch", "rb").read()).read_next_batch()
make = pickle.load(open("make", "rb"))
peak = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
before = peak()
rows = sum(out.num_rows for out in make()(batch))
print(rows, peak() - before)
"""


def test_packing_worker(spark, tmp_path, monkeypatch):
    """10,000 texts, 30 MB, that have few words in common."""
    rng = random.Random(1)
    texts = (" ".join(rng.choice("žbcdfghk") + "".join(rng.choices("aeioulmnrst", k=6)) for _ in range(400)) for _ in range(10_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    with pa.ipc.new_stream(tmp_path / "batch", batch.schema) as out:
        out.write_batch(batch)
    monkeypatch.setattr(common, "map_batches", lambda df, make, schema: make)
    make = packing.pieces(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path())
    (tmp_path / "make").write_bytes(cloudpickle.dumps(make))
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r})\n{TASK}"
    rows, mb = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(rows) >= 10_000
    assert float(mb) < 130
