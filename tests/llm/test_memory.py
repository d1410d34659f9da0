"""What Python workers take and keep: an executor holds several beside its heap."""

import os
import random
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa


def test_workers_of_the_pipeline_load_no_pandas():
    code = "import sys; from kinlink.llm import decontam, mixing, ngram_join, toxicity; print('pandas' in sys.modules)"
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, check=True).stdout.strip() == "False"


def test_packing_entries_takes_little(prose):
    from kinlink.llm import textkit as tk
    from kinlink.llm.ngram_join import Bands, Shingles, _packed

    r = random.Random(5)
    sets = Shingles(*tk.buffer_of(pa.array([prose(r, 300) for _ in range(1000)])), 5).sets
    tracemalloc.start()
    _, out = _packed(sets, Bands(75), 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * sum(len(x[2]) for x in out)


def test_what_a_task_has_freed_goes_back():
    from kinlink.llm import textkit as tk

    def grow(batches):
        for b in batches:
            held = [np.ones(1 << 14, np.uint8) for _ in range(6000)]
            keep.append(held[-1])  # the last one lies above all others: without a trim they stay
            yield b

    keep: list = []
    before = tk.private_bytes()
    assert list(tk.frugal(grow)(iter([1, 2]))) == [1, 2]
    assert tk.frugal(lambda t: t + 1)(1) == 2
    assert tk.private_bytes() - before < 40 << 20


def test_mixture_reads_no_rows_from_python(spark):
    from kinlink.llm.mixing import mix_sources

    docs = spark.createDataFrame([(i, "a b c " * (1 + i % 5), "st"[i % 2]) for i in range(60)] + [(None, "a b", None)], "doc_id long, text string, source string")
    out = mix_sources(docs)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert out.count() == 61 and "LocalRelation" in plan
    # rows handed over one by one come as an RDD of Python objects
    assert out._jdf.queryExecution().toRdd().toDebugString().count("PythonRDD") == 0
