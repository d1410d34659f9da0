"""Op 8: toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a word vector (words of the training vocabulary),
of vectors of its prefixes and suffixes, and of the last state of a recurrent
network that reads its characters one by one, so unseen inflections and
spellings are understood. Of a long word the front and the end are read so, and
pieces of its middle follow as words of their own: texts of a script without
spaces are read whole. Windows of `LENGTH` words, each half overlapped by the next,
cover the whole text; a window is read forwards and backwards, pooled by
attention and mapped to a logit; a document scores by its largest window,
calibrated on labelled documents left out of the training.

Training (numpy, in a process beside the driver) sees a bounded sample of
labelled documents: at most `per_class` of each class. Labels are of documents, so windows are
chosen in rounds: first by word statistics, then by the network itself.
Scoring is one pass without shuffle; the model (below 10 MB by construction)
is broadcast. Null and empty texts have one empty window and get its score;
rows are judged one by one; with no labels all scores are 0.5. A doc_id that is
labelled twice counts as 1 if any label is; of several texts under one labelled
doc_id the smallest is learnt from.
"""

from __future__ import annotations

import os
import pickle
import subprocess
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm import textkit as tk
from kinlink.llm.network import END, FRONT, LENGTH, SLICE, Network, _gather, features, train, windows, with_middles  # noqa: F401


def fitted(texts: list[str], labels: np.ndarray, prior: float | None = None) -> Network | None:
    """`train` in a process of its own: what training takes goes back to the machine when it ends."""
    if len(set(np.asarray(labels).tolist())) < 2:
        return None
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import pickle, sys; from kinlink.llm import network as t; sys.stdout.buffer.write(pickle.dumps(t.train(*pickle.load(sys.stdin.buffer))))"
    env = os.environ | {"PYTHONPATH": os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH")) if x)}
    return pickle.loads(subprocess.run([sys.executable, "-c", code], input=pickle.dumps((texts, labels, prior)), stdout=subprocess.PIPE, env=env, check=True).stdout)


def labelled(docs: DataFrame, labels: DataFrame, column: str, usable, per_class: int):
    """Bounded sample of labelled documents: (texts, labels, share of ones). usable: which rows of labels may be learnt from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where(usable).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {x["y"]: x["count"] for x in known.groupBy("y").count().collect()}
    some = known.where(F.lit(False))
    for y in counts:
        some = some.unionByName(known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    ids = some.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # at most 2 x per_class rows
    got = sorted(rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y")).collect())
    return [x["text"] for x in got], np.array([x["y"] for x in got], int), counts.get(1, 0) / max(1, sum(counts.values()))


def score_toxicity(docs: DataFrame, labels: DataFrame, usable="true", per_class: int = 1200, column: str = "toxic", untrained: float = 0.5, out: str = "toxicity") -> DataFrame:
    """docs with column `out` (0 to 1); other columns stay, one of that name is replaced. Learns from labels (doc_id, column) where `usable` holds; every row gets `untrained` where these lack a class."""
    usable = F.expr(usable) if isinstance(usable, str) else usable
    net = fitted(*labelled(docs, labels, column, usable, per_class))
    docs = docs.drop(out)
    if net is None:
        return docs.withColumn(out, F.lit(float(untrained)))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    @tk.frugal
    def score(batches):
        net = shared.value
        for b in batches:
            buf, off = tk.buffer_of(b.column("text").cast(pa.string()))
            for a, z in tk.slices(off, SLICE):
                names, grams, chars, inv, first = features(buf[off[a] : off[z]], off[a : z + 1] - off[a])
                x = net.embed(*net.inputs(names, grams), chars)
                begin, count, doc = windows(first)
                top = np.full(z - a, -np.inf)
                for i in range(0, len(begin), 4096):
                    part = slice(i, i + 4096)
                    np.maximum.at(top, doc[part], net.logits(x, _gather(begin[part], count[part], inv), 4096))
                p = 1 / (1 + np.exp(-np.clip(net.slope * top + net.shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([*b.slice(a, z - a).columns, pa.array(p, pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(score, schema)
