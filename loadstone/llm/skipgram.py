"""Skip-gram vectors with negative sampling of numbered tokens, trained in shards of a set size and averaged."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens before and behind that count as context; wrong tokens per pair; pairs that step together; learning rate; passes.
WINDOW, NEGATIVE, STEP, RATE, PASSES = 3, 3, 2048, 0.05, 2
#: Sentences that train one model. Shards depend on the data only, never on the number of cores.
SHARD = 40_000


class Model:
    """Vectors of tokens 0 to n - 1, from a start that depends on the seed only."""

    def __init__(self, n: int, size: int, seed: int) -> None:
        self.inner = (np.random.default_rng(seed).uniform(-0.5, 0.5, (n, size)) / math.sqrt(size)).astype(np.float32)
        self.outer = np.zeros((n, size), np.float32)

    def train(self, tokens: np.ndarray, sentence: np.ndarray, random: np.random.Generator) -> None:
        """One pass over the pairs of a batch; wrong tokens are drawn from the batch, so by their frequency."""
        firsts, seconds = [], []
        for d in range(1, WINDOW + 1):
            near = np.flatnonzero((sentence[d:] == sentence[:-d]) & (tokens[d:] != tokens[:-d]))
            firsts += [tokens[near], tokens[near + d]]
            seconds += [tokens[near + d], tokens[near]]
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        order = random.permutation(len(a))
        for at in range(0, len(a), STEP):
            c, o = a[order[at : at + STEP]], b[order[at : at + STEP]]
            target = np.concatenate([o[:, None], tokens[random.integers(0, len(tokens), (len(c), NEGATIVE))]], axis=1)
            u, v = self.inner[c], self.outer[target]
            g = -1 / (1 + np.exp(-np.clip(np.matmul(v, u[:, :, None])[:, :, 0], -30, 30)))
            g[:, 0] += 1
            self._add(self.inner, c, np.matmul(g[:, None, :], v)[:, 0])
            self._add(self.outer, target.ravel(), (g[:, :, None] * u[:, None, :]).reshape(-1, u.shape[1]))

    def _add(self, table: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
        """Add the changes of each row, in sum; of a row that is met n times in a step, divided by the root of n."""
        order = np.argsort(rows, kind="stable")
        sorted_rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        times = np.diff(np.append(first, len(rows)))
        table[sorted_rows[first]] += RATE * np.add.reduceat(change[order], first, axis=0) / np.sqrt(times)[:, None]


def train_vectors(sentences: DataFrame, tokens: int, size: int = 64, seed: int = 7, column: str = "path", sentences_expected: int | None = None) -> DataFrame:
    """Vectors of the tokens of `sentences` (an array of numbers below `tokens`): token, n, v (array of floats).

    The sentences are spread over ceil(sentences / SHARD) shards by their hash and ordered in them, so the result depends
    on the data alone. Every shard trains a model from the same start; a token's vectors are averaged by how often it occurs
    in each. `sentences_expected` saves counting them. A model has a set size. Sentences of one token add to the counts only;
    no sentences give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, random, counts = Model(tokens, size, seed), np.random.default_rng(seed), np.zeros(tokens, np.int64)
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(flat):
                counts += np.bincount(flat, minlength=tokens)
                of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                for _ in range(PASSES if len(flat) > 1 else 0):
                    model.train(flat, of, random)
        met = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32) * size), pa.array(model.inner[met].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), lists], names=["token", "n", "v"])

    paths = sentences.select(column).filter(F.col(column).isNotNull())
    n = paths.count() if sentences_expected is None else sentences_expected
    spread = paths.repartition(max(1, math.ceil(n / SHARD)), F.xxhash64(column)).sortWithinPartitions(F.xxhash64(column, F.lit(seed)), column)
    models = spread.mapInArrow(run, "token int, n bigint, v array<float>")
    merged = models.groupBy("token").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("n", "v"))).alias("parts"))  # at most one part per shard
    total = F.aggregate("parts", F.array_repeat(F.lit(0.0), size), lambda s, p: F.zip_with(s, p["v"], lambda x, y: x + y.cast("double") * p["n"]))
    return merged.withColumn("total", total).select("token", "n", F.transform("total", lambda x: (x / F.col("n")).cast("float")).alias("v"))
