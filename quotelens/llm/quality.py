"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters look at overlapping chunks of 8 bytes, 4 bytes apart, over the
whole document. Beside them, wide filters look at overlapping chunks of 48 bytes, as far apart, and
see for each lag of 2 to 32 bytes which share of a chunk comes again that many bytes later: a word or
phrase that repeats fills such a chunk, whatever the word is. Each filter's largest response is kept,
and a small dense layer turns the pooled responses into one probability. Training fits on the driver over a bounded sample of labelled rows
(``sample_rows``, texts of at most ``sample_bytes``); scoring runs where documents are read, in
stretches of bounded size, so a text of any length is covered whole in the same memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import read, slices

STEP, WIDTH, EMBED, FILTERS, HIDDEN = 4, 8, 8, 32, 16
WIDE, LAGS, ECHOES = 48, range(2, 33), 8
#: Empty steps after each text, so that no chunk reaches into the next one.
TAIL = WIDE // STEP - 1
PAD = 256
STRETCH = 1 << 17
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 1 << 16
EPOCHS, BATCH, RATE = 8, 48, 0.01
ACCEPT = 0.7


class Network:
    """Parameters and the forward pass. ``prior`` answers for texts when there was nothing to learn from."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": draw(257, EMBED, scale=0.5),
            "filters": draw(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
            "echo": draw(len(LAGS), ECHOES, scale=len(LAGS) ** -0.5),
            "bias": np.zeros(FILTERS + ECHOES, np.float32),
            "hidden": draw(FILTERS + ECHOES, HIDDEN, scale=(FILTERS + ECHOES) ** -0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN, scale=HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }
        self.p["embed"][PAD] = 0
        self.prior: float | None = None

    def respond(self, data: np.ndarray) -> np.ndarray:
        """Responses of all chunks; ``data`` is a whole number of steps, and its last TAIL steps only end chunks."""
        steps = self.p["embed"][data].reshape(-1, STEP * EMBED)
        half, n = STEP * EMBED, len(steps) - TAIL
        narrow = steps[:n] @ self.p["filters"][:half] + steps[1 : n + 1] @ self.p["filters"][half:]
        return np.concatenate([narrow, echoes(data) @ self.p["echo"]], 1)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Largest response of each filter over each whole text."""
        out = np.full((len(texts), FILTERS + ECHOES), -np.inf, np.float32)
        for a, b in slices([len(t) for t in texts], STRETCH):
            if len(texts[a]) > STRETCH:
                for at in range(0, len(texts[a]), STRETCH):
                    # A stretch takes along what its last chunks hold of the next one.
                    responses = self.respond(laid_out([texts[a][at : at + STRETCH + TAIL * STEP]])[0])
                    np.maximum(out[a], responses[: STRETCH // STEP].max(0), out=out[a])
            else:
                data, starts = laid_out(texts[a:b])
                responses = self.respond(data)
                # Chunks that begin in a text's empty steps reach into the next text and are none.
                responses[(starts[1:, None] - np.arange(1, TAIL + 1)).ravel()] = -np.inf
                out[a:b] = np.maximum.reduceat(responses, starts, axis=0)
        return out + self.p["bias"]

    def head(self, pooled: np.ndarray):
        lively = np.maximum(pooled, 0)
        hidden = np.maximum(lively @ self.p["hidden"] + self.p["hidden_bias"], 0)
        return lively, hidden, hidden @ self.p["out"] + self.p["out_bias"][0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-self.head(self.pooled(texts))[2].astype(np.float64)))


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each padded to whole steps and followed by TAIL empty steps; first steps of each."""
    sizes = np.array([max(1, -(-len(t) // STEP)) + TAIL for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.full(starts[-1] * STEP, PAD, np.int16)
    for t, s in zip(texts, starts):
        data[s * STEP : s * STEP + len(t)] = np.frombuffer(t, np.uint8)
    return data, starts[:-1]


def echoes(data: np.ndarray) -> np.ndarray:
    """For each wide chunk and lag, the share of the chunk's bytes that stand again ``lag`` bytes later inside it."""
    n = len(data) // STEP - TAIL
    out = np.empty((len(LAGS), n), np.float32)
    again = np.zeros(len(data), bool)
    sums = np.zeros(len(data) // STEP + 1, np.int32)
    for k, lag in enumerate(LAGS):
        again[-lag:] = False
        np.equal(data[:-lag], data[lag:], out=again[:-lag])
        again[:-lag] &= data[:-lag] != PAD
        # The four flags of a step are added by one multiplication.
        np.cumsum((again.view(np.uint32) * np.uint32(0x01010101)) >> np.uint32(24), out=sums[1:])
        steps = (WIDE - lag) // STEP
        np.multiply(sums[steps : steps + n] - sums[:n], 1 / (steps * STEP), out=out[k])
    return out.T


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss; only the chunk that won each maximum carries a gradient."""
    net = Network(seed)
    ones = int(labels.sum())
    if ones == 0 or ones == len(labels):
        net.prior = (ones + 1) / (len(labels) + 2)
        return net
    rng = np.random.default_rng(seed)
    p = net.p
    p["out_bias"][0] = np.log(ones / (len(labels) - ones))
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    window = np.arange(WIDTH)
    done, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            data, starts = laid_out([texts[i] for i in chosen])
            responses = net.respond(data)
            ends = [*(starts[1:] - TAIL), len(responses)]
            heard = echoes(data)
            won = np.stack([s + responses[s:e].argmax(0) for s, e in zip(starts, ends)])
            pooled = np.take_along_axis(responses, won, 0) + p["bias"]
            lively, hidden, logit = net.head(pooled)
            error = (1 / (1 + np.exp(-logit)) - labels[chosen]) / len(chosen)
            d_hidden = np.outer(error, p["out"]) * (hidden > 0)
            d_pooled = (d_hidden @ p["hidden"].T) * (pooled > 0)
            d_narrow, d_wide = d_pooled[:, :FILTERS], d_pooled[:, FILTERS:]
            seen = data[won[:, :FILTERS, None] * STEP + window]
            looked = p["embed"][seen].reshape(len(chosen), FILTERS, -1)
            d_seen = (d_narrow[..., None] * p["filters"].T).reshape(-1, EMBED)
            d_embed = np.zeros_like(p["embed"])
            np.add.at(d_embed, seen.reshape(-1), d_seen)
            d_embed[PAD] = 0
            grads = {
                "embed": d_embed,
                "filters": np.einsum("df,dfk->kf", d_narrow, looked),
                "echo": np.einsum("df,dfk->kf", d_wide, heard[won[:, FILTERS:]]),
                "bias": d_pooled.sum(0),
                "hidden": lively.T @ d_hidden,
                "hidden_bias": d_hidden.sum(0),
                "out": hidden.T @ error,
                "out_bias": error.sum(keepdims=True),
            }
            done += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * done / total))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= rate * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.999**done)) + 1e-8)
    return net


def held_out(doc_id):
    """Documents that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Train on at most ``sample_rows`` labelled documents outside the held-out fold, taken by a hash of their ids.

    Each doc_id teaches one text, the smallest of its rows.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes)
    # Rows that share a doc_id become one before they reach the driver, so the bound holds for texts too.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text"), F.min("quality")).collect()
    rows.sort(key=lambda r: r[0])
    return train([r[1].encode() for r in rows], np.array([r[2] for r in rows], np.float32))


def _scorer(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            kept = [i for i in range(batch.num_columns) if keep_text or i != at]
            columns = [batch.column(i) for i in kept] + [pa.array(net.scores(texts), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in kept), "score"])

    return run


def score(docs: DataFrame, net: Network, keep_text: bool = False) -> DataFrame:
    """Add ``score`` (0 to 1, replacing a column of that name) to every row; ``text`` goes unless it is kept.

    Null texts score as empty ones, repeated rows alike, an empty table gives an empty one. No
    shuffle: the network is a few thousand numbers, sent to every executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.drop("score")
    out = [f for f in rows.schema if keep_text or f.name != "text"]
    return rows.mapInArrow(_scorer(shared, keep_text), StructType([*out, StructField("score", DoubleType())]))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, net).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )
