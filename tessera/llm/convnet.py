"""Quality classifier: a byte-level convolutional network in numpy. Learned filters run over overlapping chunks that cover
the whole document; their maxima are pooled and combined into one probability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, fold, with_arrow

#: Bytes of a chunk and between chunk starts; bytes of a filter and between its places.
CHUNK, STEP, WIDTH, STRIDE = 512, 448, 8, 4
#: Numbers of a byte's embedding, of filters, of hidden units.
EMBED, FILTERS, HIDDEN = 6, 24, 16
#: Bound of the labelled rows of each class that the network is fitted on and of the chunks of each; rows of a step, and the least steps and epochs.
FIT_ROWS, FIT_CHUNKS, BATCH, LEAST_STEPS, LEAST_EPOCHS = 1000, 64, 16, 500, 4
#: Chunks computed together.
TOGETHER = 256
SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def chunks(raw: bytes) -> np.ndarray:
    """(n, CHUNK) bytes that cover the text; a short text is filled with bytes 0, the last chunk ends with the text."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= CHUNK:
        return np.concatenate([data, np.zeros(CHUNK - len(data), np.uint8)])[None]
    starts = np.append(np.arange(0, len(data) - CHUNK, STEP), len(data) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[starts]


def spread(raw: bytes) -> np.ndarray:
    """At most FIT_CHUNKS of the chunks, evenly spread over the text."""
    c = chunks(raw)
    return c if len(c) <= FIT_CHUNKS else c[np.linspace(0, len(c) - 1, FIT_CHUNKS).astype(int)]


def windows(c: np.ndarray) -> np.ndarray:
    """(chunks, places, WIDTH) bytes under the filters."""
    return np.lib.stride_tricks.sliding_window_view(c, WIDTH, 1)[:, ::STRIDE]


@dataclass
class Net:
    """embed: bytes; filters, bias: convolution; hidden, hidden_bias, out, out_bias: of the pooled maxima."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def new(seed: int = 7) -> Net:
        r = np.random.default_rng(seed)
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        return Net(f(256, EMBED, k=0.5), f(WIDTH * EMBED, FILTERS, k=0.15), np.zeros(FILTERS, np.float32), f(2 * FILTERS, HIDDEN, k=0.2), np.zeros(HIDDEN, np.float32), f(HIDDEN, k=0.2), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def pooled(self, c: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of the filters in each chunk, and their places if asked for."""
        w = windows(c)
        x = self.embed[w].reshape(-1, WIDTH * EMBED) @ self.filters
        x = x.reshape(len(c), -1, FILTERS)
        at = x.argmax(1) if where else None
        return np.maximum(x.max(1) + self.bias, 0), at

    def combined(self, top: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document features (mean and maximum over chunks), hidden units and logits."""
        f = np.concatenate([np.add.reduceat(top, first) / count[:, None], np.maximum.reduceat(top, first)], 1)
        h = np.tanh(f @ self.hidden + self.hidden_bias)
        return f, h, h @ self.out + self.out_bias

    def scores(self, raws: list[bytes]) -> np.ndarray:
        """Probability of good quality for each text, whole and by itself, so equal texts score alike."""
        out = np.empty(len(raws))
        for i, raw in enumerate(raws):
            c = chunks(raw)
            top = np.concatenate([self.pooled(c[k : k + TOGETHER])[0] for k in range(0, len(c), TOGETHER)])
            _, _, z = self.combined(top, np.array([0]), np.array([len(c)]))
            out[i] = 1 / (1 + np.exp(-float(np.clip(z[0], -30, 30))))
        return out


def fit(raws: list[bytes | np.ndarray], labels: list[int], weights: dict[int, float], seed: int = 7, batch: int = BATCH, rate: float = 4e-3) -> Net:
    """Adam on the weighted log loss of texts, or of their chunks. Without rows of both classes the network stays as drawn but for its bias."""
    net, r = Net.new(seed), np.random.default_rng(seed)
    total = {k: weights.get(k, 0.0) for k in (0, 1)}
    share = (total[1] + 1) / (total[0] + total[1] + 2)
    net.out_bias[:] = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        net.out[:] = 0
        return net
    y_all = np.array(labels, np.float32)
    per = {k: weights[k] / max(1, int((y_all == k).sum())) for k in (0, 1)}
    mean = (per[0] * (y_all == 0).sum() + per[1] * (y_all == 1).sum()) / len(y_all)
    cut = [chunks(x) if isinstance(x, bytes) else x for x in raws]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parts()]
    t, epochs = 0, max(LEAST_EPOCHS, -(-LEAST_STEPS * batch // len(raws)))
    for epoch in range(epochs):
        order = r.permutation(len(raws))
        for b in range(0, len(order), batch):
            some = order[b : b + batch]
            c = np.concatenate([cut[i] for i in some])
            count = np.array([len(cut[i]) for i in some])
            first = np.cumsum(count) - count
            doc = np.repeat(np.arange(len(some)), count)
            tops, ats = zip(*(net.pooled(c[k : k + TOGETHER], True) for k in range(0, len(c), TOGETHER)), strict=True)
            top, at = np.concatenate(tops), np.concatenate(ats)
            f, h, z = net.combined(top, first, count)
            y = y_all[some]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            dz = (p - y) * np.where(y > 0, per[1], per[0]) / mean / len(some)
            dh = dz[:, None] * net.out * (1 - h * h)
            df = dh @ net.hidden.T
            peak = top == f[doc, FILTERS:]
            share_of = peak / np.maximum(1, np.add.reduceat(peak, first, dtype=np.float32))[doc]
            dtop = (df[doc, :FILTERS] / count[doc, None] + df[doc, FILTERS:] * share_of) * (top > 0)
            seen = windows(c)[np.arange(len(c))[:, None], at]
            x = net.embed[seen].reshape(len(c), FILTERS, -1)
            dw = np.einsum("cf,cfk->kf", dtop, x)
            dx = (dtop[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            flat = seen.reshape(-1)
            de = np.stack([np.bincount(flat, dx[:, e], 256) for e in range(EMBED)], 1)
            grads = [de, dw, dtop.sum(0), f.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]
            t += 1
            now = rate * (1 - epoch / epochs)
            for q, g, s in zip(net.parts(), grads, state, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.99 * s[1] + 0.01 * g * g
                q -= (now * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Net:
    """The network from labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    At most FIT_ROWS rows of each class, those of the smallest id hashes; classes count by their share of all labelled
    rows. Rows with null labels or texts are left out. A text has FIT_CHUNKS chunks at most, spread evenly over the whole
    of it, so at most 2 * FIT_ROWS * FIT_CHUNKS * CHUNK bytes (65 MB) reach the driver.
    """
    rows = labels.where(F.col(label).isin(0, 1) & (fold("doc_id", 5) != 0)).select("doc_id", F.col(label).cast("int").alias("y"))
    counts = {r["y"]: float(r["count"]) for r in rows.groupBy("y").count().collect()}
    some = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
        some = part if some is None else some.unionByName(part)
    # at most 2 * FIT_ROWS ids
    picked = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")

    def make():
        return lambda batch: [[spread(x).tobytes() for x in bytes_of(batch, "text")]]

    cut = with_arrow(picked, T.StructType([T.StructField("chunks", T.BinaryType())]), make, keep=["doc_id", "y"]).orderBy("doc_id", "y", "chunks").collect()
    return fit([np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in cut], [r["y"] for r in cut], counts)


def quality_scores(docs: DataFrame, net: Net, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``score``, the probability that a text is of good quality.

    Null and empty texts are one chunk of bytes 0. Whole texts are read. Repeated rows get equal scores; a column named
    ``score`` is replaced; an empty table gives an empty result.
    """

    def make():
        return lambda batch: [net.scores(bytes_of(batch, text))]

    return with_arrow(docs, SCORE, make, text, keep)


__all__ = ["Net", "fit", "fitted", "quality_scores"]
