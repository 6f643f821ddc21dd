"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample; at
every byte position the two directions' states give a language distribution,
and a document's probabilities pool those of all its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import small_batches, tidy

HIDDEN = 8
WINDOW = 96  # bytes the network reads at a stretch
PER_LANGUAGE = 300  # training documents of a language, at most; each is read whole
BATCHES = 500  # gradient steps of the training, at least
UNKNOWN = "und"


def _gate(x: np.ndarray) -> np.ndarray:
    """Hard sigmoid, in place."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0.0, 1.0, out=x)


@dataclass
class Direction:
    """One direction's parameters: input table (256, 3H: update, reset, candidate) and state weights."""

    table: np.ndarray
    gates: np.ndarray  # (H, 2H)
    cand: np.ndarray  # (H, H)

    @property
    def params(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.cand]

    def forward(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) over bytes (T, B); ``keep`` collects what the backward pass needs."""
        steps, width = data.shape
        hid = self.cand.shape[0]
        out = np.empty((steps, width, hid), np.float32)
        h = np.zeros((width, hid), np.float32)
        for t in range(steps):
            x = self.table[data[t]]
            zr = _gate(x[:, : 2 * hid] + h @ self.gates)
            z, r = zr[:, :hid], zr[:, hid:]
            c = (r * h) @ self.cand
            c += x[:, 2 * hid :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, zr, c))
            new = out[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            h = new
        return out

    def backward(self, data: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters from those of the states (T, B, H)."""
        hid = self.cand.shape[0]
        d_table, d_gates, d_cand = (np.zeros_like(p) for p in self.params)
        dh = np.zeros_like(grad[0])
        for t in range(len(data) - 1, -1, -1):
            h, zr, c = kept[t]
            z, r = zr[:, :hid], zr[:, hid:]
            dh = dh + grad[t]
            dc = dh * (1 - z) * (1 - c * c)
            back = dc @ self.cand.T
            open_gate = ((zr > 0) & (zr < 1)) * np.float32(0.25)
            dzr = np.concatenate((dh * (h - c), back * h), axis=1) * open_gate
            d_cand += (r * h).T @ dc
            d_gates += h.T @ dzr
            np.add.at(d_table, data[t], np.concatenate((dzr, dc), axis=1))
            dh = dh * z + back * r + dzr @ self.gates.T
        return [d_table, d_gates, d_cand]


@dataclass
class ByteTagger:
    """Forward and backward directions, and the output layer over both states."""

    ahead: Direction
    back: Direction
    weights: np.ndarray  # (2H, L)
    bias: np.ndarray  # (L,)
    labels: list[str]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 5) -> ByteTagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=1.0: (rng.standard_normal(shape) * s).astype(np.float32)
        side = lambda: Direction(draw(256, 3 * hidden, s=0.3), draw(hidden, 2 * hidden, s=0.3), draw(hidden, hidden, s=0.3))
        return cls(side(), side(), draw(2 * hidden, len(labels), s=0.3), np.zeros(len(labels), np.float32), list(labels))

    @property
    def params(self) -> list[np.ndarray]:
        return [*self.ahead.params, *self.back.params, self.weights, self.bias]

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Language probabilities (T, B, L) at every byte of (T, B)."""
        hid = self.ahead.cand.shape[0]
        logits = self.ahead.forward(data).reshape(-1, hid) @ self.weights[:hid]
        logits += self.back.forward(data[::-1])[::-1].reshape(-1, hid) @ self.weights[hid:]
        logits += self.bias
        return _softmax(logits).reshape(*data.shape, -1)

    def gradients(self, data: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over real positions, and its gradients, by backpropagation through time."""
        hid = self.ahead.cand.shape[0]
        kept_a: list = []
        kept_b: list = []
        a = self.ahead.forward(data, kept_a)
        b = self.back.forward(data[::-1], kept_b)[::-1]
        both = np.concatenate((a, b), axis=2)
        p = _softmax((both.reshape(-1, 2 * hid) @ self.weights + self.bias)).reshape(*data.shape, -1)
        count = max(1, int(real.sum()))
        at = np.arange(data.shape[1])
        loss = float(-(np.log(p[:, at, label] + 1e-9) * real).sum() / count)
        p[:, at, label] -= 1
        p *= real[:, :, None].astype(np.float32) / np.float32(count)
        flat = p.reshape(-1, p.shape[2])
        d_both = (flat @ self.weights.T).reshape(both.shape)
        grads = self.ahead.backward(data, kept_a, d_both[:, :, :hid])
        grads += self.back.backward(data[::-1], kept_b, d_both[::-1, :, hid:])
        return loss, [*grads, both.reshape(-1, 2 * hid).T @ flat, flat.sum(axis=0)]

    def fit(self, windows: list[bytes], label: np.ndarray, batches: int = BATCHES, batch: int = 64, rate: float = 0.02, seed: int = 9) -> ByteTagger:
        """Adam over shuffled batches of windows: every window once, and again until ``batches`` steps are made."""
        rng = np.random.default_rng(seed)
        epochs = -(-batches // -(-len(windows) // batch))
        first, second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        step, total = 0, max(1, epochs * -(-len(windows) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                data, real = _padded([windows[i] for i in pick], WINDOW)
                _, grads = self.gradients(data, real, label[pick])
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                shrink = min(1.0, 1.0 / max(size, 1e-9))
                now = rate * (1 - 0.9 * step / total)
                for p, g, m, v in zip(self.params, grads, first, second):
                    g = g * np.float32(shrink)
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, texts: list[str | None], width: int = 2048) -> np.ndarray:
        """Pooled probabilities (documents, L): the mean over all byte positions; rows of zeros for empty texts.

        A text is read in stretches of WINDOW bytes from its start to its end;
        ``width`` stretches, of any documents, are read side by side.
        """
        total = np.zeros((len(texts), len(self.labels)))
        seen = np.zeros(len(texts), np.int64)
        todo: list[bytes] = []
        owner: list[int] = []

        def run() -> None:
            data, real = _padded(todo, WINDOW)
            p = self.positions(data)
            p *= real[:, :, None]
            np.add.at(total, owner, p.sum(axis=0))
            todo.clear()
            owner.clear()

        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "surrogatepass")
            seen[i] = len(raw)
            for at in range(0, len(raw), WINDOW):
                todo.append(raw[at : at + WINDOW])
                owner.append(i)
                if len(todo) == width:
                    run()
        if todo:
            run()
        return total / np.maximum(seen, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _padded(windows: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (T, B), short windows filled with zero bytes, and which positions are real."""
    flat = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in windows), np.uint8).reshape(len(windows), steps)
    size = np.array([len(w) for w in windows])
    longest = int(size.max(initial=1))
    return np.ascontiguousarray(flat.T[:longest]), np.arange(longest)[:, None] < size[None, :]


def fold(id_col: str):
    """0 to 4 from the crc32 of the id written as text; 0 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE
) -> ByteTagger | None:
    """A tagger from at most ``per_language`` documents of each language outside fold 0, chosen by hash of the id.

    Languages are counted without reading texts; about the wanted number of
    each is picked by hash, then cut to the bound. The documents chosen are
    read whole, in the stretches in which predictions read them. Counts,
    sample and network grow with the number of languages. Rows with a null
    id, text or language take no part; None if nothing is labelled.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != 0))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    dice = F.pmod(F.xxhash64("id", F.lit(77)), F.lit(1 << 20)) / float(1 << 20)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * per_language / r["n"])) for r in counts], "lang string, share double")
    best = Window.partitionBy("lang").orderBy("dice", "id", F.xxhash64("text"))
    chosen = (
        known.withColumn("dice", dice)
        .join(F.broadcast(shares), "lang")
        .where("dice < share")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= per_language)
        .orderBy("lang", "rank")
        .select("lang", "text")
        .collect()
    )
    labels = sorted({r["lang"] for r in chosen if r["text"]})
    if not labels:
        return None
    windows, label = [], []
    for r in chosen:
        raw = r["text"].encode("utf-8", "surrogatepass")
        windows += [raw[at : at + WINDOW] for at in range(0, len(raw), WINDOW)]
        label += [labels.index(r["lang"])] * -(-len(raw) // WINDOW) if raw else []
    return ByteTagger.fresh(labels).fit(windows, np.array(label))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(
    docs: DataFrame, tagger: ByteTagger | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` and the ``carry`` columns, one row per row of ``docs``.

    ``score`` is the pooled probability of the language given. Texts that are
    null or have no letter read ``und`` with score 0; so does everything if
    nothing could be learned. A null id is not held out. Columns not carried
    are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    schema = docs.schema
    source = docs.select(
        F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("_out"), *[F.col(c).alias(f"_c_{c}") for c in carry]
    )
    kept = [f"_c_{c}" for c in carry]

    @tidy
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["_text"].tolist()
            known = np.array([tagger is not None and has_letter(t) for t in texts], bool)
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            rows = np.flatnonzero(known)
            if len(rows):
                p = tagger.documents([texts[i] for i in rows])
                best = p.argmax(axis=1)
                lang[rows] = np.array(tagger.labels, object)[best]
                score[rows] = np.clip(p[np.arange(len(rows)), best], 0.0, 1.0)
            yield pdf[["_id", "_out", *kept]].assign(lang_pred=lang, score=score)

    kinds = "".join(f", `_c_{c}` {schema[c].dataType.simpleString()}" for c in carry)
    found = source.mapInPandas(predict, f"_id string, _out boolean{kinds}, lang_pred string, score double")
    return found.select(
        F.col("_id").cast(schema[id_col].dataType).alias(id_col), F.col("_out").alias("held_out"), "lang_pred", "score", *[F.col(f"_c_{c}").alias(c) for c in carry]
    )
