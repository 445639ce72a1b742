"""Language identification with a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows. In each window a forward and a backward recurrent
layer (gated: update and reset) read the bytes, and a softmax over both states labels every
position with language probabilities. A document's probabilities are the means over its
positions. The network is trained here in numpy, by backpropagation through time, on windows from
a bounded sample of labelled documents: ``PER_LANGUAGE`` documents of each of at most
``LANGUAGES`` languages, ``WINDOWS`` windows of each, drawn from anywhere in the text. Both the
sample and the training are deterministic.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if there
is nothing to learn from. Documents whose language is null are not learned from. Repeated rows get
equal results. Documents without id are never held out nor learned from. Predictions depend on
the text alone. Columns other than id, text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import words as W

PER_LANGUAGE, LANGUAGES, WINDOWS = 500, 256, 4
#: Times the sample whose hashes are ranked.
SPARE = 4
#: Bytes of a window, state size per direction, windows that are read at once.
WINDOW, STATE, BATCH = 128, 8, 2048
EPOCHS, MINIBATCH, RATE = 6, 128, 0.01
PAD = 256
UNKNOWN = "und"


class Direction:
    """One gated recurrent layer. A byte's share in the gates is a table row: z update, r reset, c
    candidate. Gates are piecewise linear. The padding byte keeps the state as it is."""

    NAMES = ("z", "r", "c")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator, state: int) -> Direction:
        weights = {f"t{n}": rng.normal(0, 0.3, (257, state)).astype(np.float32) for n in cls.NAMES}
        weights |= {f"u{n}": (rng.normal(0, 1, (state, state)) / np.sqrt(state)).astype(np.float32) for n in cls.NAMES}
        return cls(weights).closed()

    def closed(self) -> Direction:
        self.w["tz"][PAD] = -100
        return self

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.w
        z, r, c = h @ w["uz"], h @ w["ur"], h @ w["uc"]
        z += w["tz"].take(x, axis=0)
        r += w["tr"].take(x, axis=0)
        for gate in (z, r):
            gate *= 0.25
            gate += 0.5
            np.clip(gate, 0, 1, out=gate)
        carried = c.copy()
        c *= r
        c += w["tc"].take(x, axis=0)
        np.tanh(c, out=c)
        return h + z * (c - h), z, r, c, carried

    def run(self, x: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """The state after each row of ``x`` (positions by windows)."""
        h = np.zeros((x.shape[1], len(self.w["uz"])), np.float32)
        for row in x:
            new, *rest = self.step(row, h)
            if keep is not None:
                keep.append((row, h, *rest))
            h = new
            yield h

    def back(self, kept: list, given: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of all weights, from those of the states after each step."""
        w, grads = self.w, {n: np.zeros_like(x) for n, x in self.w.items()}
        dh = np.zeros_like(given[0])
        deltas = {n: [] for n in self.NAMES}
        for (_, h, z, r, c, carried), dy in zip(reversed(kept), reversed(given)):
            dh = dh + dy
            dz = dh * (c - h) * 0.25 * ((z > 0) & (z < 1))
            dc = dh * z * (1 - c * c)
            dr = dc * carried * 0.25 * ((r > 0) & (r < 1))
            dm = dc * r
            grads["uz"] += h.T @ dz
            grads["ur"] += h.T @ dr
            grads["uc"] += h.T @ dm
            dh = dh * (1 - z) + dz @ w["uz"].T + dr @ w["ur"].T + dm @ w["uc"].T
            for name, d in (("z", dz), ("r", dr), ("c", dc)):
                deltas[name].append(d)
        rows = np.concatenate([k[0] for k in reversed(kept)])
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        for name, parts in deltas.items():
            grads[f"t{name}"][rows[order][first]] = np.add.reduceat(np.concatenate(parts)[order], first, axis=0)
        return grads


class Network:
    """Both directions and the softmax over languages at each position."""

    def __init__(self, languages: list[str], state: int = STATE, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forward, self.backward = Direction.fresh(rng, state), Direction.fresh(rng, state)
        self.head = {n: np.zeros((state, len(languages)), np.float32) for n in ("f", "b")} | {"bias": np.zeros(len(languages), np.float32)}

    def positions(self, x: np.ndarray, kept: tuple[list, list] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Position, both states and the probabilities there, from the last position to the first."""
        states = list(self.forward.run(x, kept and kept[0]))
        for back, h in enumerate(self.backward.run(x[::-1], kept and kept[1])):
            at = len(x) - 1 - back
            logits = states[at] @ self.head["f"]
            logits += h @ self.head["b"]
            logits += self.head["bias"]
            logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=1, keepdims=True)
            yield at, states[at], h, logits

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, size: int = MINIBATCH, rate: float = RATE, seed: int = 1) -> Network:
        """Adam on the mean cross entropy of all positions, padding aside."""
        rng = np.random.default_rng(seed)
        groups = (self.forward.w, self.backward.w, self.head)
        moments = [{n: (np.zeros_like(x), np.zeros_like(x)) for n, x in g.items()} for g in groups]
        step, steps = 0, epochs * -(-len(labels) // size)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), size):
                rows = order[at:at + size]
                step += 1
                now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
                for group, grads, moment in zip(groups, self._gradients(windows[rows].T, labels[rows]), moments):
                    for name, g in grads.items():
                        m, v = moment[name]
                        m += 0.1 * (g - m)
                        v += 0.01 * (g * g - v)
                        group[name] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                self.forward.closed()
                self.backward.closed()
        return self

    def _gradients(self, x: np.ndarray, labels: np.ndarray) -> tuple[dict, dict, dict]:
        kept: tuple[list, list] = ([], [])
        x = np.ascontiguousarray(x)
        real = (x != PAD).astype(np.float32)
        real /= real.sum()
        head = {n: np.zeros_like(w) for n, w in self.head.items()}
        to_forward, to_backward = [np.empty(0)] * len(x), []
        for at, f, b, p in self.positions(x, kept):
            p[np.arange(len(labels)), labels] -= 1
            p *= real[at][:, None]
            head["f"] += f.T @ p
            head["b"] += b.T @ p
            head["bias"] += p.sum(axis=0)
            to_forward[at] = p @ self.head["f"].T
            to_backward.append(p @ self.head["b"].T)
        return self.forward.back(kept[0], to_forward), self.backward.back(kept[1], to_backward), head

    def pooled(self, texts: W.Texts) -> np.ndarray:
        """Per text, the mean of its positions' probabilities; zero for an empty text."""
        out = np.zeros((len(texts), len(self.languages)))
        for owner, x in cut(texts, BATCH):
            total = np.zeros((x.shape[1], len(self.languages)), np.float32)
            real = (x != PAD).astype(np.float32)
            for at, _, _, p in self.positions(x):
                total += p * real[at][:, None]
            np.add.at(out, owner, total)
        return out / np.maximum(np.diff(texts.offsets), 1)[:, None]


def cut(texts: W.Texts, batch: int, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of the texts' bytes, with the number of the text each comes from: (windows, positions by windows)."""
    sizes = np.diff(texts.offsets)
    count = -(-sizes // window)
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = texts.offsets[owner] + nth * window
    end = np.minimum(start + window, texts.offsets[owner + 1])
    for at in range(0, len(owner), batch):
        part = slice(at, at + batch)
        place = start[part] + np.arange(window)[:, None]
        x = np.where(place < end[part], texts.data[np.minimum(place, len(texts.data) - 1)], PAD)
        yield owner[part], x


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """``per_language`` documents (all, if fewer) of each of the most frequent ``languages``, drawn row by
    row by a hash of id and text. Rows with null text, language or id are left out; equal rows are
    one. The hashes are chosen first, without the texts."""
    drawn = F.xxhash64(F.lit("language"), "id", "t")
    rows = docs.where("id IS NOT NULL AND lang IS NOT NULL AND t != ''").select(F.col("id").cast("long"), "t", "lang", drawn.alias("drawn"))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    hashes = rows.join(F.broadcast(most.select("lang")), "lang").select("lang", "drawn").distinct()
    # A hash is a number between 0 and 1. Some ``SPARE * per_language`` are below SPARE * per_language / count, so
    # only these are ranked; that fewer than ``per_language`` are does not happen.
    share = F.pmod("drawn", F.lit(1 << 40)) / F.lit(1 << 40)
    low = hashes.join(F.broadcast(hashes.groupBy("lang").count()), "lang").withColumn("share", share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("share", "drawn"))
    low = low.where(F.col("share") * F.col("count") < SPARE * per_language).withColumn("place", place)
    chosen = low.where(F.col("place") <= per_language).select("lang", "drawn")
    return rows.join(F.broadcast(chosen), ["lang", "drawn"]).dropDuplicates(["lang", "drawn"]).select("id", "t", "lang")


def windows_of(rows: DataFrame, windows: int) -> DataFrame:
    """At most ``windows`` windows of each sampled text, from places drawn by its id; so the driver
    gets some bytes of a text, however long it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                places = np.random.default_rng(abs(key)).integers(0, max(1, len(data) - WINDOW + 1), min(windows, -(-len(data) // WINDOW)))
                out += [(key, lang, nth, data[start:start + WINDOW]) for nth, start in enumerate(places.tolist())]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], ["id", "lang", "nth", "data"])

    return rows.mapInArrow(run, "id long, lang string, nth int, data binary").orderBy("id", "lang", "nth", "data")


def learn(docs: DataFrame, state: int = STATE, per_language: int = PER_LANGUAGE, windows: int = WINDOWS) -> Network | None:
    """A network trained on a sample of ``docs`` (id, t, lang), or None if that is empty."""
    rows = windows_of(sample(docs, per_language), windows).toArrow()
    if not rows.num_rows:
        return None
    languages = rows.column("lang").to_pylist()
    names = sorted(set(languages))
    number = {name: i for i, name in enumerate(names)}
    x = np.full((len(languages), WINDOW), PAD)
    for row, data in zip(x, rows.column("data").to_pylist()):
        row[:len(data)] = np.frombuffer(data, np.uint8)
    return Network(names, state).train(x, np.array([number[name] for name in languages]))


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' ids with ``lang_pred``, its ``score`` and the ``probabilities`` by language."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("t"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    schema = f"`{id_col}` {source.dtypes[0][1]}, lang_pred string, score double, probabilities map<string, double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in W.slices(batch, "t"):
                n = len(column)
                letter = batch.column(2).slice(first, n).to_numpy(zero_copy_only=False) & (network is not None)
                p = np.zeros((n, 1)) if network is None else network.pooled(W.Texts.of(column))
                best = p.argmax(axis=1)
                names = [network.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
                score = np.where(letter, np.minimum(p[np.arange(n), best], 1.0), 0.0)
                by_name = [list(zip(network.languages, row)) if ok else [] for row, ok in zip(p.tolist(), letter)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(names), pa.array(score), pa.array(by_name, pa.map_(pa.string(), pa.float64()))],
                    [id_col, "lang_pred", "score", "probabilities"],
                )

    return source.mapInArrow(run, schema)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = learn(docs.where(~held_out("doc_id", 4, 2)).select(F.col("doc_id").alias("id"), F.col("text").alias("t"), "lang"))
    return predict(docs, network).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
