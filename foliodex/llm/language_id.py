"""Operator 9, language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. It reads a text's bytes in both directions, white
space and all, and labels every position with a distribution over the languages; a document's probabilities are
the normalised geometric mean of those of all its positions.

Texts of any length run as windows of CORE bytes, side by side, each with HALO bytes of the text before and after it: the states
run in over the halos, whose labels are not used, so every position is labelled once and has at least HALO bytes of
context on either side (or the text's end). Windows are ordered by length, so that none is padded. Where a cut falls in a
character does not matter, as the bytes before it are read too.

Training rows: documents with a language whose crc32 of the id, as text, is not 2 modulo 4, of them about `per_lang` per
language, picked by a hash of the id, and of each `per_text` characters from a hashed place on (documented bounds for fitting;
predictions read every byte of every row). Windows are drawn from the sample with equal weight for each language.

Cases: a null text, or one without a letter (Unicode category L), is `und` with score 0; so is every text if no row has a language. A null
id is never trained on and not held out. Rows that repeat get the same answer; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces_of

HIDDEN = 8
CORE, HALO = 1024, 64


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def new_params(languages: int, rng: np.random.Generator, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    p = {}
    for d in "fb":
        p[f"x{d}"] = draw(256, 3 * hidden, scale=0.3)
        p[f"u{d}"] = draw(hidden, 3 * hidden, scale=hidden**-0.5)
    return p | {"v": draw(2 * hidden, languages, scale=0.3), "c": np.zeros(languages, np.float32)}


def _pass(p: dict, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (batch, time, hidden) of one direction over equal-length byte rows x, left to right."""
    n, steps = x.shape
    w, u = p[f"x{d}"], p[f"u{d}"]
    size = u.shape[0]
    h = np.zeros((n, size), np.float32)
    out = np.empty((n, steps, size), np.float32)
    for t in range(steps):
        a = w[x[:, t]]
        g = _sigmoid(a[:, : 2 * size] + h @ u[:, : 2 * size])
        z, r = g[:, :size], g[:, size:]
        s = r * h
        m = np.tanh(a[:, 2 * size :] + s @ u[:, 2 * size :])
        if keep is not None:
            keep.append((h, z, r, s, m))
        h = h + z * (m - h)
        out[:, t] = h
    return out


def log_probs(p: dict, x: np.ndarray, keep: tuple | None = None) -> np.ndarray:
    """Log-probabilities (batch, time, language) of every position of equal-length byte rows."""
    hf = _pass(p, "f", x, keep[0] if keep else None)
    hb = _pass(p, "b", x[:, ::-1], keep[1] if keep else None)[:, ::-1]
    both = np.concatenate((hf, hb), axis=2)
    y = both @ p["v"] + p["c"]
    y -= y.max(axis=2, keepdims=True)
    y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
    if keep:
        keep[2].append(both)
    return y


def gradients(p: dict, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
    keep: tuple = ([], [], [])
    y = log_probs(p, x, keep)
    n, steps, languages = y.shape
    one = np.zeros((n, 1, languages), np.float32)
    one[np.arange(n), 0, label] = 1
    loss = float(-(y * one).sum() / (n * steps))
    dy = (np.exp(y) - one) / np.float32(n * steps)
    both = keep[2][0]
    size = both.shape[2] // 2
    g = {"v": np.einsum("nth,ntl->hl", both, dy), "c": dy.sum(axis=(0, 1))}
    dh_all = dy @ p["v"].T
    for d, states, row, dh_seq in (("f", keep[0], x, dh_all[:, :, :size]), ("b", keep[1], x[:, ::-1], dh_all[:, ::-1, size:])):
        u = p[f"u{d}"]
        gw, gu = np.zeros_like(p[f"x{d}"]), np.zeros_like(u)
        dh = np.zeros((n, size), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, s, m = states[t]
            dh = dh + dh_seq[:, t]
            dz = dh * (m - h) * z * (1 - z)
            dm = dh * z * (1 - m * m)
            ds = dm @ u[:, 2 * size :].T
            dr = ds * h * r * (1 - r)
            da = np.concatenate((dz, dr, dm), axis=1)
            np.add.at(gw, row[:, t], da)
            gu[:, : 2 * size] += h.T @ da[:, : 2 * size]
            gu[:, 2 * size :] += s.T @ dm
            dh = dh * (1 - z) + ds * r + da[:, : 2 * size] @ u[:, : 2 * size].T
        g[f"x{d}"], g[f"u{d}"] = gw, gu
    return loss, g


def train(samples: dict[str, list[str]], *, steps: int = 300, batch: int = 192, length: int = 64, rate: float = 0.02, seed: int = 9) -> dict:
    """Parameters fitted to texts by language (Adam over batches of windows of `length` bytes)."""
    languages = sorted(samples)
    rng = np.random.default_rng(seed)
    p = new_params(len(languages), rng)
    # a language's texts stand one behind the other
    pool = [np.frombuffer(b" ".join(t.encode("utf-8") for t in samples[k]).ljust(length + 1), np.uint8) for k in languages]
    each = max(1, batch // max(1, len(pool)))
    labels = np.repeat(np.arange(len(pool)), each)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1 if pool else 1):
        rows = np.concatenate([x[rng.integers(0, len(x) - length, each)[:, None] + np.arange(length)] for x in pool])
        _, g = gradients(p, rows, labels)
        pace = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            s[k] += 0.01 * (g[k] * g[k] - s[k])
            p[k] -= (pace * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return {"languages": languages, "params": p}


class Reader:
    """Pooled log-probabilities of whole texts, by windows that run side by side."""

    def __init__(self, model: dict):
        self.p = p = model["params"]
        self.languages = model["languages"]
        # everything lies as (feature, window); gates z and r by one tanh: sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.weights = {}
        for d in "fb" if p else "":
            size = p[f"u{d}"].shape[0]
            half = np.r_[np.full(2 * size, 0.5, np.float32), np.ones(size, np.float32)]
            x, u = (p[f"x{d}"] * half).T, (p[f"u{d}"] * half).T
            self.weights[d] = np.ascontiguousarray(x), np.ascontiguousarray(u[: 2 * size]), np.ascontiguousarray(u[2 * size :])

    def _states(self, d: str, rows: np.ndarray, alive: np.ndarray):
        """Yields (step, states) of the windows that still run; rows (steps, windows) begin where the direction does."""
        x, ug, um = self.weights[d]
        size = len(um)
        h = np.zeros((size, rows.shape[1]), np.float32)
        for t, n in enumerate(alive.tolist()):
            if n < h.shape[1]:
                h = np.ascontiguousarray(h[:, :n])
            a = x.take(rows[t, :n], axis=1, mode="clip")
            g = a[: 2 * size]
            g += ug @ h
            np.tanh(g, out=g)
            g *= np.float32(0.5)
            g += np.float32(0.5)
            m = a[2 * size :]
            m += um @ (g[size:] * h)
            np.tanh(m, out=m)
            m -= h
            m *= g[:size]
            h += m
            yield t, h

    def _windows(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums of log-probabilities over the cores [low, high) of windows [begin, end) of data."""
        by = np.argsort(begin - end, kind="stable")
        begin, end, low, high = begin[by], end[by], low[by], high[by]
        size = end - begin
        steps = np.arange(int(size[0]))
        alive = np.searchsorted(-size, -steps, side="left")
        v, c = np.ascontiguousarray(self.p["v"].T), self.p["c"][:, None]
        half = v.shape[1] // 2
        vf, vb = np.ascontiguousarray(v[:, :half]), np.ascontiguousarray(v[:, half:])
        last = len(data) - 1
        # back[k, j]: what the backward states give at step k of the forward direction
        back = np.empty((len(steps), len(c), len(by)), np.float32)
        whole = np.searchsorted(-size, -size[0], side="right")  # windows of full length need no index
        for t, h in self._states("b", data[np.clip(end - 1 - steps[:, None], 0, last)], alive):
            y = vb @ h
            back[len(steps) - 1 - t, :, :whole] = y[:, :whole]
            if y.shape[1] > whole:
                j = np.arange(whole, y.shape[1])
                back[size[j] - 1 - t, :, j] = y[:, whole:].T
        total = np.zeros((len(c), len(by)))
        for t, h in self._states("f", data[np.clip(begin + steps[:, None], 0, last)], alive):
            n = h.shape[1]
            at = begin[:n] + t
            core = (at >= low[:n]) & (at < high[:n])
            if not core.any():
                continue
            y = vf @ h
            y += back[t, :, :n]
            y += c
            y -= y.max(axis=0)
            y -= np.log(np.exp(y).sum(axis=0))
            y *= core
            total[:, :n] += y
        out = np.empty((len(by), len(c)))
        out[by] = total.T
        return out

    def read(self, texts: list[str]) -> np.ndarray:
        """Pooled log-probabilities of each text (zeros if it is empty)."""
        raw = [t.encode("utf-8") for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        stop = np.cumsum(size)
        parts = -(-size // CORE)
        doc = np.repeat(np.arange(len(raw)), parts)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        first, past = (stop - size)[doc], stop[doc]
        low = first + k * CORE
        high = np.minimum(low + CORE, past)
        out = np.zeros((len(raw), len(self.languages)))
        for at in range(0, len(doc), 1024):
            some = slice(at, at + 1024)
            sums = self._windows(data, np.maximum(first[some], low[some] - HALO), np.minimum(past[some], high[some] + HALO), low[some], high[some])
            np.add.at(out, doc[some], sums)
        out /= np.maximum(size, 1)[:, None]
        out -= np.log(np.exp(out - out.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + out.max(axis=1, keepdims=True)
        out[size == 0] = 0
        return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, per_text: int = 2000, steps: int = 300) -> dict:
    """Train on a bounded sample of labelled rows that are not held out: about per_lang rows a language, per_text characters of each."""
    able = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in able.groupBy(lang_col).count().collect()}
    if not counts:
        return {"languages": [], "params": {}}
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, int(scale * per_lang / n) + 1))])
    picked = able.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(scale)) < share[F.col(lang_col)])
    samples: dict[str, list[str]] = {k: [] for k in counts}
    text = F.col(text_col).cast("string")
    begin = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(1)), F.greatest(F.lit(1), F.length(text) - per_text + 1)).cast("int") + 1
    for r in picked.select(F.col(id_col).alias("i"), F.col(lang_col).alias("k"), F.substring(text, begin, F.lit(per_text)).alias("t")).where("t is not null").orderBy("i", "t").collect():
        samples[r.k].append(r.t)
    return train({k: v for k, v in samples.items() if any(t.split() for t in v)}, steps=steps)


def identify(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, from the text alone."""

    def run(batches):
        reader = Reader(model)
        for whole in batches:
            for x in pieces_of(whole, text_col, 1 << 20):
                texts = [t or "" for t in x.column(text_col).to_pylist()]
                y = reader.read(texts) if model["languages"] else None
                pred, score = [], []
                for k, t in enumerate(texts):
                    if y is None or not any(map(str.isalpha, t)):  # isalpha: category L
                        pred.append("und")
                        score.append(0.0)
                    else:
                        best = int(np.argmax(y[k]))
                        pred.append(model["languages"][best])
                        score.append(min(1.0, float(np.exp(y[k][best]))))
                yield pa.RecordBatch.from_arrays([x.column(id_col), x.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    slim = docs.select(docs[id_col].cast("long").alias(id_col), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias(text_col))
    return arrow_map(slim, run, f"`{id_col}` long, held_out boolean, lang_pred string, score double")
