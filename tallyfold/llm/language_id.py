"""Language ID: a bidirectional gated recurrent network over bytes that labels every position."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder_of_id

#: A text's bytes are read in windows of CORE, with WARM bytes before and after that only bring the states up.
CORE, WARM = 240, 16
STEPS = CORE + 2 * WARM
#: The training sample: about so many windows of each language, and of all together at most. No language and no part of a text is left out of the draw.
TRAIN_EACH, TRAIN_ALL = 300, 60_000
HIDDEN, EPOCHS, BATCH, RATE = 8, 5, 64, 0.02
#: Windows that are read at once.
TOGETHER = 512
UNKNOWN = "und"
#: A text is in no language that was learned if its best share is nearer to chance than so much of the way to 1.
CLEAR = 0.1
#: Letters, and bytes of longer characters; other positions are labelled and read, but have no say.
_LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


@dataclass
class Network:
    """Two recurrent layers, left to right and right to left, and a softmax over both states.

    enter[d]: byte -> inputs of the gates (update, reset, candidate); recur[d]: state -> gates.
    """

    langs: list[str]
    enter: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def states(net: Network, codes: np.ndarray) -> np.ndarray:
    """States of both layers at each step, (layer, step, window, hidden); the second layer's steps run backwards."""
    n, t = codes.shape
    h = net.recur.shape[1]
    both = np.stack([codes.T, codes.T[::-1]])
    # Half of what enters a gate, as its sigmoid is 0.5 + 0.5 * tanh of that.
    gate_in, gate_back = np.ascontiguousarray(net.enter[..., : 2 * h]) / 2, np.ascontiguousarray(net.recur[..., : 2 * h]) / 2
    new_in, new_back = np.ascontiguousarray(net.enter[..., 2 * h :]), np.ascontiguousarray(net.recur[..., 2 * h :])
    out, state = np.zeros((2, t, n, h), net.recur.dtype), np.zeros((2, n, h), net.recur.dtype)
    gates, entered, new, kept = np.empty((2, n, 2 * h), state.dtype), np.empty((2, n, h), state.dtype), np.empty_like(state), np.empty_like(state)
    for i in range(t):
        np.matmul(state, gate_back, out=gates)
        np.matmul(state, new_back, out=new)
        for d in (0, 1):
            gates[d] += gate_in[d].take(both[d, i], axis=0)
            new_in[d].take(both[d, i], axis=0, out=entered[d])
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        new *= gates[..., h:]
        new += entered
        np.tanh(new, out=new)
        np.subtract(state, new, out=kept)
        kept *= gates[..., :h]
        state = np.add(kept, new, out=out[:, i])
    return out


def taped(net: Network, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """``states``, with what going back through time needs of each step."""
    h, out, tape = net.recur.shape[1], states(net, codes), []
    both = np.stack([codes.T, codes.T[::-1]])
    before = np.concatenate([np.zeros_like(out[:, :1]), out[:, :-1]], axis=1)
    for i in range(codes.shape[1]):
        state = before[:, i]
        x, r = np.stack([net.enter[0][both[0, i]], net.enter[1][both[1, i]]]), state @ net.recur
        gates = _sigmoid(x[..., : 2 * h] + r[..., : 2 * h])
        tape.append((both[:, i], state, gates[..., :h], gates[..., h:], np.tanh(x[..., 2 * h :] + gates[..., h:] * r[..., 2 * h :]), r[..., 2 * h :]))
    return out, tape


def position_probs(net: Network, both: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Probabilities of the languages at positions lo to hi, (position, window, language)."""
    t, h = both.shape[1], both.shape[3]
    logits = both[0, lo:hi] @ net.out[:h] + both[1, t - hi : t - lo][::-1] @ net.out[h:] + net.bias
    e = np.exp(logits - logits.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def gradients(net: Network, codes: np.ndarray, said: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy over the positions that have a say, back through time."""
    both, tape = taped(net, codes)
    t, h = both.shape[1], both.shape[3]
    g = position_probs(net, both, 0, t)
    g[:, np.arange(len(labels)), labels] -= 1
    g *= said.T[:, :, None] / max(1, said.sum())
    aligned = np.concatenate([both[0], both[1, ::-1]], axis=2)
    d_out = np.einsum("tnh,tnk->hk", aligned, g)
    d_both = g @ net.out.T
    d_both = np.stack([d_both[..., :h], d_both[::-1, :, h:]])
    d_enter, d_recur, back = np.zeros_like(net.enter), np.zeros_like(net.recur), np.zeros_like(both[:, 0])
    for i in range(t - 1, -1, -1):
        read, state, update, reset, new, cand = tape[i]
        back = back + d_both[:, i]
        to_new = back * (1 - update) * (1 - new**2)
        to_update = back * (state - new) * update * (1 - update)
        to_reset = to_new * cand * reset * (1 - reset)
        to_gates = np.concatenate([to_update, to_reset, to_new], axis=2)
        to_r = np.concatenate([to_update, to_reset, to_new * reset], axis=2)
        for d in (0, 1):
            np.add.at(d_enter[d], read[d], to_gates[d])
        d_recur += state.transpose(0, 2, 1) @ to_r
        back = back * update + to_r @ net.recur.transpose(0, 2, 1)
    return [d_enter, d_recur, d_out, g.sum(axis=(0, 1))]


def windows(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, said, owner) of the windows of some texts' bytes: STEPS bytes each, which positions have a say, and the text.

    Neighbouring windows overlap by 2 * WARM bytes, of which each has a say in one window alone. Beyond a text's ends are zeros.
    """
    counts = np.array([-(-len(r) // CORE) for r in raws], np.int64)
    gap = b"\0" * (WARM + CORE)
    flat = np.frombuffer(gap.join([b"", *raws, b""]), np.uint8)
    begin = np.cumsum([len(gap)] + [len(r) + len(gap) for r in raws])[:-1]
    owner = np.repeat(np.arange(len(raws)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (begin[owner] + nth * CORE - WARM)[:, None] + np.arange(STEPS)
    codes = flat[at]
    said = _LETTERS[codes]
    said[:, :WARM] = said[:, WARM + CORE :] = False
    ends = np.array([len(r) for r in raws])[owner] - nth * CORE
    said &= np.arange(STEPS) - WARM < ends[:, None]
    return codes, said, owner


def train(raws: list[bytes], labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    h, k = HIDDEN, len(langs)
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    net = Network(langs, draw(2, 256, 3 * h, s=0.3), draw(2, h, 3 * h, s=h**-0.5), draw(2 * h, k, s=0.3), np.zeros(k, np.float32))
    if not raws:
        return net
    codes, said, owner = windows(raws)
    labels = labels[owner]
    values = [net.enter, net.recur, net.out, net.bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step, steps = 0, epochs * -(-len(codes) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            step += 1
            speed = RATE * min(1.0, 2 * (steps - step + 1) / steps)
            for v, g, m, s in zip(values, gradients(net, codes[some], said[some].astype(np.float32), labels[some]), first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= speed * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
    return net


def as_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def training_sample(docs: DataFrame, each: int = TRAIN_EACH, most: int = TRAIN_ALL) -> tuple[list[bytes], np.ndarray, list[str]]:
    """Windows of labelled texts that are not held out, drawn by a hash from all windows of whole texts, and their languages.

    About ``each`` windows of every language come, fewer where ``most`` would be exceeded; the same window of the same row is drawn once.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0) & (remainder_of_id() != 2))
    count = F.ceil(F.length("text") / CORE)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum(count).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros(0, np.int64), []
    each = min(each, max(1, most // len(langs)))
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, each / counts[k]))])[F.col("lang")]
    own = F.xxhash64("doc_id", "text")
    picked = F.expr(f"filter(sequence(0, cast(_n as int) - 1), j -> pmod(xxhash64(_own, j), {1 << 30}) < _rate * {1 << 30})")
    drawn = labelled.select("lang", "text", count.alias("_n"), own.alias("_own"), rate.alias("_rate")).select("lang", "text", F.explode(picked).alias("j"))
    rows = drawn.select("lang", F.substring("text", F.col("j") * CORE + 1, F.lit(CORE)).alias("part")).distinct().collect()
    pairs = sorted((as_bytes(r["part"]), langs.index(r["lang"])) for r in rows if has_letter(r["part"]))
    return [w for w, _ in pairs], np.array([k for _, k in pairs], np.int64), langs


def predict(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """The language and its mean probability over all positions with a say, for each text."""
    raws = [as_bytes(t) if has_letter(t) else b"" for t in texts]
    k = len(net.langs)
    sums = np.zeros((len(texts), k + 1))
    if k and any(raws):
        codes, said, owner = windows(raws)
        for i in range(0, len(codes), TOGETHER):
            some = slice(i, i + TOGETHER)
            both = states(net, codes[some])
            held = np.zeros((len(both[0, 0]), k))
            step = max(1, 2_000_000 // (len(held) * k))
            for lo in range(WARM, WARM + CORE, step):
                hi = min(lo + step, WARM + CORE)
                held += np.einsum("tnk,nt->nk", position_probs(net, both, lo, hi), said[some, lo:hi].astype(np.float32))
            np.add.at(sums[:, :k], owner[some], held)
        np.add.at(sums[:, k], owner, said.sum(axis=1))
    out = []
    for row in sums:
        best = int(row[:k].argmax()) if row[k] else 0
        out.append((net.langs[best], float(min(1.0, row[best] / row[k]))) if row[k] else (UNKNOWN, 0.0))
    return out


def fit(docs: DataFrame) -> Network:
    return train(*training_sample(docs))


def _runs(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a column in runs of about ``most`` characters, and where each begins."""
    at, run, size = 0, [], 0
    for i, v in enumerate(column):
        run.append(v.as_py())
        size += len(run[-1] or "")
        if size >= most or i == len(column) - 1:
            yield at, run
            at, run, size = i + 1, [], 0


def label(docs: DataFrame, net: Network, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of ``docs``, the predicted language and its mean probability over a document's positions.

    The network runs over the bytes of the whole text (lower case), both ways and across words, and labels every position; a
    document's probabilities are the mean over its letters' positions. Texts of any length are read in
    overlapping windows. Texts that are null or have no letter are "und" with score 0, as is every text if no language was
    learned. ``names`` replace columns of the same name.
    """
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept]).add(names[0], "string").add(names[1], "double")
    at = kept.index("text")
    model = (net.langs, net.enter, net.recur, net.out, net.bias)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Network(*model)
        for whole in batches:
            for i, texts in _runs(whole.column(at)):
                found = predict(learned, texts)
                b = whole.slice(i, len(texts))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*kept, *names])

    return docs.select(*kept).mapInArrow(run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from those not held out."""
    net = fit(docs)
    out = label(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), net, ("lang_pred", "score"))
    return out.select("doc_id", (remainder_of_id() == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, clear: float = CLEAR) -> DataFrame:
    """Documents with a language: not "und", and with a mean probability that is clearly above chance.

    Chance is 1 over the number of languages learned; with one language nothing with a letter is rejected.
    """
    net = fit(docs)
    chance = 1 / max(1, len(net.langs))
    found = label(docs, net, ("_li_lang", "_li_score"))
    return found.where((F.col("_li_lang") != UNKNOWN) & (F.col("_li_score") >= min(chance + clear * (1 - chance), 1 - 1e-6))).select(*docs.columns)
