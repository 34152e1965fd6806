"""Language identification: averaged hashed subword embeddings, a linear softmax, and a calibrated way to say no."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.shared import map_text

UNDETERMINED = "und"
LONGEST = 4
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subwords(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters per text, the offsets of the texts, and for n = 1 .. LONGEST a row with the bucket of the n-gram at every
    position, or 1 << bits where there is none. N-grams are of lower-cased letters within a word and may include the gap
    before or after it; each text stands between two gaps, so that no n-gram depends on its neighbours."""
    lowered = [f" {t.lower()} " for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)))])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = len(codes)
    letter = np.concatenate([letter_table()[codes], np.zeros(LONGEST, bool)])
    symbols = np.concatenate([codes, np.zeros(LONGEST, np.uint32)]) * letter
    grams = np.empty((LONGEST, size), np.int64)
    h = np.zeros(size, np.uint32)
    inner = np.ones(size, bool)
    for n in range(1, LONGEST + 1):
        h = (h + symbols[n - 1:size + n - 1] + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n > 2:
            inner &= letter[n - 2:size + n - 2]
        some = inner if n > 2 else letter[:size] if n == 1 else letter[:size] | letter[1:size + 1]
        grams[n - 1] = np.where(some, (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits), np.uint32(1 << bits))
    return np.add.reduceat(letter[:size].astype(np.int64), offsets[:-1]), offsets, grams


def averaged_counts(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters per text, and per text the share of each bucket among its subwords."""
    letters, offsets, grams = subwords(texts, bits)
    shares = np.zeros((len(texts), 1 << bits), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        counts = np.bincount(grams[:, a:b].ravel(), minlength=(1 << bits) + 1)[:-1]
        shares[i] = counts / max(1, counts.sum())
    return letters, shares


@dataclass
class Model:
    """scores[b] is the logit vector that bucket b brings along: its embedding times the linear layer. As the logits of a
    text are the mean over its subwords plus a bias, that is all a prediction needs. Its last entry is how common the bucket
    was in training (log share), averaged likewise. temperature: calibrates. A prediction is rejected whose calibrated
    probability is below `least`, or whose subwords are less common than `strange`, with four standard errors more for
    few letters (spread: of one subword): a softmax alone is sure of itself on scripts that it has never seen."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    strange: float
    spread: float
    accuracy: float
    bits: int

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of letters, and logits with the average commonness behind them, per text."""
        letters, offsets, grams = subwords(texts, self.bits)
        out = np.empty((len(texts), len(self.bias)))
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            counts = np.bincount(grams[:, a:b].ravel(), minlength=len(self.scores) + 1)[:-1]
            out[i] = counts @ self.scores / max(1, counts.sum()) + self.bias
        return letters, out

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Language, calibrated probability, and whether it is rejected."""
        letters, logits = self.logits(texts)
        p = softmax(logits[:, :-1] / self.temperature)
        best = p.argmax(axis=1)
        return [
            (self.languages[b], float(p[i, b]), bool(p[i, b] < self.least or logits[i, -1] < self.strange - 4 * self.spread / np.sqrt(letters[i]))) if letters[i] else (UNDETERMINED, 0.0, True)
            for i, b in enumerate(best)
        ]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], bits: int = 13, width: int = 16, steps: int = 800, batch: int = 64, rate: float = 1.0, seed: int = 7, lost: float = 0.001) -> Model | None:
    """Fits on (text, language) rows by stochastic gradient descent with a falling rate, on batches in which every language
    is as likely. Every fifth row is kept out: on those the temperature is set by likelihood, and the rejection thresholds
    such that less than about the share `lost` of text like the labelled would be rejected, with a probability of 1/2 as
    the most that may be asked for. None without any row that has letters."""
    rows = [(t, lang) for t, lang in rows if any(c.isalpha() for c in t)]
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    y = np.array([languages.index(lang) for _, lang in rows])
    buckets = 1 << bits
    x = np.concatenate([averaged_counts([t for t, _ in rows[i:i + 64]], bits)[1] for i in range(0, len(rows), 64)])
    kept_out = np.arange(len(rows)) % 5 == 4
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1.0 / np.sqrt(width), (buckets, width)).astype(np.float32)
    linear, bias = np.zeros((width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    inputs, targets = x[~kept_out], y[~kept_out]
    share = 1 / np.bincount(targets, minlength=len(languages))[targets]  # every language is drawn as often
    for step in range(steps):
        part = rng.choice(len(inputs), batch, p=share / share.sum())
        now = rate * (1 - step / steps)
        hidden = inputs[part] @ embed
        wrong = softmax(hidden @ linear + bias).astype(np.float32)
        wrong[np.arange(len(part)), targets[part]] -= 1
        wrong /= np.float32(len(part))
        # averages of many subwords are small, so the embedding gets the larger rate
        to_embed = inputs[part].T @ (wrong @ linear.T)
        linear -= np.float32(now) * (hidden.T @ wrong)
        bias -= np.float32(0.1 * now) * wrong.sum(axis=0)
        embed -= np.float32(50 * now) * to_embed
    scores = embed.astype(np.float64) @ linear
    familiar = np.log(inputs.mean(axis=0, dtype=np.float64) + 1e-7)
    held, truth = (x[kept_out], y[kept_out]) if kept_out.any() else (x, y)
    logits = held @ scores + bias
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 20, 200), key=loss))
    p = softmax(logits / temperature)
    least = float(min(0.5, np.quantile(p[np.arange(len(truth)), truth], lost)))
    usual = held @ familiar
    strange = float(np.quantile(usual, lost) - usual.std())
    weight = inputs.mean(axis=0, dtype=np.float64)  # shares add up to 1
    spread = float(np.sqrt(max(0.0, (weight * familiar**2).sum() - (weight * familiar).sum() ** 2)))
    return Model(languages, np.column_stack([scores, familiar]), np.append(bias, 0).astype(np.float64), temperature, least, strange, spread, float((p.argmax(axis=1) == truth).mean()), bits)


def labelled_sample(docs: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """About per_language labelled texts of each language, at most twice that in all, chosen by a hash of id and text:
    the same rows on every run, and independent of how the table is stored."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (place < int(min(1.0, per_language / n) * (1 << 30)) + 1))
    rows = known.where(chosen).select("text", "lang").limit(2 * per_language * len(sizes)).collect()
    return sorted((r["text"], r["lang"]) for r in rows)


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the kept columns, lang_pred, score (0 to 1) and rejected. Only the text is looked at.

    Null and empty texts and those without letters are `und` with score 0 and rejected; so is all without a model, which
    is what no labelled row gives. Whole texts of any length count; repeated rows stay; columns that are not kept are
    never read."""
    slim = docs.select(*keep, docs[text].alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def each(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            told = []
            group, size = [], 0
            for t in texts:  # runs of texts of some hundred thousand characters bound the arrays
                if group and size + len(t) > 300_000:
                    told += answer(group)
                    group, size = [], 0
                group.append(t)
                size += len(t)
            told += answer(group) if group else []
            return {k: batch.column(k) for k in keep} | {"lang_pred": [x[0] for x in told], "score": [x[1] for x in told], "rejected": [x[2] for x in told]}

        def answer(group: list[str]) -> list[tuple[str, float, bool]]:
            return model.predict(group) if model else [(UNDETERMINED, 0.0, True)] * len(group)

        return each

    kinds = dict(slim.dtypes)
    return map_text(slim, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string, score double, rejected boolean"]), start)


def identify(docs: DataFrame, training: DataFrame, per_language: int = 400, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Trains on a bounded sample of `training` (doc_id, text, lang; per_language is the bound) and predicts for docs."""
    return predict(docs, train(labelled_sample(training, per_language)), keep=keep)
