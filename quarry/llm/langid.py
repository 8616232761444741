"""Operator 6: language identification by error-correcting output codes.

Each language has a codeword; one binary classifier per bit, over hashed character n-grams (1 to 3, letters folded to
lower case, everything else one space), predicts that bit. A text goes to the codeword of least
loss, the logistic loss of each bit weighted by how well its classifier did in training; a text whose two
best codewords are within ``margin`` of each other is flagged as ambiguous.

The classifiers are fitted on a bounded sample, about ``per_lang`` documents of each language spread evenly over
all labelled ones by a hash of the id (the features of the sample go to the driver; counting and
predicting cover every document). Texts are read whole. Documents whose crc32(doc_id) leaves 2 by 4, and
those without id, text or lang, are never learned from. Null text, or none with a letter, is ``und`` with score
0. With no language learned all are ``und``; with one, all texts with a letter are that language.
Each row of a repeated doc_id counts by itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import give_back, text_batches

BINS = 2048
#: Characters whose n-grams a task holds at a time (about 60 bytes each), beside one text at least.
CHARS = 300_000
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or 32 for what is no letter."""
    if not _FOLD:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def features(texts: list[str], bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of relative n-gram frequencies per text, and which texts have a letter."""
    raw = "".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass")
    c = _fold()[np.frombuffer(raw, np.uint32)]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (doc[1:] != doc[:-1])  # one space for a run of non-letters
    c, doc = c[keep], doc[keep]
    out = np.zeros(len(texts) * bins)
    h = c * np.uint32(2654435761)
    for order, factor in ((1, 1), (2, 2246822519), (3, 3266489917)):
        if order > 1:
            h = h[:-1] * np.uint32(factor) + c[order - 1 :] * np.uint32(668265263)
            h ^= h >> np.uint32(15)
        same = doc[: len(h)] == doc[order - 1 :]
        at = doc[: len(h)] * bins + (h * np.uint32(2654435769) >> np.uint32(32 - 11)) % bins
        out += np.bincount(at[same], minlength=len(out))
    x = out.reshape(len(texts), bins)
    letters = np.bincount(doc[c != 32], minlength=len(texts)) > 0
    return np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)).astype(np.float32), letters


def codewords(k: int, seed: int = 0) -> np.ndarray:
    """k rows of +1 and -1: every split of up to five languages, else the best spread of random codes."""
    if k <= 5:
        splits = [s for n in range(1, k) for s in combinations(range(k), n) if 0 in s]
        return np.array([[1 if i in s else -1 for s in splits] for i in range(k)]).reshape(k, len(splits))
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    tries = (rng.choice([-1, 1], (k, bits)) for _ in range(200))
    return max(tries, key=lambda m: (-(m @ m.T - 2 * bits * np.eye(k, dtype=int)).max(), 0))


@dataclass
class LanguageModel:
    langs: list[str]
    codes: np.ndarray  # languages by bits
    weights: np.ndarray  # features by bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit's classifier
    margin: float = 0.02

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scores, ambiguous)"""
        x, letters = features(texts)
        if not self.langs:
            letters[:] = False
        names = np.array([*self.langs, "und"], dtype=object)
        if len(self.langs) < 2:
            best = np.where(letters, 0, len(self.langs))
            return names[best].tolist(), letters.astype(float), np.zeros(len(texts), bool)
        f = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -f * code) * self.trust).sum(axis=1) for code in self.codes], axis=1)
        two = np.partition(loss, 1, axis=1)
        p = np.exp(two[:, :1] - loss)
        score = np.where(letters, 1 / p.sum(axis=1), 0.0)
        close = letters & (two[:, 1] - two[:, 0] < self.margin * self.trust.sum())
        best = np.where(letters, loss.argmin(axis=1), len(self.langs))
        return names[best].tolist(), score, close


def fit(x: np.ndarray, langs_of: list[str], rounds: int = 300, rate: float = 30.0, ridge: float = 1e-5) -> LanguageModel:
    """Logistic classifiers of all bits at once, by accelerated gradient steps; every language weighs the same."""
    langs = sorted(set(langs_of))
    codes = codewords(len(langs)) if langs else np.zeros((0, 0))
    bits = codes.shape[1]
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    trust = np.ones(bits)
    if bits:
        y = np.array([langs.index(v) for v in langs_of])
        target = codes[y].astype(np.float32)
        share = (1 / np.bincount(y)[y] / len(langs)).astype(np.float32)[:, None]
        w0, b0 = w.copy(), b.copy()
        for i in range(rounds):
            m = i / (i + 3)
            vw, vb = w + m * (w - w0), b + m * (b - b0)
            g = -target / (1 + np.exp(target * (x @ vw + vb))) * share
            w0, b0 = w, b
            w, b = vw - rate * (x.T @ g + ridge * vw), vb - rate * g.sum(axis=0) / 10
        right = (((x @ w + b) * target > 0) * share).sum(axis=0)
        trust = np.clip(2 * right - 1, 0.05, 1.0)
    return LanguageModel(langs, codes, w, b, trust)


def _few(column) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts): texts of an Arrow column, 200 at most and of about ``CHARS`` characters."""
    for span, texts in text_batches(column, CHARS):
        for a in range(0, len(texts), 200):
            yield span.start + a, texts[a : a + 200]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, per_lang: int = 800) -> LanguageModel:
    """Fit on about ``per_lang`` labelled documents of each language, chosen by a hash of the id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return fit(np.zeros((0, BINS), np.float32), [])
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_lang / n))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, texts in _few(batch.column(1)):
                x, letters = features(texts)
                raw = pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), raw, pa.array(letters)], names=["lang", "x", "letters"])
        give_back()

    sample = known.where(drawn).select("lang", "text").mapInArrow(go, "lang string, x binary, letters boolean")
    rows = [r for r in sample.collect() if r["letters"]]
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float16).astype(np.float32).reshape(-1, BINS)
    order = np.lexsort((x[:, 0], [r["lang"] for r in rows])) if rows else []
    return fit(x[order], [rows[i]["lang"] for i in order])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred, score, ambiguous``; columns of those names are replaced."""
    from pyspark.sql import types as T

    own = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "ambiguous")]
    names = [f.name for f in own]
    schema = T.StructType(
        [*own, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, texts in _few(batch.column(batch.schema.get_field_index("text"))):
                pred, score, close = shared.value.predict(texts)
                part = batch.slice(at, len(texts))
                cols = [*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(close)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "score", "ambiguous"])
        give_back()

    return docs.select(*names).mapInArrow(go, schema)


def op6_language_id(spark, sf_dir) -> DataFrame:
    """The language of every document, from classifiers fitted on those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    got = identify(docs.select("doc_id", "text"), train(docs))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
