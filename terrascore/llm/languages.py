"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte n-grams of its lower-case words, a blank standing for
each word's ends. Every n-gram is hashed to a row of an embedding table, the rows are
averaged over the text and a linear layer with a softmax gives the languages. Table
and layer are trained together by stochastic gradient descent in numpy, on a bounded
sample of labelled texts. A part of the sample is kept back to calibrate the softmax (a
temperature) and the rejection: probabilities among the learned languages say nothing
about other ones, so a text is rejected by its familiarity, the mean log frequency of
its n-grams in the training texts of the predicted language.

Texts are read whole: since averaging and the layer are linear, embedding rows times
layer are multiplied once after training and each n-gram adds its row of logits, in
slices of bounded memory however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.llm.base import batch_rows, fresh, slices, table, text_or_empty
from terrascore.llm.registry import query

#: Subwords: lengths in bytes, and rows of the embedding table.
LENGTHS, BUCKETS, WIDTH = (2, 3, 4), 1 << 14, 16
#: Training: texts in the sample at most, their code points at most, passes, texts a step, learning rate, seed.
SAMPLE, SAMPLE_CHARS, EPOCHS, BATCH, RATE, SEED = 2000, 20_000, 5, 32, 0.5, 20
#: Part of the sample kept for calibration, part of its rightly predicted texts that may be rejected at most, and what each n-gram counts beforehand.
KEPT_BACK, MAY_REJECT, BEFOREHAND = 0.2, 0.002, 1e-4
SLICE = 1 << 20  # bytes worked on at a time

_FOLD = np.arange(256, dtype=np.uint8)  # ASCII letters and other scripts stay, the rest is a blank
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def ngram_rows(data: np.ndarray, lengths=LENGTHS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: table rows of the n-grams that begin at each byte, and whether each counts.

    An n-gram counts if it has a letter and no blank but at its ends.
    """
    codes, blank = data.astype(np.uint32), data == 32
    for n in lengths:
        size = len(data) - n + 1
        if size <= 0:
            continue
        code = codes[:size].copy()
        inner = np.zeros(size, bool)
        for i in range(1, n):
            code = code * np.uint32(257) + codes[i : i + size]
            if i < n - 1:
                inner |= blank[i : i + size]
        counts = ~inner & ~(blank[:size] & blank[n - 1 : n - 1 + size])
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
        yield (code >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int32), counts


@dataclass
class Model:
    """A trained model: languages, logits and log frequencies that each n-gram adds, temperature and least familiarity."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    common: np.ndarray
    temperature: float = 1.0
    reject: float = -np.inf

    def __post_init__(self):
        self.adds = np.concatenate([self.logits, self.common], axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Language probabilities of texts that lie one after the other in ``data``, each between blanks."""
        return self.rated(data, offsets)[0]

    def rated(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language probabilities of such texts, and how familiar each text is in each language."""
        total = np.zeros((len(offsets) - 1, self.adds.shape[1]))
        count = np.zeros(len(offsets) - 1)
        if len(offsets) < 2:
            return total[:, : len(self.languages)], total[:, len(self.languages) :]
        longest, begins = max(LENGTHS), offsets[:-1]
        for start in range(0, len(data), SLICE):
            stop = min(start + SLICE, len(data))
            part = data[start : min(stop + longest - 1, len(data))]
            first = np.searchsorted(begins, start, "right") - 1
            cuts = np.maximum(begins[first : np.searchsorted(begins, stop, "left")], start) - start
            for rows, counts in ngram_rows(part):
                rows, counts = rows[: stop - start], counts[: stop - start]
                filled = cuts[cuts < len(rows)]
                if not len(filled):
                    continue
                add = self.adds[rows]
                add[~counts] = 0
                total[first : first + len(filled)] += np.add.reduceat(add, filled, axis=0)
                count[first : first + len(filled)] += np.add.reduceat(counts.astype(np.int64), filled)
        logits, common = np.split(total / np.maximum(count, 1)[:, None], 2, axis=1)
        return softmax((logits + self.bias) / self.temperature), common


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of texts with a blank before each and one at the end, and where each begins."""
    raw = column.cast(pa.large_string())
    lengths = np.diff(np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8))
    joined = b" " + b" ".join(v.encode() for v in raw.to_pylist()) + b" "
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    return _FOLD[np.frombuffer(joined, np.uint8)], offsets


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit table and layer on lower-case texts, then temperature and rejection on those kept back."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    data, offsets = laid_out(pa.array(texts, pa.string()))
    bags = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        found = [rows[counts] for rows, counts in ngram_rows(data[a : b + 1])]
        n = np.bincount(np.concatenate([np.zeros(0, np.int32), *found]), minlength=BUCKETS)
        rows = np.flatnonzero(n)
        bags.append((rows, (n[rows] / max(1, n.sum())).astype(np.float32)))
    order = rng.permutation(len(bags))
    back = int(len(bags) * KEPT_BACK)
    held, used = order[:back], order[back:]
    embed = (rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
    layer = (rng.standard_normal((WIDTH, len(languages))) * 0.1).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    # texts of rare languages count for more, so that a frequent language isn't the answer to everything
    weight = len(used) / (len(languages) * np.maximum(1, np.bincount(y[used], minlength=len(languages))))
    scale = np.float32(WIDTH)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rng.shuffle(used)
        for at in range(0, len(used), BATCH):
            chosen = used[at : at + BATCH]
            mean = np.zeros((len(chosen), BUCKETS), np.float32)
            for i, k in enumerate(chosen):
                mean[i, bags[k][0]] = bags[k][1]
            hidden = scale * (mean @ embed)
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            error *= (weight[y[chosen]] / len(chosen))[:, None]
            error = error.astype(np.float32)
            slope = scale * (error @ layer.T)
            layer -= rate * (hidden.T @ error)
            bias -= rate * error.sum(axis=0)
            embed -= rate * scale * (mean.T @ slope)
    often = np.full((BUCKETS, len(languages)), BEFOREHAND)
    for k in used:
        often[bags[k][0], y[k]] += bags[k][1]
    model = Model(languages, scale * (embed @ layer), bias, np.log(often / often.sum(axis=0)).astype(np.float32))
    if len(held):
        calibrate(model, texts=[texts[i] for i in held], y=y[held])
    return model


def calibrate(model: Model, texts: list[str], y: np.ndarray) -> None:
    """Set the temperature of least log loss, and the least familiarity.

    All but ``MAY_REJECT`` of the right answers reach it. How familiar texts are in the
    other languages shows what an unlearned one is like: where all but as many of those
    are lower, the threshold lies midway, since few texts don't show the rarest ones.
    """
    data, offsets = laid_out(pa.array(texts, pa.string()))
    model.temperature = 1.0
    found, familiar = model.rated(data, offsets)
    mean = np.log(np.maximum(found, 1e-30))
    at = np.arange(len(y))
    losses = {t: -np.mean(np.log(np.maximum(softmax(mean / t)[at, y], 1e-12))) for t in np.geomspace(0.05, 20, 61)}
    model.temperature = float(min(losses, key=losses.get))
    best = found.argmax(axis=1)
    right = best == y
    if right.any():
        own = np.quantile(familiar[at, best][right], MAY_REJECT)
        familiar[at, best] = -np.inf
        foreign = np.quantile(familiar[right].max(axis=1), 1 - MAY_REJECT, method="higher")
        model.reject = float((own + foreign) / 2 if -np.inf < foreign < own else own)


def held_out(key: str = "doc_id") -> Column:
    """Documents that nothing is learned from; false for a null key, which isn't learned from either."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{key}`").cast("string")), F.lit(4)) == 2, F.lit(False))


def sample_texts(rows: DataFrame, key: str, text: str, lang: str, most: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most about ``most`` lower-case labelled texts, of at most ``SAMPLE_CHARS`` code points, drawn by a hash.

    Only texts that can be learned from are counted. Languages share the sample evenly; what one with few
    texts leaves goes to the others, so that a rare language is learned from all it has.
    """
    usable = rows.where(
        F.col(f"`{key}`").isNotNull() & ~held_out(key) & F.col(f"`{lang}`").isNotNull()
        & (F.char_length(F.col(f"`{text}`")) <= SAMPLE_CHARS) & has_letter(F.col(f"`{text}`"))
    )
    name = F.col(f"`{lang}`").cast("string")
    counted = sorted((r["n"], r["l"]) for r in usable.groupBy(name.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a language
    steps, left, parts = 1 << 30, float(most), []
    for at, (n, language) in enumerate(counted):
        wanted = min(float(n), left / (len(counted) - at))
        left -= wanted
        parts += [F.lit(language), F.lit(int(wanted / n * steps))]
    if not parts:
        return [], []
    place = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(SEED)), F.lit(steps))
    drawn = usable.where(place < F.try_element_at(F.create_map(*parts), name)).select(
        F.lower(F.col(f"`{text}`").cast("string")).alias("t"), name.alias("l"),
        F.xxhash64(F.col(f"`{key}`"), F.lit(SEED)).alias("h"),
    ).collect()
    drawn.sort(key=lambda r: (r["h"], r["t"], r["l"]))
    return [r["t"] for r in drawn], [r["l"] for r in drawn]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify_languages(
    rows: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``rows`` (or their columns ``keep``) with ``lang_pred``, ``score`` and ``rejected``.

    ``score`` is the calibrated probability of ``lang_pred``; a text less familiar in
    it than the model asks for is ``rejected``. A null text or one without a letter is
    ``und`` with score 0 and rejected, as is everything if there is no model because
    nothing was labelled. Columns of ``rows`` with a result's name are replaced.
    """
    names = ["lang_pred", "score", "rejected"]
    kept = [c for c in (rows.columns if keep is None else keep) if c not in names]
    columns = [F.col(f"`{c}`") for c in kept]
    if model is None:
        return rows.select(*columns, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    batch_rows(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of one number a language
    body, letter = fresh(rows, "body", "letter")
    given = F.col(f"`{text}`").cast("string")
    source = rows.select(*columns, has_letter(given).alias(letter), F.lower(text_or_empty(f"`{text}`")).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        languages = np.array(model.languages)
        for batch in slices(batches, body):
            scores, familiar = model.rated(*laid_out(batch.column(batch.num_columns - 1)))
            known = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(known, scores.max(axis=1), 0.0)
            own = familiar[np.arange(len(scores)), scores.argmax(axis=1)]
            predicted = np.where(known, languages[scores.argmax(axis=1)], "und")
            results = [pa.array(predicted.tolist(), pa.string()), pa.array(best), pa.array(~known | (own < model.reject))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + results, [*kept, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2]]
    return source.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, rejected boolean"]))


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the rows that aren't held out; none if no row is labelled."""
    texts, labels = sample_texts(rows, key, text, lang)
    return train(texts, labels) if texts else None


@query("op2_identify_languages")
def op2_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing language is filled in."""
    found = identify_languages(docs, fit(docs)).where(~F.col("rejected"))
    lang = F.coalesce(F.col("lang"), F.col("lang_pred")).alias("lang")
    return found.select(*[lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
