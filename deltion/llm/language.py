"""Language of a text by a byte convolutional network, in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows, each filter's largest response goes to a
softmax layer. Trained on a bounded sample of labelled documents; applied to all windows of every text in batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltion.llm.shared import held_out

LETTER = regex.compile(r"\p{L}")
PAD = 256


@dataclass
class Settings:
    docs_per_language: int = 300  # labelled rows learned from, by the smallest hashes of doc_id
    windows_per_doc: int = 4
    window: int = 256  # bytes
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12  # of each width
    embedding: int = 8
    epochs: int = 10
    batch: int = 64
    rate: float = 0.01
    seed: int = 1


@dataclass
class Model:
    languages: list[str]
    window: int
    width: int  # the largest filter
    embedding: np.ndarray  # 257 x e; the last row, for padding, stays 0
    kernel: np.ndarray  # width * e x filters; narrow filters have zeros at their end
    bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray


def windows(data: bytes, size: int, overlap: int) -> np.ndarray:
    """All windows of the text, each `overlap` bytes into the next, so that no filter position is lost; padded."""
    step = size - overlap
    n = max(1, -(-(len(data) - overlap) // step))
    padded = np.full(n * step + overlap, PAD, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::step]


def patches(model: Model, batch: np.ndarray) -> np.ndarray:
    embedded = model.embedding[batch].reshape(len(batch), -1)
    e = model.embedding.shape[1]
    return np.lib.stride_tricks.sliding_window_view(embedded, model.width * e, axis=1)[:, ::e]


def pooled(model: Model, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest response of every filter, where it is, and the patches."""
    seen = np.ascontiguousarray(patches(model, batch))
    response = seen @ model.kernel
    at = response.argmax(1)
    return np.maximum(np.take_along_axis(response, at[:, None], 1)[:, 0] + model.bias, 0), at, seen


def probabilities(model: Model, batch: np.ndarray, chunk: int = 64) -> np.ndarray:
    out = []
    for k in range(0, len(batch), chunk):
        seen = np.ascontiguousarray(patches(model, batch[k : k + chunk]))
        top = np.maximum((seen @ model.kernel).max(1) + model.bias, 0)
        logits = top @ model.output + model.output_bias
        logits = np.exp(logits - logits.max(1, keepdims=True))
        out.append(logits / logits.sum(1, keepdims=True))
    return np.concatenate(out) if out else np.zeros((0, len(model.languages)), np.float32)


def train(rows: list[tuple[str, str]], settings: Settings) -> Model:
    """Train on (text, language) rows by Adam. The gradient of the pooling only touches the positions that won."""
    rng = np.random.default_rng(settings.seed)
    languages, width, e = sorted({lang for _, lang in rows}), max(settings.widths), settings.embedding
    n_filters = settings.filters * len(settings.widths)
    mask = np.zeros((width * e, n_filters), np.float32)
    for i, w in enumerate(settings.widths):
        mask[: w * e, i * settings.filters : (i + 1) * settings.filters] = 1
    model = Model(
        languages, settings.window, width, rng.normal(0, 0.5, (PAD + 1, e)).astype(np.float32), (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(n_filters, np.float32),
        rng.normal(0, 0.1, (n_filters, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    model.embedding[PAD] = 0
    inputs, targets = [], []
    for text, lang in rows:
        found = windows(text.encode("utf-8", "replace"), settings.window, width - 1)
        chosen = rng.choice(len(found), min(len(found), settings.windows_per_doc), replace=False)
        inputs.append(found[chosen])
        targets += [languages.index(lang)] * len(chosen)
    if not inputs:
        return model
    x, y = np.concatenate(inputs), np.array(targets)
    share = np.bincount(y, minlength=len(languages)) / len(y)
    weight = 1 / np.maximum(share[y] * len(languages), 1e-6)
    names = ["embedding", "kernel", "bias", "output", "output_bias"]
    first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for epoch in range(settings.epochs):
        rate = settings.rate * (1 - epoch / settings.epochs)
        order = rng.permutation(len(x))
        for k in range(0, len(x), settings.batch):
            pick = order[k : k + settings.batch]
            top, at, seen = pooled(model, x[pick])
            logits = top @ model.output + model.output_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= (weight[pick] / len(pick))[:, None].astype(np.float32)
            back = (p @ model.output.T) * (top > 0)
            won = seen[np.arange(len(pick))[:, None], at]  # batch x filters x patch
            grads = {"output": top.T @ p, "output_bias": p.sum(0), "bias": back.sum(0), "kernel": np.einsum("bf,bfp->pf", back, won) * mask}
            to_patch = (back[:, :, None] * model.kernel.T[None]).reshape(len(pick), n_filters, width, e)
            codes = x[pick][np.arange(len(pick))[:, None, None], at[:, :, None] + np.arange(width)]
            grads["embedding"] = np.stack([np.bincount(codes.ravel(), to_patch[..., d].ravel(), PAD + 1) for d in range(e)], 1).astype(np.float32)
            grads["embedding"][PAD] = 0
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                getattr(model, n)[...] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return model


def training_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """(text, lang): for every language the `docs_per_language` documents with the smallest hashes of doc_id.

    Only ids are ranked, cut to that number in every map task before the shuffle, so a frequent language costs no more; the
    chosen ones, which that number and the languages bound, are broadcast to fetch the texts.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = usable.select("doc_id", "lang").withColumn("_rank", rank).where(F.col("_rank") <= settings.docs_per_language).select("doc_id", "lang").distinct()
    return usable.join(F.broadcast(chosen), ["doc_id", "lang"]).select("text", "lang")


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    settings = settings or Settings()
    return train(sorted((r.text, r.lang) for r in training_rows(docs, settings).collect()), settings)


def predict(docs: DataFrame, model: Model, chunk_windows: int = 4096) -> DataFrame:
    """Add held_out, lang_pred and score to the ids of all rows.

    Every window of the whole text is read; the score is the mean probability of the predicted language over the text's
    bytes. Null texts and texts without a letter are `und` with score 0, as is everything when no language was learned.
    Repeated rows and null ids are kept. Windows of the texts of a batch go through the network together.
    """

    def work(batches):
        overlap = model.width - 1
        for batch in batches:
            totals = np.zeros((batch.num_rows, max(1, len(model.languages))))
            held, owners, sizes, count = [], [], [], 0

            def flush():
                p = probabilities(model, np.concatenate(held))
                np.add.at(totals, np.concatenate(owners), p * np.concatenate(sizes)[:, None])

            undetermined = []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                undetermined.append(not text or not model.languages or not LETTER.search(text))
                if undetermined[-1]:
                    continue
                found = windows(text.encode("utf-8", "replace"), model.window, overlap)
                for k in range(0, len(found), chunk_windows):
                    part = found[k : k + chunk_windows]
                    held.append(part)
                    owners.append(np.full(len(part), i))
                    sizes.append((part != PAD).sum(1))
                    count += len(part)
                    if count >= chunk_windows:
                        flush()
                        held, owners, sizes, count = [], [], [], 0
            if held:
                flush()
            best = totals.argmax(1)
            share = totals.max(1) / np.maximum(totals.sum(1), 1e-9)
            languages = ["und" if u else model.languages[b] for u, b in zip(undetermined, best, strict=True)]
            scores = [0.0 if u else min(1.0, float(s)) for u, s in zip(undetermined, share, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
