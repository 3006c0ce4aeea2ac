"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens get the log-odds of toxic against clean documents under an informative Dirichlet prior (the whole corpus), kept
where they stand out by their own standard error. A scan over the text finds all maximal scoring segments in linear time.
How high segments get by chance follows an extreme-value law; its scale and size are fitted to all clean documents, and the
evidence of all significant segments together gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltion.llm.shared import held_out, lean, settle

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
BIN = 0.25
WIDE_BIN = 800  # bins from here on grow by a hundredth each


@dataclass
class Settings:
    max_training_rows: int = 50_000  # labelled rows whose words are counted by label: those with the smallest hashes of doc_id
    max_features: int = 50_000  # features that are kept: those that stand out most
    min_documents: int = 5
    min_z: float = 4.0
    min_weight: float = 2.0  # log-odds from which on a feature counts: in large samples small ones stand out by the length of texts alone
    prior_documents: float = 100.0  # weight of the corpus as a prior
    drift: float = 0.2  # what a token without weight takes from a segment
    max_expect: float = 0.05  # a segment is significant if chance gives fewer than this many in such a text


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.2
    decay: float = 1.0  # lambda of the extreme-value law
    size: float = 1.0  # its K
    max_expect: float = 0.05
    intercept: float = -20.0
    slope: float = 0.0


def label_of(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the documents that may be learned from: toxic if one of their labels says so; null labels are left out."""
    return labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def training_sample(labels: DataFrame, settings: Settings) -> DataFrame:
    """At most `max_training_rows` of them, chosen by a hash of doc_id. That bound is the bound of the broadcast side."""
    return label_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_training_rows)


def count_features(rows: DataFrame, flush: int = 60_000) -> DataFrame:
    """Documents with each feature: (feature, toxic, clean, corpus); `toxic` is null where the label is not known.

    The feature of the empty word counts the documents themselves. A task sends its counts on whenever it holds `flush`.
    """
    fields = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64()), ("corpus", pa.int64())])

    def work(batches):
        # Plain words and the stems of each length are counted apart; what is marked as a stem is written when counts are sent.
        empty = lambda: [[Counter() for _ in range(1 + len(STEMS))] for _ in range(3)]
        counts, size = empty(), 0

        def flushed():
            out = {}
            for side, parts in enumerate(counts):
                for k, part in enumerate(parts):
                    for name, n in part.items():
                        out.setdefault(f"{name}*" if k else name, [0, 0, 0])[side] += n
            names = list(out)
            return pa.RecordBatch.from_pydict({"feature": names, **{c: [out[n][i] for n in names] for i, c in enumerate(("toxic", "clean", "corpus"))}}, schema=fields)

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                words = set(WORD.findall((text.as_py() or "").lower()))
                found = [words, *({w[:k] for w in words if len(w) > k} for k in STEMS)]
                words.add("")
                label = label.as_py()
                for parts in [counts[2]] if label is None else [counts[2], counts[0 if label else 1]]:
                    for part, names in zip(parts, found, strict=True):
                        part.update(names)
                if sum(map(len, counts[2])) > flush:
                    yield flushed()
                    counts = empty()
        yield flushed()

    sums = [F.sum(c).alias(c) for c in ("toxic", "clean", "corpus")]
    return rows.mapInArrow(lean(work), "feature string, toxic long, clean long, corpus long").groupBy("feature").agg(*sums)


def log_odds(counts: DataFrame, toxic_docs: int, clean_docs: int, all_docs: int, settings: Settings) -> DataFrame:
    """(feature, weight, z): log-odds with a Dirichlet prior in proportion to the corpus, and by their standard error."""
    n1, n0 = float(toxic_docs), float(clean_docs)
    rows = counts.where((F.col("toxic") + F.col("clean") >= settings.min_documents) & (F.col("feature") != "")).withColumn("prior", F.col("corpus") / float(all_docs) * settings.prior_documents)
    side = lambda c, n: F.log((F.col(c) + F.col("prior")) / (n + settings.prior_documents + 1 - F.col(c) - F.col("prior")))
    rows = rows.withColumn("weight", side("toxic", n1) - side("clean", n0))
    rows = rows.withColumn("z", F.col("weight") / F.sqrt(1 / (F.col("toxic") + F.col("prior")) + 1 / (F.col("clean") + F.col("prior"))))
    return rows.select("feature", "weight", "z").where((F.abs("z") >= settings.min_z) & (F.abs("weight") >= settings.min_weight))


class Weights(dict):
    """Weights of words as they are met; no more than `most` are kept, the others are worked out each time.

    Of those, most are answered by their first letters alone: no feature that speaks for begins so.
    """

    def __init__(self, features_of: dict[str, float], most: int):
        super().__init__()
        self.features, self.most = features_of, most
        self.begins = {f.rstrip("*")[: STEMS[0]] for f, w in features_of.items() if w > 0}

    def __missing__(self, word: str) -> float:
        found = self.weight(word) if word[: STEMS[0]] in self.begins else 0.0
        if len(self) < self.most:
            self[word] = found
        return found

    def weight(self, word: str) -> float:
        """The most telling feature of the word decides; 0 if none has a weight, or the word speaks against."""
        get = self.features.get
        best = get(word, 0.0)
        for k in STEMS:
            if len(word) > k and abs(other := get(word[:k] + "*", 0.0)) > abs(best):
                best = other
        return max(0.0, best)


class Scorer:
    """Scores texts with a model."""

    def __init__(self, model: Model, cache_words: int = 60_000):
        self.model, self.weights = model, Weights(model.weights, cache_words)

    def hits(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """Number of words, and (position, weight) of those that have one."""
        words, weights = WORD.findall(text.lower()), self.weights
        return len(words), [(i, x) for i, w in enumerate(words) if (x := weights[w])]

    def segments(self, hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first and last position, score), from left to right, in linear time.

        Each candidate keeps the sums before and after it, and the place of the nearest earlier candidate that starts lower, so
        no candidate is passed twice. A new one is joined to the nearest that starts lower, if that also ends lower;
        all between go into it. Where none starts lower, all before are final.
        """
        done: list[tuple[int, int, float]] = []
        found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, place of the nearest that starts lower
        total, at, drift = 0.0, -1, self.model.drift
        for position, weight in hits:
            total -= drift * (position - at - 1)
            first, before, total, at = position, total, total + weight, position
            k = len(found) - 1
            while True:
                while k >= 0 and found[k][2] >= before:
                    k = found[k][4]
                if k < 0:
                    done += [(a, b, y - x) for a, b, x, y, _ in found]
                    found = [(first, position, before, total, -1)]
                    break
                if found[k][3] >= total:
                    found.append((first, position, before, total, k))
                    break
                first, _, before, _, lower = found[k]
                del found[k:]
                k = lower
        return done + [(a, b, y - x) for a, b, x, y, _ in found]

    def expect(self, score: float, words: int) -> float:
        """How many segments of this score chance gives in a clean text of so many words."""
        return self.model.size * max(words, 1) * math.exp(-min(self.model.decay * score, 700.0))

    def significant(self, words: int, segments: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """The segments of which chance gives fewer than `max_expect` in a text of so many words."""
        least = math.log(self.model.size * max(words, 1) / self.model.max_expect) / self.model.decay
        return [x for x in segments if x[2] > least]

    def evidence(self, words: int, segments: list[tuple[int, int, float]]) -> float:
        """Sum of -ln(expectation) over significant segments."""
        chance = math.log(self.model.size * max(words, 1))
        return sum(min(min(self.model.decay * s, 700.0) - chance, 690.0) for _, _, s in segments)

    def score(self, evidence: float) -> float:
        x = self.model.intercept + self.model.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def found_hits(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, hits by bin of their weight, scores of the segments) of every row; no text goes further."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        scorer = Scorer(model)
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            counts, bins, scores = [], [], []
            for text in batch.column(1):
                n, hits = scorer.hits(text.as_py() or "")
                found = Counter([int(w / BIN) for _, w in hits])
                counts.append(n)
                bins.append([found[b] for b in range(max(found) + 1)] if found else [])
                scores.append([s for _, _, s in scorer.segments(hits)])
            columns = [pa.array(counts, pa.int64()), pa.array(bins, pa.list_(pa.int32())), pa.array(scores, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "bins", "scores"])

    return docs.select("doc_id", "text").mapInArrow(lean(work), f"doc_id {kind}, n_words long, bins array<int>, scores array<float>")


def decay_of(bins: dict[int, int], model: Model) -> float:
    """The positive root of sum p(s) exp(decay * s) = 1 over clean tokens; each weight of the model counts once besides."""
    counts = Counter({1 + int(w / BIN): 1 for w in model.weights.values() if w > 0})
    counts.update({b: n for b, n in bins.items() if b > 0})
    plain = bins.get(0, 0) + 1
    total = plain + sum(counts.values())
    excess = lambda x: plain / total * math.exp(-x * model.drift) + sum(n / total * math.exp(min(x * BIN * (b - 0.5), 700)) for b, n in counts.items()) - 1
    low, high = 0.0, 20.0
    if not counts or excess(1e-6) >= 0:
        return 0.05
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(low, 0.05)


def weight_bins(clean: DataFrame) -> dict[int, int]:
    """Tokens of clean texts by weight (in bins, a bounded number); bin 0 has those without. A task sends one row for each bin."""

    def work(batches):
        total = Counter()
        for batch in batches:
            total[0] += sum(batch.column(0).to_pylist())
            for bins in batch.column(1).to_pylist():
                for b, n in enumerate(bins):
                    if n:
                        total[b + 1] += n
                        total[0] -= n
        yield pa.RecordBatch.from_pydict({"bin": list(total), "n": list(total.values())}, schema=pa.schema([("bin", pa.int32()), ("n", pa.int64())]))

    found = clean.select("n_words", "bins").mapInArrow(lean(work), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    return {r.bin: r.n for r in found}


def chance_size(clean: DataFrame, model: Model) -> float:
    """K by maximum likelihood from the best segments of clean texts; texts without one are censored at 0.

    Millionths are added up as integers, so the order of rows does not show.
    """
    top = F.coalesce(F.array_max("scores").cast("double"), F.lit(0.0))
    weight = F.round(F.greatest("n_words", F.lit(1)) * F.exp(-F.least(top * model.decay, F.lit(700.0))) * 1e6).cast("long")
    one = clean.agg(F.count_if(top > 0).alias("best"), F.sum(weight).alias("weight")).first()
    return (one.best + 1) / ((one.weight or 0) / 1e6 + 1)


def evidence_bin(evidence: Column) -> Column:
    edge = BIN * WIDE_BIN
    return F.when(evidence <= edge, F.ceil(evidence / BIN)).otherwise(WIDE_BIN + F.ceil(F.log(evidence / edge) * 100)).cast("int")


def bin_value(b: int) -> float:
    """What the fit sees of a bin: ln(1 + evidence), so that single texts full of hits do not decide the slope."""
    return math.log1p(b * BIN if b <= WIDE_BIN else BIN * WIDE_BIN * math.exp((b - WIDE_BIN) / 100))


def evidence_by_label(rows: DataFrame, model: Model) -> dict[tuple[int, int], int]:
    """Labelled documents by evidence (in bins, a bounded number) and label."""
    chance = F.log(F.lit(model.size) * F.greatest("n_words", F.lit(1)))
    least = (chance - math.log(model.max_expect)) / model.decay
    one = lambda s: F.when(s > least, F.least(F.least(s * model.decay, F.lit(700.0)) - chance, F.lit(690.0))).otherwise(0.0)
    evidence = F.aggregate("scores", F.lit(0.0), lambda a, s: a + one(s.cast("double")))
    found = rows.groupBy(evidence_bin(evidence).alias("bin"), (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {(r.bin, r.toxic): r.n for r in found}


def logistic(bins: dict[tuple[int, int], int]) -> tuple[float, float]:
    """Intercept and slope of the label on the evidence, by Newton steps with a weak penalty on the slope."""
    import numpy as np

    x, y, n = (np.array(v, float) for v in zip(*((bin_value(b), t, c) for (b, t), c in sorted(bins.items())), strict=True))
    toxic, total = float((n * y).sum()), float(n.sum())
    design, beta = np.stack([np.ones_like(x), x], 1), np.array([math.log((toxic + 0.5) / (total - toxic + 0.5)), 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        pull = np.array([0.0, 0.1 * beta[1]])
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.1]), design.T @ (n * (y - p)) - pull)
        beta = beta + np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learn the model from labelled documents; without toxic or without clean ones it scores all documents near 0 or 1 alike.

    Texts are read twice: the first pass counts features over all rows that are not held out (the prior) and by label over the
    sampled ones; the second finds hits and segments of all that are not held out. What that gives is written without
    texts and joined to all labels; histogram, extreme-value law and the fit of the score come from it. Null and empty
    texts have no words; null ids and held-out rows are never learned from; rows with equal ids count each.
    """
    settings = settings or Settings()
    usable = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    sample = training_sample(labels, settings)
    counts = settle(count_features(usable.join(F.broadcast(sample), "doc_id", "left").select("text", "toxic")), "toxicity-features")
    sizes = counts.where("feature = ''").first()
    model = Model(drift=settings.drift, max_expect=settings.max_expect)
    toxic, clean = (sizes.toxic, sizes.clean) if sizes else (0, 0)
    if not toxic or not clean:
        model.intercept = 20.0 if toxic else -20.0
        return model
    found = log_odds(counts, toxic, clean, sizes.corpus, settings).orderBy(F.abs("z").desc(), "feature").limit(settings.max_features).collect()
    model.weights = {r.feature: r.weight for r in found}
    rows = settle(found_hits(usable, model).join(label_of(labels), "doc_id"), "toxicity-hits")
    model.decay = decay_of(weight_bins(rows.where("toxic = 0")), model)
    model.size = chance_size(rows.where("toxic = 0"), model)
    model.intercept, model.slope = logistic(evidence_by_label(rows, model))
    return model


SCORE_FIELDS = "score double, predicted int, n_words long, evidence double, passages array<struct<start:int,end:int,score:double,expect:double>>"


def score_documents(docs: DataFrame, model: Model, passages: bool = True) -> DataFrame:
    """Add score, predicted, n_words, evidence and the significant `passages` (character range, score, expectation).

    Takes doc_id and text of every row and returns held_out besides; repeated rows and null ids are kept. Null and empty
    texts have no evidence and get the score of documents without any. Whole texts; a narrow step.
    """

    def work(batches):
        scorer = Scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expect", pa.float64())]))
        for batch in batches:
            scores, counts, evidences, spans = [], [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                n, hits = scorer.hits(text)
                segments = scorer.significant(n, scorer.segments(hits))
                evidence = scorer.evidence(n, segments)
                scores.append(scorer.score(evidence))
                counts.append(n)
                evidences.append(evidence)
                at = [m.span() for m in WORD.finditer(text.lower())] if segments and passages else []
                spans.append([{"start": at[a][0], "end": at[b][1], "score": s, "expect": scorer.expect(s, n)} for a, b, s in segments] if at else [])
            columns = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(counts, pa.int64()), pa.array(evidences, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_words", "evidence", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lean(work), f"doc_id {kind}, held_out boolean, {SCORE_FIELDS}")


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns. A narrow step over whole texts.

    Null and empty texts have no evidence and stay wherever clean documents do; repeated rows are judged alike; an empty table
    stays empty.
    """

    def work(batches):
        scorer = Scorer(model)
        for batch in batches:
            keep = []
            for text in batch.column(batch.schema.get_field_index(text_column)):
                n, hits = scorer.hits(text.as_py() or "")
                keep.append(scorer.score(scorer.evidence(n, scorer.significant(n, scorer.segments(hits)))) < 0.5)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(work), docs.schema)
