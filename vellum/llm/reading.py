"""Reading level by a familiar-word formula.

Familiar words are those with a high document frequency in the corpus, per language. A text's level
follows from its share of unfamiliar words and its average sentence length. Document frequencies
cover all documents; only the few coefficients, and the share from which a word is familiar, are
fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of a language's documents from which a word may count as familiar; the fit takes one.
SHARES = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3)
#: Words below this share are in no list; so a list has at most 1 / FLOOR times the mean number of
#: distinct words of a document.
FLOOR = 0.02
#: Words from this share on tell the language of a text.
TELLING = 0.3
#: Labelled documents used for the fit, at most.
MAX_LABELS = 20_000
#: Shorter texts get no level.
LEAST_WORDS = 30
REMEMBER = 500_000

_END = re.compile(r"[.!?。]+(?=\s|$)|\n")
_LANG = re.compile(r"\s*([a-zA-Z]{2})(?:[^a-zA-Z].*)?\s*\Z", re.S)


class _Words:
    """Lower-case letters of white-space tokens; remembered."""

    def __init__(self):
        self.known: dict[str, str] = {}

    def counts(self, text: str) -> Counter:
        known, found = self.known, Counter()
        for token, n in Counter(text.lower().split()).items():
            word = known.get(token)
            if word is None:
                word = "".join(c for c in token if c.isalpha())
                if len(known) >= REMEMBER:
                    known.clear()
                if len(token) <= 64:
                    known[token] = word
            if word:
                found[word] += n
        return found


def language_code(lang: str | None) -> str:
    """Two lower-case letters of a code such as ` en`, `EN` or `en-GB`; '' for anything else."""
    m = _LANG.match(lang or "")
    return m.group(1).lower() if m else ""


def _telling(lists: dict[str, dict[str, float]]) -> dict[str, list[tuple[str, float]]]:
    """Word to the languages that it tells, with its share in each."""
    telling: dict[str, list[tuple[str, float]]] = {}
    for lang in sorted(lists):
        for word, share in lists[lang].items():
            if share >= TELLING:
                telling.setdefault(word, []).append((lang, share))
    return telling


def _told(counts: Counter, telling: dict[str, list[tuple[str, float]]], code: str) -> str:
    """The language whose telling words a text has most of; the stated code where it has none, or of equals."""
    votes: dict[str, float] = {}
    for word in counts:
        for lang, share in telling.get(word, ()):
            votes[lang] = votes.get(lang, 0.0) + share
    return max(votes, key=lambda k: (votes[k], k == code, k)) if votes else code


#: Language codes that `language_code` can use.
USABLE = r"(?sU)\A\s*[a-zA-Z]{2}(?:[^a-zA-Z].*)?\s*\z"


def document_frequencies(documents: DataFrame, lists: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(lang, word, n): documents of a language that have a word; word '' counts the documents. Each
    partition adds up its own counts before anything is shuffled. Blank texts count nowhere.

    Without `lists` these are the documents with a usable language code, with them all others, in the
    language that their words tell by the lists (none told: not counted). The sum is over all documents.
    """
    if lists is not None:
        documents = documents.where(~F.coalesce("lang", F.lit("")).rlike(USABLE))
    shared = documents.sparkSession.sparkContext.broadcast(_telling(lists or {}))
    told = lists is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, telling = _Words(), Counter(), shared.value

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code = language_code(lang)
                if bool(code) == told or not text or text.isspace():
                    continue
                found = words.counts(text)
                code = code or _told(found, telling, "")
                if code:
                    counts[code, ""] += 1
                    counts.update((code, w) for w in found)
            if len(counts) > 500_000:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    return documents.select("lang", "text").mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def familiar_words(frequencies: DataFrame) -> dict[str, dict[str, float]]:
    """Words and their shares per language, down to FLOOR; its size is bounded, see FLOOR.

    `frequencies`: a stored table; it is read twice."""
    totals = frequencies.where("word = ''").select("lang", F.col("n").alias("total"))
    listed = frequencies.where("word <> ''").join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= FLOOR)
    lists: dict[str, dict[str, float]] = {}
    for lang, word, share in listed.select("lang", "word", "share").collect():
        lists.setdefault(lang, {})[word] = share
    return lists


def features(documents: DataFrame, lists: dict[str, dict[str, float]]) -> DataFrame:
    """(doc_id, lang, n_words, unfamiliar, sentence): the language told by its frequent words, the
    unfamiliar share per entry of SHARES, and the mean length of sentences in words. Lines of fewer
    than three words (headings, page numbers) are no sentences unless the text has nothing else.
    Null and blank texts have 0 words."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, words = shared.value, _Words()
        telling = _telling(lists)
        for batch in batches:
            langs, sizes, shares, lengths = [], [], [], []
            for stated, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts = words.counts(text) if text else Counter()
                lang = _told(counts, telling, language_code(stated))
                familiar, below, total = lists.get(lang, {}), [0] * (len(SHARES) + 1), 0
                for word, n in counts.items():
                    below[bisect_right(SHARES, familiar.get(word, 0.0))] += n
                    total += n
                rarer = np.cumsum(below)[:-1] / max(total, 1)  # below SHARES[i]
                spans = [len(s.split()) for s in _END.split(text)] if text else []
                spans = [s for s in spans if s >= 3] or [s for s in spans if s] or [0]
                langs.append(lang)
                sizes.append(len(text.split()) if text else 0)
                shares.append(rarer.tolist())
                lengths.append(sum(spans) / len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(shares, pa.list_(pa.float64())), pa.array(lengths, pa.float64())], names=["doc_id", "lang", "n_words", "unfamiliar", "sentence"])

    return documents.select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang string, n_words int, unfamiliar array<double>, sentence double")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Coefficients (constant first) of a ridge logistic regression on standardized columns, by Newton
    steps, turned back to the columns as given; and its loss."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w, keep = np.zeros(z.shape[1]), ridge * len(z) * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + keep + 1e-9 * np.eye(len(w)), z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
    loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    slopes = w[1:] / spread
    return np.concatenate([[w[0] - slopes @ mean], slopes]), loss


def fit(rows: list[tuple[list[float], float, float]]) -> list[tuple[int, np.ndarray]]:
    """For levels 2, 3 and 4: (index into SHARES, coefficients) of the odds that a text is at that
    level or above. The terms are 1, u, s, u * s and u * u; u is the unfamiliar share, s the log of
    1 + sentence length.

    `rows`: unfamiliar shares, sentence length, mean label. Without rows, or where the labels have
    only one side of a level, the odds are those of the labels alone (never, without rows)."""
    models = []
    levels = np.array([r[2] for r in rows])
    shares = np.array([r[0] for r in rows]).reshape(len(rows), len(SHARES))
    s = np.log1p(np.array([r[1] for r in rows]))
    for level in (2, 3, 4):
        y = (levels >= level - 0.5).astype(float)
        if not len(y) or y.min() == y.max():
            models.append((0, np.array([5.0 if len(y) and y.min() == 1 else -5.0, 0.0, 0.0, 0.0, 0.0])))
            continue
        fits = [(*_logistic(np.column_stack([u, s, u * s, u * u]), y), i) for i, u in enumerate(shares.T)]
        w, _, i = min(fits, key=lambda f: f[1])
        models.append((i, w))
    return models


def level(models: list[tuple[int, np.ndarray]]) -> Column:
    """The highest of levels 2 to 4 whose odds are even or better, else 1; null for texts below LEAST_WORDS words."""
    found = F.lit(1)
    for at, (i, w) in enumerate(models, 2):
        u, s = F.col("unfamiliar")[i], F.log1p("sentence")
        terms = (F.lit(1.0), u, s, u * s, u * u)
        odds = sum((F.lit(float(c)) * t for c, t in zip(w[1:], terms[1:])), F.lit(float(w[0])))
        found = F.when(odds >= 0, at).otherwise(found)
    return F.when(F.col("n_words") >= LEAST_WORDS, found)


def reading_levels(found: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, lang, n_words, unfamiliar_share, sentence, reading_level) of each document.

    `found`: from `features`, as a stored table. `labels`: doc_id and reading_level; several labels
    of one document are averaged, null ones ignored, and of more than `max_labels` documents those
    with the smallest hash are used. Documents below LEAST_WORDS words have a null level.
    """
    mean = labels.where("doc_id is not null and reading_level is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("label"))
    sample = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    rows = found.where(F.col("n_words") >= LEAST_WORDS).join(sample, "doc_id").select("unfamiliar", "sentence", "label").collect()
    models = fit([tuple(r) for r in rows])
    return found.select("doc_id", "lang", "n_words", F.col("unfamiliar")[models[-1][0]].alias("unfamiliar_share"), "sentence", level(models).alias("reading_level"))
