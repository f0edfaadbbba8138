"""Language identification by interpolated Kneser-Ney character models.

One model a language over the characters of lower-cased words, padded at both
ends. Of each order the n-grams of all languages lie in one sorted array of
64-bit hashes, with a row of interpolated log-probabilities per language beside
it, so a lookup serves every language at once; an n-gram that no language has
seen backs off by its context's weight. A text takes the language of the lowest
cross-entropy per character, and is rejected beyond a bound calibrated per
language on labelled texts that the counts didn't see, whatever the table's size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.llm.rows import row_key
from wavecrate.llm.scratch import materialize
from wavecrate.shipping import ship

ORDER = 5
#: Labelled rows a language that the counts are fitted on, about: the sample's bound.
SAMPLE = 800
#: Labelled rows a language that the rejection bound is calibrated on, about.
CALIBRATION = 300
#: Parts of a language's rows that are left out in turn where it has too few for rows of their own.
FOLDS = 3
#: Share of a language's own documents that its bound may reject, if cross-entropies beyond the median fall off exponentially.
RATE = 1e-6
#: The bound lies so many times the upper half's spread (ninth decile less median) beyond the median, and SLACK at least.
SPREAD, SLACK = math.log(0.5 / RATE) / math.log(5), 2.0
#: Short texts say little: the margin grows by sqrt(1 + EVIDENCE / characters).
EVIDENCE = 100
#: Words that a worker remembers, and the longest that it does.
MEMORY, LONGEST = 100_000, 24
#: Rows that are filtered at once.
SLICE = 500
#: Characters scored at once.
BLOCK = 400_000
WORD = re.compile(r"[^\W\d_]+")
START, STOP = 2, 3
NONE = "und"


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; signs such as superscript digits may stand among letters but not alone."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 to ``order``, the hash of the k codes that end at each place (places before the first wrap round)."""
    out, h = [], np.full(len(codes), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(order):
        h = (h ^ (np.roll(codes, k) + np.uint64(k << 40))) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def _padded(items: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words with their padding, the predicted places, and each word's number of those."""
    lengths = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
    text = "".join(items).encode("utf-32-le", "surrogatepass")
    chars = np.frombuffer(text, dtype="<u4").astype(np.uint64)
    pad = order - 1
    total = len(chars) + len(items) * (pad + 1)
    ends = np.cumsum(lengths + pad + 1)
    codes = np.full(total, START, dtype=np.uint64)
    codes[ends - 1] = STOP
    predicted = np.ones(total, dtype=bool)
    firsts = ends - (lengths + pad + 1)
    for k in range(pad):
        predicted[firsts + k] = False
    inner = predicted.copy()
    inner[ends - 1] = False
    codes[inner] = chars
    return codes, np.flatnonzero(predicted), lengths + 1


@dataclass
class Model:
    langs: list[str]
    order: int
    #: By order, from 1: sorted hashes of n-grams and their log-probabilities, a column a language.
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    #: By order: sorted hashes of contexts and their log back-off weights.
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    #: By language, the usual cross-entropy and the margin beyond it that long texts are accepted in.
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def score(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word, its log-probability by language and its number of predicted characters."""
        codes, at, n = _padded(items, self.order)
        grams = _hashes(codes, self.order)
        total = np.zeros((len(at), len(self.langs)), dtype=np.float32)
        open_ = np.arange(len(at))
        for k in range(self.order, 0, -1):
            place = at[open_]
            seen, row = _find(self.keys[k - 1], grams[k - 1][place])
            total[open_[seen]] += self.logp[k - 1][row[seen]]
            open_, place = open_[~seen], place[~seen]
            if not len(open_):
                break
            known, row = _find(self.contexts[k - 1], _context(grams, k, place))
            total[open_[known]] += self.weights[k - 1][row[known]]
            if k == 1:
                total[open_] += np.float32(-np.log(len(self.keys[0]) + 1))
        return np.add.reduceat(total, np.concatenate(([0], np.cumsum(n)[:-1])), axis=0), n


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return (keys[row] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)), row


def _context(grams: list[np.ndarray], k: int, place: np.ndarray) -> np.ndarray:
    return grams[k - 2][place - 1] if k > 1 else np.zeros(len(place), dtype=np.uint64)


def fit(counts: dict[str, Counter], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney models of words with counts, by language."""
    langs = sorted(counts)
    model = Model(langs, order)
    own: list[list[tuple]] = [[] for _ in range(order)]
    for lang in langs:
        items = [w for w, c in counts[lang].items() if w]
        codes, at, n = _padded(items, order)
        grams = _hashes(codes, order)
        weight = np.repeat(np.fromiter((counts[lang][w] for w in items), dtype=np.float64, count=len(items)), n)
        longer: tuple | None = None
        for k in range(order, 0, -1):
            if longer is None:  # the highest order counts occurrences
                keys, first, inverse = np.unique(grams[k - 1][at], return_index=True, return_inverse=True)
                c, places = np.bincount(inverse, weights=weight), at[first]
            else:  # lower orders count the characters that an n-gram follows
                keys, first, inverse = np.unique(grams[k - 1][longer], return_index=True, return_inverse=True)
                c, places = np.bincount(inverse).astype(float), longer[first]
            longer = places
            context = _context(grams, k, places)
            below = grams[k - 2][places] if k > 1 else np.zeros(len(places), dtype=np.uint64)
            heads, group = np.unique(context, return_inverse=True)
            one, two = float((c == 1).sum()), float((c == 2).sum())
            d = min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
            sums = np.bincount(group, weights=c)
            bow = d * np.bincount(group) / sums
            own[k - 1].append((keys, np.maximum(c - d, 0) / sums[group], context, below, heads, bow))
    before = np.empty((0, len(langs)))
    for k in range(1, order + 1):
        keys, first = np.unique(np.concatenate([o[0] for o in own[k - 1]]), return_index=True)
        context = np.concatenate([o[2] for o in own[k - 1]])[first]
        below = np.concatenate([o[3] for o in own[k - 1]])[first]
        heads = np.unique(np.concatenate([o[4] for o in own[k - 1]]))
        bows, p = np.ones((len(heads), len(langs))), np.zeros((len(keys), len(langs)))
        for j, o in enumerate(own[k - 1]):
            bows[np.searchsorted(heads, o[4]), j] = o[5]
            p[np.searchsorted(keys, o[0]), j] = o[1]
        lower = 1 / (len(keys) + 1) if k == 1 else before[np.searchsorted(model.keys[k - 2], below)]
        before = p + bows[np.searchsorted(heads, context)] * lower
        model.keys.append(keys)
        model.logp.append(np.log(before).astype(np.float32))
        model.contexts.append(heads)
        model.weights.append(np.log(bows).astype(np.float32))
    return model


class Scorer:
    """A model with the words that were scored lately."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs)), dtype=np.float32)
        self.size = np.zeros(1024, dtype=np.int64)

    def block(self, texts: list[list[str]]) -> list[tuple[np.ndarray, int]]:
        """For each text, its log-probability by language and its number of predicted characters."""
        if len(self.index) > MEMORY:
            self._forget()
        index = self.index
        new = list({w for t in texts for w in t if w not in index and len(w) <= LONGEST})
        if new:
            scores, n = self.model.score(new)
            first, need = len(index), len(index) + len(new)
            if need > len(self.rows):
                more = max(need, 2 * len(self.rows)) - len(self.rows)
                self.rows = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]), dtype=np.float32)])
                self.size = np.concatenate([self.size, np.zeros(more, dtype=np.int64)])
            self.rows[first:need], self.size[first:need] = scores, n
            index.update(zip(new, range(first, need)))
        out = []
        for t in texts:
            at = [index[w] for w in t if len(w) <= LONGEST]
            total, n = self.rows[at].sum(axis=0, dtype=np.float64), int(self.size[at].sum())
            if len(at) < len(t):
                scores, m = self.model.score([w for w in t if len(w) > LONGEST])
                total, n = total + scores.sum(axis=0), n + int(m.sum())
            out.append((total, n))
        return out


_SCORERS: dict[int, Scorer] = {}


def judge(scorer: Scorer, texts: list[list[str]]) -> list[tuple[str, float, float | None, bool]]:
    """(language, score, cross-entropy, rejected) of each text's words."""
    out = []
    for words_, (total, n) in zip(texts, scorer.block(texts)):
        if not words_:
            out.append((NONE, 0.0, None, True))
            continue
        entropy = -total / n
        best = int(np.argmin(entropy))
        lang, share = scorer.model.langs[best], np.exp(entropy[best] - entropy)
        middle, margin = scorer.model.bounds.get(lang, (0.0, math.inf))
        rejected = entropy[best] > middle + margin * math.sqrt(1 + EVIDENCE / n)
        out.append((lang, float(1 / share.sum()), float(entropy[best]), bool(rejected)))
    return out


def judge_all(scorer: Scorer, texts: pa.Array) -> list[tuple[str, float, float | None, bool]]:
    found, waiting, chars = [], [], 0
    for text in texts:
        t = text.as_py()
        waiting.append(words(t))
        chars += len(t or "")
        if chars >= BLOCK:
            found += judge(scorer, waiting)
            waiting, chars = [], 0
    return found + judge(scorer, waiting)


def _scorer(mark: int, shared: Broadcast) -> Scorer:
    """The worker's scorer of a broadcast model; one model is held at a time."""
    scorer = _SCORERS.get(mark)
    if scorer is None:
        _SCORERS.clear()
        scorer = _SCORERS.setdefault(mark, Scorer(shared.value))
    return scorer


def _held_out(ident: Column) -> Column:
    """Whether a row is kept from learning: checksum of its id, modulo 4, is 2. A null id learns nothing and is not held out."""
    return F.crc32(ident.cast("string")) % 4 == 2


def _predicted(rows: DataFrame, model: Model) -> DataFrame:
    """``rows``: doc_id, row_key, text."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    mark = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(mark, shared)
        for batch in batches:
            found = judge_all(scorer, batch.column(2))
            columns = list(zip(*found)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "row_key", "lang_pred", "score", "entropy", "rejected"])

    return rows.mapInArrow(run, "doc_id long, row_key binary, lang_pred string, score double, entropy double, rejected boolean")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, int], Counter] = {}
    for batch in batches:
        for lang, fold, text in zip(batch.column(0), batch.column(1), batch.column(2)):
            counts.setdefault((lang.as_py(), fold.as_py()), Counter()).update(words(text.as_py()))
    rows = [(lang, fold, w, c) for (lang, fold), words_ in counts.items() for w, c in words_.items()]
    if rows:
        langs, folds, items, n = zip(*rows)
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(folds, pa.int32()), pa.array(items, pa.string()), pa.array(n, pa.int64())], names=["lang", "fold", "word", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model:
    """Fit and calibrate on about ``sample`` and ``calibration`` labelled rows a language, drawn by a hash of the id from all that may be learned from."""
    ship(docs.sparkSession)
    ident = F.col(id_col)
    usable = F.col(lang_col).isNotNull() & ident.isNotNull() & ~_held_out(ident) & (F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in docs.filter(usable).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], ORDER)
    span = 1 << 31
    draw = F.pmod(F.xxhash64(ident.cast("string"), F.lit("langid")), F.lit(span))
    rates = docs.sparkSession.createDataFrame([(k, int(span * sample / n), int(span * (sample + calibration) / n)) for k, n in sizes.items()], "lang string, fit long, hold long")
    drawn = docs.filter(usable).select(ident.cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    drawn = materialize(drawn.join(F.broadcast(rates), "lang").filter("draw < hold"), "langid-sample")
    # Languages with rows enough are calibrated on rows of their own, the others on the folds that a model has not seen.
    rare = [k for k, n in sizes.items() if n < sample + calibration]
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    drawn = drawn.withColumn("fold", F.when(F.col("lang").isin(rare), fold).otherwise(-1))
    rows = drawn.filter((F.col("draw") < F.col("fit")) | (F.col("fold") >= 0)).select("lang", "fold", "text").mapInArrow(_word_counts, "lang string, fold int, word string, n long")
    table = rows.groupBy("lang", "fold", "word").agg(F.sum("n").alias("n")).toArrow()
    folds: dict[tuple[str, int], Counter] = {}
    for lang, k, word, n in zip(*(table[c].to_pylist() for c in ("lang", "fold", "word", "n"))):
        folds.setdefault((lang, k), Counter())[word] = n

    def without(left_out: int | None) -> dict[str, Counter]:
        counts: dict[str, Counter] = {}
        for (lang, k), c in folds.items():
            if k != left_out:
                counts.setdefault(lang, Counter()).update(c)
        return counts

    if not folds:
        return Model([], ORDER)
    model = fit(without(None))
    unseen = []
    if len(rare) < len(sizes):
        unseen.append((model, drawn.filter("fold < 0 and draw >= fit")))
    for k in range(FOLDS) if rare else ():
        if counts := without(k):
            unseen.append((fit(counts), drawn.filter(F.col("fold") == k)))
    scored = None
    for other, part in unseen:
        found = _predicted(part.select("doc_id", F.lit(b"").alias("row_key"), "text"), other).filter("entropy is not null").select("lang_pred", "entropy")
        found = materialize(found, "langid-calibration")  # a worker holds one model at a time
        scored = found if scored is None else scored.union(found)
    for r in scored.groupBy("lang_pred").agg(F.expr("percentile(entropy, array(0.5, 0.9))").alias("q")).collect():
        middle, high = r["q"]
        model.bounds[r["lang_pred"]] = (middle, max(SLACK, SPREAD * (high - middle)))  # far beyond what labelled texts reach
    return model


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, held_out, lang_pred, score, entropy, rejected.

    lang_pred is a learned label, or ``und`` for null texts and texts without a
    letter (score 0, rejected). score is the best language's share of the inverse
    per-character perplexities. rejected: the cross-entropy is beyond the
    language's bound. Ties take the first label in order. Repeated rows are judged
    alike; whole texts are read however long. Without a labelled row, as in an
    empty table, every text is ``und``. Other columns are not read.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    ident = F.col(id_col)
    rows = docs.select(ident.cast("long").alias("doc_id"), row_key(ident, F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    held = F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    if not model.langs:
        return rows.select("doc_id", "row_key", held, F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    return _predicted(rows, model).select("doc_id", "row_key", held, "lang_pred", "score", "entropy", "rejected")


def accepted_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that identification doesn't reject, with all their columns.

    Where nothing can be learned, nothing is rejected.
    """
    spark = docs.sparkSession
    model = model or train(docs, id_col, text_col, lang_col)
    if not model.langs:
        return docs
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    mark, place = shared._jbroadcast.id(), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(mark, shared)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):  # so that never a whole batch is copied
                part = batch.slice(first, SLICE)
                yield part.filter(pa.array([not r[3] for r in judge_all(scorer, part.column(place))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
