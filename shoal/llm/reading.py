"""Reading level of documents: gradient-boosted regression trees over distributions of text features.

Features are taken of each whole text: distributions of word and sentence length, of how widespread its words are,
of syntax (runs between the most widespread words, marks) and of cohesion between neighbouring sentences. There are no
word lists: how widespread a word is comes from the document frequencies of the corpus itself, hashed into a table of fixed
size; whether a text is English, from models of letter triples learned from the documents' own language labels and from the
labelled documents, which are English.

Both are counted over all documents, in one pass. The trees are fitted on all labelled documents, in parallel folds that leave whole sources out.
Each source's out-of-fold predictions are calibrated (isotonic regression) on those of the others. Every document
comes out, with a level or the reason why it has none.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LABELS = 5
#: Folds of sources, fitted in parallel.
FOLDS = 10
#: Words whose facts a task keeps.
WORDS_HELD = 200_000
MIN_WORDS = 8
#: Buckets of hashed words with their document frequencies, and of hashed letter triples.
DF_BITS, TRIPLE_BITS = 18, 15

#: Words, and the ends of sentences as tokens of their own.
_TOKEN = re.compile(r"([^\W\d_]+(?:['’-][^\W\d_]+)*)|[.!?;:](?=\s)|\n")
_VOWELS = re.compile(r"[aeiouyáéíóúäöüàèêâîôûœæ]+")

FEATURES = [
    "log_words", "words_per_sentence", "sentence_p25", "sentence_p50", "sentence_p75", "sentence_p90", "sentence_sd",
    "letters_per_word", "letters_p50", "letters_p75", "letters_p90", "letters_sd", "share_7", "share_10", "share_13",
    "syllables_per_word", "share_3_syllables", "share_5_syllables", "type_token", "repeat_share",
    "spread_mean", "spread_sd", "spread_p10", "spread_p25", "spread_p50", "share_everyday", "share_rare",
    "run_mean", "run_sd", "long_runs", "commas_per_sentence", "marks_per_word", "digits_per_word", "overlap_mean", "overlap_sd",
]


def _bucket(w: str) -> int:
    return zlib.crc32(w.encode()) & ((1 << DF_BITS) - 1)


def _triples(w: str) -> list[int]:
    s = f" {w} "
    return [zlib.crc32(s[i : i + 3].encode()) & ((1 << TRIPLE_BITS) - 1) for i in range(len(s) - 2)]


class Lexicon:
    """What is known of words: spread (log share of documents by hashed word), and letter models by language, English first.

    spread has one value a bucket, letters one row a language: log-likelihood ratio of each letter triple against letters met at random.
    """

    def __init__(self, spread: np.ndarray, letters: np.ndarray):
        self.spread, self.letters = spread.astype(np.float32), letters.astype(np.float32)

    def facts(self, w: str) -> tuple:
        """(letters, syllables, spread, triples, ratio for each language...) of a word in lower case."""
        t = _triples(w)
        return (len(w), max(1, len(_VOWELS.findall(w))), float(self.spread[_bucket(w)]), len(t), *self.letters[:, t].sum(axis=1).tolist())


class _Facts(dict):
    """Number of every word met; facts by number. Number 0 is the end of a sentence."""

    def __init__(self, lexicon: Lexicon):
        super().__init__({"": 0})
        self.lexicon, self.rows = lexicon, [lexicon.facts("")]

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self.rows)
        self.rows.append(self.lexicon.facts(w))
        return n


def _quantiles(doc: np.ndarray, value: np.ndarray, docs: int, bins: int, at: list[float]) -> list[np.ndarray]:
    """Quantiles by document of whole values below ``bins``."""
    h = np.bincount(doc * bins + np.minimum(value, bins - 1), minlength=docs * bins).reshape(docs, bins).cumsum(axis=1)
    n = np.maximum(h[:, -1:], 1)
    return [(h < q * n).sum(axis=1).astype(float) for q in at]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def features(texts: list[str | None], lexicon: Lexicon, facts: _Facts | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(FEATURES of each text, reason): reason is '' for English prose, else 'no text', 'too short' or 'not English'.

    All texts are taken whole and at once. facts holds what was found of words before; the caller renews it when it grows beyond WORDS_HELD.
    """
    facts = _Facts(lexicon) if facts is None else facts
    docs, ids, sizes, marks = len(texts), [], [], []
    number = facts.__getitem__
    for t in texts:
        t = t or ""
        got = list(map(number, _TOKEN.findall(t.lower())))
        ids += got
        sizes.append(len(got))
        marks.append((t.count(","), sum(map(t.count, "();:-")), sum(map(t.count, "0123456789"))))
    tok = np.array(ids, np.int64)
    doc = np.repeat(np.arange(docs), sizes)
    end = tok == 0
    new = np.ones(len(tok), bool)
    new[1:] = end[:-1] | (doc[1:] != doc[:-1])
    sent = np.cumsum(new) - 1
    tok, doc, sent = tok[~end], doc[~end], sent[~end]
    if not len(tok):
        return np.zeros((docs, len(FEATURES))), np.where([bool(t) for t in texts], "too short", "no text")
    # sentences without words don't count
    first = np.r_[True, sent[1:] != sent[:-1]]
    sent = np.cumsum(first) - 1
    table = np.array(facts.rows)
    wl, syl, spread = table[tok, 0], table[tok, 1], table[tok, 2]
    n = np.bincount(doc, minlength=docs).astype(float)
    some = np.maximum(n, 1)

    def mean(x: np.ndarray, of: np.ndarray = doc, by: np.ndarray = some) -> np.ndarray:
        return np.bincount(of, weights=x, minlength=docs) / by

    def sd(x: np.ndarray, m: np.ndarray, of: np.ndarray = doc, by: np.ndarray = some) -> np.ndarray:
        return np.sqrt(np.maximum(np.bincount(of, weights=x * x, minlength=docs) / by - m * m, 0))

    slen = np.bincount(sent).astype(float)
    sdoc = doc[first]
    ns = np.maximum(np.bincount(sdoc, minlength=docs), 1).astype(float)
    sl = mean(slen, sdoc, ns)
    mwl, msp = mean(wl), mean(spread)
    words = len(facts.rows)
    types = np.bincount(_distinct(doc * words + tok) // words, minlength=docs).astype(float)
    # everyday words are in a fifth of all documents; runs of others between them stand for phrases
    everyday = spread > np.log(0.2)
    stop = everyday | first
    run = np.cumsum(stop)
    rlen = np.bincount(run).astype(float)[1:]
    rdoc = doc[stop]
    nr = np.maximum(np.bincount(rdoc, minlength=docs), 1).astype(float)
    mr = mean(rlen, rdoc, nr)
    # words that a sentence shares with the next of its document, everyday ones aside
    key = _distinct((sent * words + tok)[~everyday])
    ks = key // words
    size = np.bincount(ks, minlength=len(slen))
    at = np.minimum(np.searchsorted(key, key + words), max(len(key) - 1, 0))
    both = np.bincount(ks[key[at] == key + words], minlength=len(slen))[:-1]
    pair = sdoc[:-1] == sdoc[1:]
    share = (both / np.maximum(1, np.minimum(size[:-1], size[1:])))[pair]
    pdoc = sdoc[:-1][pair]
    npair = np.maximum(np.bincount(pdoc, minlength=docs), 1).astype(float)
    mo = mean(share, pdoc, npair)
    comma, mark, digit = np.array(marks, float).T
    low = np.minimum((-spread * 4).astype(np.int64), 63)
    x = np.stack(
        [
            np.log(some), sl, *_quantiles(sdoc, slen.astype(np.int64), docs, 128, [0.25, 0.5, 0.75, 0.9]), sd(slen, sl, sdoc, ns),
            mwl, *_quantiles(doc, wl.astype(np.int64), docs, 32, [0.5, 0.75, 0.9]), sd(wl, mwl), mean(wl >= 7), mean(wl >= 10), mean(wl >= 13),
            mean(syl), mean(syl >= 3), mean(syl >= 5), types / some**0.8, 1 - types / some,
            msp, sd(spread, msp), *_quantiles(doc, low, docs, 64, [0.9, 0.75, 0.5]), mean(everyday), mean(spread < np.log(0.001)),
            mr, sd(rlen, mr, rdoc, nr), mean(rlen >= 5, rdoc, nr), comma / ns, mark / some, digit / some, mo, sd(share, mo, pdoc, npair),
        ],
        axis=1,
    )
    ratio = np.stack([np.bincount(doc, weights=table[tok, 4 + k], minlength=docs) for k in range(len(lexicon.letters))], axis=1)
    english = (ratio[:, 0] > 0) & (ratio[:, 0] >= ratio.max(axis=1))
    reason = np.where(n == 0, "no text", np.where(n < MIN_WORDS, "too short", np.where(english, "", "not English")))
    return x, reason.astype(object)


def _features_by_batch(batches: Iterator[pd.DataFrame], lexicon: Lexicon) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    facts = _Facts(lexicon)
    for pdf in batches:
        if not len(pdf):
            continue
        if len(facts) > WORDS_HELD:
            facts = _Facts(lexicon)
        x, reason = features(pdf["text"].tolist(), lexicon, facts)
        yield pdf, x, reason


def _counted(docs: DataFrame, english: DataFrame | None = None) -> pd.DataFrame:
    """(what, lang, k, n): all counts that a lexicon needs, of all documents, in one pass.

    what is 'documents' (n of them with text), 'spread' (n documents hold a word of bucket k; words of one bucket add up), 'triples' (n letter
    triples of bucket k in the texts of lang) or 'letters' (n letters of code k in them, a blank a word). Languages are the first two letters of
    the labels in ``lang`` (case and blanks aside); labels may be wrong at times. english: (doc_id) documents known to be English, whatever
    their label. There are 2^DF_BITS rows, 2^TRIPLE_BITS a language and one a letter at most; codes of two letters bound the languages.
    """
    rows = docs.filter("text IS NOT NULL")
    code = F.lower(F.substring(F.trim("lang"), 1, 2)) if "lang" in docs.columns else F.lit(None).cast("string")
    rows = rows.select("doc_id", "text", F.when(code.rlike("^[a-z]{2}$"), code).alias("_l"))
    if english is None:
        rows = rows.withColumns({"_l": F.lit(None).cast("string"), "_en": F.lit(False)})
    else:
        # the table of labels, one id each
        taught = english.select("doc_id").distinct().withColumn("_en", F.lit(True))
        rows = rows.join(F.broadcast(taught), "doc_id", "left").withColumn("_en", F.coalesce("_en", F.lit(False)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents, spread, letters = 0, np.zeros(1 << DF_BITS, np.int64), Counter()
        triples: dict[str, np.ndarray] = {}
        holders: Counter = Counter()
        met: dict[str, Counter] = {}

        def settle() -> None:
            """Words held to counts of fixed size."""
            for w, k in holders.items():
                spread[_bucket(w)] += k
            holders.clear()
            for lang, words in met.items():
                t = triples.setdefault(lang, np.zeros(1 << TRIPLE_BITS, np.int64))
                for w, k in words.items():
                    if w:
                        for b in _triples(w):
                            t[b] += k
                        for ch in f" {w}":
                            letters[ch] += k
            met.clear()

        for pdf in batches:
            for text, lang, en in zip(pdf["text"], pdf["_l"], pdf["_en"]):
                documents += 1
                words = _TOKEN.findall(text.lower())
                holders.update(set(words))
                for known in {lang, "en" if en else None} - {None}:
                    met.setdefault(known, Counter()).update(words)
            if len(holders) > WORDS_HELD:
                holders.pop("", None)
                settle()
        holders.pop("", None)
        settle()
        yield pd.DataFrame({"what": ["documents"], "lang": [None], "k": [0], "n": [documents]})
        for what, lang, c in [("spread", None, spread), *(("triples", lang, c) for lang, c in triples.items())]:
            k = np.flatnonzero(c)
            yield pd.DataFrame({"what": what, "lang": lang, "k": k, "n": c[k]})
        yield pd.DataFrame({"what": "letters", "lang": None, "k": list(map(ord, letters.keys())), "n": list(letters.values())})

    got = rows.select("text", "_l", "_en").mapInPandas(count, "what string, lang string, k long, n long")
    return got.groupBy("what", "lang", "k").agg(F.sum("n").alias("n")).toPandas()


def _spread(got: pd.DataFrame) -> np.ndarray:
    n = np.zeros(1 << DF_BITS)
    own = got[got["what"] == "spread"]
    n[own["k"].to_numpy(int)] = own["n"]
    total = max(int(got.loc[got["what"] == "documents", "n"].sum()), 1)
    return np.log(np.minimum((n + 0.5) / (total + 0.5), 1.0))


def _hadamard(x: np.ndarray) -> np.ndarray:
    h = 1
    while h < len(x):
        y = x.reshape(-1, 2, h)
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], 1).reshape(-1)
        h *= 2
    return x


def _at_random(p: dict[str, float]) -> np.ndarray:
    """Share of each bucket among triples of letters drawn with shares p, all triples counted.

    The digest of a triple is the exclusive or of its letters' digests, each at its place among zero bytes, so the shares are a convolution.
    """
    size = 1 << TRIPLE_BITS
    by_bytes: dict[int, list[tuple[bytes, float]]] = {}
    for ch, share in p.items():
        e = ch.encode()
        by_bytes.setdefault(len(e), []).append((e, share))

    def placed(n: int, before: int, after: int) -> np.ndarray:
        x = np.zeros(size)
        for e, share in by_bytes[n]:
            x[zlib.crc32(bytes(before) + e + bytes(after)) & (size - 1)] += share
        return _hadamard(x)

    out = np.zeros(size)
    for a in by_bytes:
        for b in by_bytes:
            for c in by_bytes:
                out += placed(a, 0, b + c) * placed(b, a, c) * placed(c, a + b, 0)
    return np.maximum(_hadamard(out) / size, 0)


def _letters(got: pd.DataFrame) -> np.ndarray:
    own = got[got["what"] == "letters"]
    n = own["n"].to_numpy(float)
    # what a bucket's triples would come to if letters were met at random
    random = 1e-9 + _at_random(dict(zip(map(chr, own["k"]), n / max(n.sum(), 1))))
    own = got[got["what"] == "triples"]
    out = []
    for lang in ["en", *sorted(set(own["lang"]) - {"en"})]:
        c, t = np.zeros(1 << TRIPLE_BITS), own[own["lang"] == lang]
        c[t["k"].to_numpy(int)] = t["n"]
        out.append(np.log(0.8 * c / max(c.sum(), 1) / random + 0.2))
    return np.array(out)


def word_spread(docs: DataFrame) -> np.ndarray:
    """Log share of all documents that hold a word of each bucket."""
    return _spread(_counted(docs))


def letter_models(docs: DataFrame, english: DataFrame) -> np.ndarray:
    """A row a language, English first: log-likelihood ratio of every hashed letter triple against its letters met at random.

    All documents with a label in ``lang`` teach, and those of english: (doc_id).
    """
    return _letters(_counted(docs, english))


def learned_lexicon(docs: DataFrame, english: DataFrame) -> Lexicon:
    """word_spread and letter_models of one pass over the documents."""
    got = _counted(docs, english)
    return Lexicon(_spread(got), _letters(got))


class Trees:
    """Gradient-boosted regression trees of fixed depth on binned features, squared loss."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.08, bins: int = 32, least: int = 4):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.percentile(x[:, j], np.linspace(0, 100, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.asfortranarray(self._bin(x))
        self.base = float(y.mean())
        pred = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            tree, leaf = self._grow(b, y - pred)
            pred += self.rate * tree[2][leaf]
            self.trees.append(tree)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def _grow(self, b: np.ndarray, g: np.ndarray) -> tuple[tuple, np.ndarray]:
        """Level by level: (feature of each inner node, its last bin to the left, leaf values), leaf of each row."""
        nodes = 2**self.depth - 1
        feat, cut = np.zeros(nodes, int), np.full(nodes, self.bins + 1)
        at = np.zeros(len(g), int)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for j in range(b.shape[1]):
                key = at * (self.bins + 1) + b[:, j]
                s = np.bincount(key, weights=g, minlength=width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                n = np.bincount(key, minlength=width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                ts, tn = s[:, -1:], n[:, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((n >= self.least) & (tn - n >= self.least), s**2 / n + (ts - s) ** 2 / (tn - n) - ts**2 / tn, 0.0)
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for w in np.flatnonzero(top > best):
                    best[w], feat[first + w], cut[first + w] = top[w], j, k[w]
            node = first + at
            at = at * 2 + (b[np.arange(len(g)), feat[node]] > cut[node])
        n = np.bincount(at, minlength=nodes + 1)
        values = np.bincount(at, weights=g, minlength=nodes + 1) / np.maximum(n, 1)
        return (feat, cut, values), at

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for feat, cut, values in self.trees:
            at = np.zeros(len(x), int)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = at * 2 + (b[rows, feat[node]] > cut[node])
            out += self.rate * values[at]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(x[order], y[order]):
        blocks.append([v, v, t, 1.0])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            lo, hi, t2, n2 = blocks.pop()
            a = blocks[-1]
            a[2] = (a[2] * a[3] + t2 * n2) / (a[3] + n2)
            a[1], a[3] = hi, a[3] + n2
    return np.array([v for a in blocks for v in (a[0], a[1])]), np.array([t for a in blocks for t in (a[2], a[2])])


class ReadingModel:
    """Trees, the calibration of their predictions, and the lexicon that features need."""

    def __init__(self, trees: Trees, knots: tuple[np.ndarray, np.ndarray], folds: pd.DataFrame, lexicon: Lexicon):
        self.trees, self.knots, self.folds, self.lexicon = trees, knots, folds, lexicon

    def level(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.predict(x), *self.knots), 1.0, 5.0)


def fit_reading_model(docs: DataFrame, labels: DataFrame) -> ReadingModel | None:
    """Fit on all labelled documents; None with fewer than MIN_LABELS usable ones.

    Several labels of a document count as their mean. Labels of documents that don't look English don't count. ``folds`` has each fitted
    document's source, label, out-of-fold prediction, and level by a calibration that has not seen its fold. Labels are given by hand:
    their table is broadcast, and the FEATURES of labelled documents reach the driver and the task of each fold.
    """
    means = labels.filter("doc_id IS NOT NULL AND band IS NOT NULL").groupBy("doc_id").agg(F.avg("band").alias("band"))
    lexicon = learned_lexicon(docs, means)
    # the table of labels
    rows = docs.select("doc_id", "text", "source").join(F.broadcast(means), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, x, reason in _features_by_batch(batches, lexicon):
            yield pdf[["doc_id", "source", "band"]].assign(x=list(x))[reason == ""]

    got = rows.mapInPandas(run, "doc_id long, source string, band double, x array<double>").toPandas()
    if len(got) < MIN_LABELS:
        return None
    got = got.drop_duplicates("doc_id").sort_values("doc_id").reset_index(drop=True)
    x, y = np.array(got["x"].tolist(), float), got["band"].to_numpy(float)
    source = got["source"].fillna("").to_numpy()
    # whole sources to folds, the largest first, each to the smallest fold
    names, n = np.unique(source, return_counts=True)
    load, fold_of = np.zeros(min(FOLDS, len(names))), {}
    for i in np.argsort(-n, kind="stable"):
        k = int(load.argmin())
        fold_of[names[i]] = k
        load[k] += n[i]
    fold = np.array([fold_of[s] for s in source])
    if len(load) == 1:
        # one source only: nothing to leave out, halves by position instead
        fold = np.arange(len(y)) % 2
    folds = int(fold.max()) + 1

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"].tolist():
                train, test = fold != k, fold == k
                if k == folds:
                    yield pd.DataFrame({"fold": [k], "got": [pickle.dumps(vars(Trees().fit(x, y)))]})
                elif train.sum() < MIN_LABELS:
                    yield pd.DataFrame({"fold": [k], "got": [pickle.dumps(np.full(int(test.sum()), y.mean()))]})
                else:
                    yield pd.DataFrame({"fold": [k], "got": [pickle.dumps(Trees().fit(x[train], y[train]).predict(x[test]))]})

    spark = docs.sparkSession
    # one task a fold; the closure holds a row of features a label
    fitted = spark.range(folds + 1, numPartitions=folds + 1).mapInPandas(fit, "fold long, got binary").collect()
    by = {r["fold"]: pickle.loads(bytes(r["got"])) for r in fitted}
    held = np.full(len(y), np.nan)
    for k in range(folds):
        held[fold == k] = by[k]
    level = np.full(len(y), np.nan)
    for k in range(folds):
        level[fold == k] = np.interp(held[fold == k], *isotonic(held[fold != k], y[fold != k]))
    out = got[["doc_id", "source", "band"]].assign(predicted=held, level=np.clip(level, 1, 5))
    whole = Trees()
    vars(whole).update(by[folds])
    return ReadingModel(whole, isotonic(held, y), out, lexicon)


def reading_levels(docs: DataFrame, model: ReadingModel | None) -> DataFrame:
    """(doc_id, level, band, reason) of every document; level and band are null where the reason says why: 'no text' (null, or without words),
    'too short' (under MIN_WORDS words), 'not English', or 'no model'; else reason is ''."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("level"), F.lit(None).cast("int").alias("band"), F.lit("no model").alias("reason"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, x, reason in _features_by_batch(batches, model.lexicon):
            ok = reason == ""
            level = np.full(len(pdf), np.nan)
            if ok.any():
                level[ok] = model.level(x[ok])
            s = pd.Series(level)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "level": s, "band": s.round().astype("Int64"), "reason": reason})

    out = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, level double, band int, reason string")
    return out.withColumn("level", F.nanvl("level", F.lit(None).cast("double")))
