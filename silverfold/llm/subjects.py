"""Subject areas of documents (problem 9), by an anchored non-negative factorisation.

The document-term matrix V is factored into W H. Each subject is one row of H, anchored by
the words that labelled documents of the subject hold more often than chance; rows for the
languages take the words that name no subject. Alternating multiplicative updates over all
documents spread the anchors to words no label names. A word's share in the subjects' rows then tells what it is
about. A document's subjects are its mixture W over entries that count as evidence: words that name a subject and have
another word of it close by. A word dropped in an aside stands alone and has no weight.

Words are hashed into a fixed number of features, so what is sent to the tasks has a bound
that doesn't grow with the corpus; documents never leave the executors.
"""

from __future__ import annotations

import unicodedata
import zlib
from dataclasses import dataclass
from itertools import chain, repeat
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverfold.session import Stages

_WORD = regex.compile(r"([\p{L}\p{M}]+)")
#: Markup around texts, which names no subject: tags, character entities and JSON objects.
_MARKUP = regex.compile(r"""<[^<>]*>|&\w{2,8};|\{\s*"[^{}]*\}""")
#: How a word follows the one before, by what is between them.
_JOINS = {" ": 1, "-": 2}
#: Other names raters use for subjects (fixed values).
ALIASES = {"legal": "law", "sw": "software"}


@dataclass(frozen=True)
class Settings:
    """Parameters of the factorisation; none depends on the size of the input."""

    features: int = 1 << 20  #: hashed words; bounds the broadcast factors
    min_docs: int = 4  #: documents a feature must occur in to be weighed
    common: float = 0.10  #: a word in a larger part of a language's documents names no subject unless the labels say so
    real: float = 0.02  #: part of the documents a language must have for that rule and for a background row of its own; all others share one
    labelled: int = 50_000  #: labelled documents used at most as anchors
    known: int = 6  #: labelled documents from which a word's lift is tested by its deviation
    sure: float = 4.0  #: deviation from which a frequent word is a subject's, if that has half of its labelled documents
    rounds: int = 5  #: alternating updates of H
    inner: int = 15  #: updates of W in each
    spread: float = 0.06  #: initial weight of an unlabelled word in each subject
    rest: float = 0.10  #: and in the background
    doubt: float = 1.5  #: documents' worth of evidence a word must outweigh
    settled: float = 1e-3  #: mean change of the words' shares at which the updates end earlier
    window: int = 16  #: words between two that name a subject together
    evidence: float = 1.5  #: weight in the document's mixture from which a subject is one of its subjects; a mention weighs 1


def normal(text: str) -> str:
    t = _MARKUP.sub(" | ", text) if "<" in text or "&" in text or "{" in text else text
    return t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold()


def words_of(text: str, features: int, seen: dict):
    """Features, stems and joins of a text's words.

    A join tells how a word follows the one before: 1 by a single space, 2 by a hyphen, 0
    otherwise; 4 is added for words of one or two letters.
    """
    parts = _WORD.split(normal(text))  # what is between words, and the words
    words = parts[1::2]
    if not words:
        return (), (), ()
    try:
        known = list(map(seen.__getitem__, words))
    except KeyError:
        if len(seen) > 500_000:
            seen.clear()
        for w in [w for w in set(words) if w not in seen]:
            seen[w] = (zlib.crc32(w.encode("utf-8", "surrogatepass")) % features, zlib.crc32(w[:4].encode("utf-8", "surrogatepass")) & 0x7FFFFFFF, 4 * (len(w) <= 2))
        known = list(map(seen.__getitem__, words))
    feats, stems, short = zip(*known, strict=True)
    joins = list(map(add, short, chain((0,), map(_JOINS.get, parts[2:-1:2], repeat(0)))))
    return feats, stems, joins


def _lists(rows: list, value) -> pa.ListArray:
    """A list column out of one sequence a row."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(rows), value, offsets[-1])))


def _tokenise(features: int):
    def run(batches):
        seen: dict = {}
        for batch in batches:
            rows = [words_of(t, features, seen) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(_lists([r[i] for r in rows], np.int32) for i in range(3))], ["doc_id", "lang", "f", "stem", "join"])

    return run


def match_label(label: str, subjects: list[tuple[str, str]]) -> int | None:
    """The subject a rater's label means: by name, a beginning of it, a word of its scope, or an alias."""
    parts = [p for p in regex.split(r"[^\p{L}]+", (label or "").casefold()) if p]
    names = [s.casefold() for s, _ in subjects]
    for p in parts:
        for i, s in enumerate(names):
            if p == s or p.startswith(s) or (len(p) >= 3 and s.startswith(p)):
                return i
    for p in parts:
        for i, (_, scope) in enumerate(subjects):
            if len(p) >= 4 and any(w.startswith(p) or p.startswith(w) for w in regex.findall(r"\p{L}{4,}", (scope or "").casefold())):
                return i
    for p in parts:
        if ALIASES.get(p) in names:
            return names.index(ALIASES[p])
    return None


def anchors(df: np.ndarray, by_lang: np.ndarray, n_lang: np.ndarray, nws: np.ndarray, nw: np.ndarray, ns: np.ndarray, n: int, s: Settings) -> np.ndarray:
    """Initial H: subjects first, then one background row a language.

    df: documents of each feature; by_lang, n_lang: the same by language and documents of it;
    nws, nw, ns, n: labelled documents by feature and subject, by feature, by subject, in all.
    """
    k = nws.shape[1]
    prior = (ns + 1e-9) / max(ns.sum(), 1e-9)
    lift = ((nws + ns / max(n, 1)) / (ns + 1)) / ((nw[:, None] + 1) / (n + 1))
    share = lift / np.maximum(lift.sum(axis=1, keepdims=True), 1e-9)
    per_doc = np.maximum(nws.sum(axis=1) / np.maximum(nw, 1), 1)
    chance = nw[:, None] * prior * per_doc[:, None]
    deviation = (nws - chance) / np.sqrt(chance + 0.25)
    tested = nw >= s.known
    good = np.where(tested[:, None], (deviation >= 2.5) & (nws >= 1.6 * chance), (nws >= 1) & (lift >= 2) & (share >= 0.2))
    real = n_lang >= s.real * max(n_lang.sum(), 1)
    common = (by_lang[:, real] / n_lang[real]).max(axis=1, initial=0) > s.common
    # a frequent word is barred unless the labels show it to be one subject's; as every function word is tried
    # for every subject, chance alone passes the test of the others, so that of frequent words is stricter
    common &= ~(tested[:, None] & good & (deviation >= s.sure) & (nws >= 0.5 * nw[:, None])).any(axis=1)
    good &= ~common[:, None]
    # words seen often and by no subject more than by chance stay in the background
    anchored, known = good.any(axis=1), (tested & (nws < 1.6 * chance).all(axis=1)) | common
    topic = np.where(good, share, np.where((known | anchored)[:, None], 0.0, s.spread)) * df[:, None]
    back = np.where(anchored, np.where(tested, 0.0, 0.02), np.where(known, 1.0, s.rest)) * df
    langs = by_lang.shape[1]
    part = (by_lang + 0.1) / (by_lang.sum(axis=1, keepdims=True) + 0.1 * langs)
    h = np.concatenate([topic, back[:, None] * part], axis=1)
    assert h.shape[1] == k + langs
    return h / np.maximum(h.sum(axis=0), 1e-9)


#: Documents of a task of the updates at least, once there are more than tasks at a time.
TASK_DOCS = 1_000_000
#: Entries worked on together; few enough to stay in a processor's cache.
BLOCK = 6_000


def weights(start: np.ndarray, count: np.ndarray, h: np.ndarray, inner: int, floor: float = 1e-3):
    """W of documents whose entries begin at ``start``, by multiplicative updates from equal weights.

    ``h`` has the row of H of each entry. Also yields each entry's parts by component, which add up to its count.
    """
    size = np.diff(np.append(start, len(count)))
    # by component first, so every step runs along memory
    ht = np.ascontiguousarray(h.T)
    w, parts = np.ones((len(ht), len(start)), np.float32), ht.copy()
    for _ in range(inner):
        np.multiply(ht, np.repeat(w, size, axis=1), out=parts)
        parts *= count / np.maximum(parts.sum(axis=0), 1e-30)
        w = np.add.reduceat(parts, start, axis=1)
        w += np.float32(floor)
    return w.T, parts.T


def _blocks(start: np.ndarray, n: int):
    """Slices of documents, and of their entries, of about BLOCK entries each."""
    ends = np.append(start, n)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK, side="right")) - 1)
        yield slice(lo, hi), slice(ends[lo], ends[hi])
        lo = hi


class Factors:
    """Rows of H by feature, as sent to the tasks."""

    def __init__(self, features: int, kept: np.ndarray, h: np.ndarray):
        self.features, self.kept, self.h = features, kept.astype(np.int32), h.astype(np.float32)

    def index(self) -> np.ndarray:
        out = np.full(self.features, -1, np.int32)
        out[self.kept] = np.arange(len(self.kept))
        return out


def _flat(column: pa.Array):
    """The values of a list column, and the row of each."""
    size = np.diff(np.asarray(column.offsets))
    return np.asarray(column.flatten()), np.repeat(np.arange(len(column)), size), size


def _count(sent):
    """Documents to entries: the kept features of each with their counts, in order."""

    def run(batches):
        index = None
        for batch in batches:
            if index is None:
                index = sent.value.index()
                n = max(int(index.max()) + 1, 1)
            f, doc, _ = _flat(batch.column("f"))
            i = index[f]
            there = i >= 0
            key, count = np.unique(doc[there].astype(np.int64) * n + i[there], return_counts=True)
            has, size = np.unique(key // n, return_counts=True)
            offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            word, count = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((key % n).astype(np.int32), count.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(has)), word, count], ["doc_id", "w", "n"])

    return run


def _entries(batch: pa.RecordBatch):
    """First entry of each document of a batch, and the entries' features and counts."""
    word, _, size = _flat(batch.column("w"))
    return (np.cumsum(size) - size).astype(np.int64), word, np.asarray(batch.column("n").flatten())


class _Sums:
    """Sums by feature of what entries give to the components; touched features alone are added to."""

    def __init__(self, shape):
        self.total, self.held, self.n = np.zeros(shape), [], 0

    def add(self, word, parts):
        self.held.append((word, parts))
        self.n += len(word)
        if self.n >= 500_000:
            self.settle()

    def settle(self):
        if self.n:
            word, parts = (np.concatenate(c) for c in zip(*self.held, strict=True))
            order = np.argsort(word, kind="stable")
            word = word[order]
            at = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            self.total[word[at]] += np.add.reduceat(parts[order], at, axis=0, dtype=np.float64)
            self.held, self.n = [], 0


def _update(sent, inner: int):
    def run(batches):
        fac: Factors = sent.value
        sums = _Sums(fac.h.shape)
        for batch in batches:
            start, word, count = _entries(batch)
            for docs, at in _blocks(start, len(word)):
                sums.add(word[at], weights(start[docs] - at.start, count[at], fac.h[word[at]], inner)[1])
        sums.settle()
        some = np.flatnonzero(sums.total.sum(axis=1) > 0)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(sums.total[some, k]) for k in range(sums.total.shape[1]))], ["w", *(f"k{k}" for k in range(sums.total.shape[1]))])

    return run


@dataclass
class Model:
    subjects: list[str]
    factors: Factors
    share: np.ndarray  #: of each kept feature, the part each subject has in it
    entries: DataFrame | None = None  #: documents as kept features and counts


def fit(words: DataFrame, labels: DataFrame, subjects: list[tuple[str, str]], s: Settings, stages: Stages) -> Model:
    """Anchors from the labels, then updates over all documents."""
    spark = words.sparkSession
    k = len(subjects)
    # languages with a share of the documents, at most 1 / real of them, have a background row each; the others one together
    by_lang = [(r.lang, r["count"]) for r in words.where(F.size("f") > 0).groupBy("lang").count().where("lang is not null").orderBy(F.desc("count"), "lang").limit(int(1 / s.real) + 1).collect()]
    whole = words.where(F.size("f") > 0).count() if by_lang else 0
    langs = [g for g, n in by_lang if n >= s.real * whole]
    n_lang = np.array([n for g, n in by_lang if n >= s.real * whole] + [0.0])
    n_lang[-1] = whole - n_lang.sum()
    # documents by feature and language: over all documents; the result is bounded by the features
    seen = words.select("lang", F.explode(F.array_distinct("f")).alias("f"))
    in_lang = [F.count(F.when(F.col("lang") == g, 1)).alias(f"l{i}") for i, g in enumerate(langs)]
    df = seen.groupBy("f").agg(F.count(F.lit(1)).alias("n"), *in_lang).where(F.col("n") >= s.min_docs).orderBy("f").toPandas()
    kept = df["f"].to_numpy()
    spelled = [r[0] for r in labels.where("subject is not null").select("subject").distinct().collect()]
    meant = [(x, i) for x in spelled if (i := match_label(x, subjects)) is not None]
    if not meant or not len(kept):
        return Model([x for x, _ in subjects], Factors(s.features, kept, np.zeros((len(kept), k + len(n_lang)))), np.zeros((len(kept), k)))
    names = F.broadcast(spark.createDataFrame(meant, "subject string, s int"))
    per_doc = labels.where("doc_id is not null").join(names, "subject").groupBy("doc_id").agg(F.collect_set("s").alias("s"))
    few = per_doc.orderBy(F.xxhash64("doc_id")).limit(s.labelled)  # bounded, so it may be broadcast
    marked = words.join(F.broadcast(few), "doc_id").select("s", "f")
    heads = marked.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.array_contains("s", i), 1)).alias(f"s{i}") for i in range(k))).first()
    hits = marked.select("s", F.explode(F.array_distinct("f")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.array_contains("s", i), 1)).alias(f"s{i}") for i in range(k))).toPandas()
    hits = hits.set_index("f").reindex(kept).fillna(0)
    cols = [f"s{i}" for i in range(k)]
    in_langs = df[[f"l{i}" for i in range(len(langs))]].to_numpy(float)
    in_langs = np.concatenate([in_langs, df["n"].to_numpy(float)[:, None] - in_langs.sum(axis=1, keepdims=True)], axis=1)
    h = anchors(df["n"].to_numpy(float), in_langs, n_lang, hits[cols].to_numpy(float), hits["n"].to_numpy(float), np.array([heads[c] for c in cols], float), heads["n"], s)
    share = lambda x: x[:, :k] / (x.sum(axis=1, keepdims=True) + s.doubt)
    index = spark.sparkContext.broadcast(Factors(s.features, kept, np.zeros((len(kept), 0))))
    entries = stages.save(words.select("doc_id", "f").mapInArrow(_count(index), "doc_id long, w array<int>, n array<float>"), n=F.count(F.lit(1)))
    # a task puts out one table of sums, as large as the kept features at most; with so many documents a task, what moves stays a small part of what is read
    tasks = max(spark.sparkContext.defaultParallelism, -(-entries.seen["n"] // TASK_DOCS))
    wide = T.StructType([T.StructField("w", T.IntegerType()), *(T.StructField(f"k{i}", T.DoubleType()) for i in range(h.shape[1]))])
    ks = [f"k{i}" for i in range(h.shape[1])]
    total = np.zeros(h.shape)
    for _ in range(s.rounds):
        sent = spark.sparkContext.broadcast(Factors(s.features, kept, h))
        sums = entries.select("w", "n").coalesce(tasks).mapInArrow(_update(sent, s.inner), wide).groupBy("w").agg(*(F.sum(c).alias(c) for c in ks)).toPandas().sort_values("w")
        old, total = share(total), np.zeros(h.shape)
        total[sums["w"].to_numpy()] = sums[ks].to_numpy()
        h = total / np.maximum(total.sum(axis=0), 1e-9)
        sent.unpersist()
        if np.abs(share(total) - old).sum(axis=1).mean() < s.settled:
            break
    return Model([x for x, _ in subjects], Factors(s.features, kept, h), share(total), entries)


def named(share: np.ndarray) -> np.ndarray:
    """Bits of the subjects each feature names; 0 for words that name none."""
    bits = ((share >= 0.08) * (1 << np.arange(share.shape[1]))).sum(axis=1)
    clear = (share.sum(axis=1) >= 0.5) & (share.max(axis=1, initial=0) >= 0.3) & ((share >= 0.08).sum(axis=1) <= 3)
    return np.where(clear, bits, 0).astype(np.int64)


def _evidence(mentions: list[list[int]], window: int) -> list[tuple[list[int], int]]:
    """Mentions ``[bits, first word, last word, stem, feature]`` with the subjects they are evidence of.

    A mention is evidence of a subject if one of the next or last mentions of it stands within ``window`` words and is another word.
    """
    close = [0] * len(mentions)
    every = 0
    for m in mentions:
        every |= m[0]
    while every:
        bit = every & -every
        every ^= bit
        mine = [i for i, m in enumerate(mentions) if m[0] & bit]
        for x, i in enumerate(mine):
            a = mentions[i]
            for j in mine[x + 1 : x + 4]:
                b = mentions[j]
                if b[1] - a[2] <= window and a[3] != b[3]:
                    close[i] |= bit
                    close[j] |= bit
    # a word said again counts with its close neighbours
    return [(m, c) for m, c in zip(mentions, close, strict=True) if c]


def _assign(sent, window: int, inner: int, least: float):
    def run(batches):
        tables = None
        for batch in batches:
            if tables is None:
                features, kept, bits, share = sent.value
                index = np.full(features, -1, np.int32)
                index[kept] = np.arange(len(kept))
                of = np.append(bits, 0)  # -1 is no feature
                tables = True
                subjects = 1 << np.arange(share.shape[1])
            f, doc, size = _flat(batch.column("f"))
            stem, join = np.asarray(batch.column("stem").flatten()), np.asarray(batch.column("join").flatten())
            i = index[f]
            b = of[i]
            hit = np.flatnonzero(b)
            first = np.append(0, np.cumsum(size))[:-1]
            where, bit, stems, words = doc[hit].tolist(), b[hit].tolist(), stem[hit].tolist(), i[hit].tolist()
            pos = (hit - first[doc[hit]]).tolist()
            # joined to the word before; or to the one before that, over a word of one or two letters
            near = ((join[hit] & 3) > 0).tolist()
            over = (((join[hit] & 3) == 1) & (hit > 0) & ((join[hit - 1] & 5) == 5)).tolist()
            of_doc, starts, word, mask, at = [], [], [], [], 0
            while at < len(where):
                d, mentions = where[at], []
                while at < len(where) and where[at] == d:
                    last = mentions[-1] if mentions else None
                    step = pos[at] - last[2] if last else 0
                    if last and last[0] & bit[at] and ((step == 1 and near[at]) or (step == 2 and over[at])):
                        last[0] &= bit[at]
                        last[2] = pos[at]
                    else:
                        mentions.append([bit[at], pos[at], pos[at], stems[at], words[at]])
                    at += 1
                got = _evidence(mentions, window) if len(mentions) > 1 else ()
                if got:
                    of_doc.append(d)
                    starts.append(len(word))
                    word += [m[4] for m, _ in got]
                    mask += [c for _, c in got]
            if not word:
                continue
            # the documents' mixtures over what is evidence
            h = np.where(np.array(mask, np.int64)[:, None] & subjects, share[word], 0.0).astype(np.float32)
            w, _ = weights(np.array(starts, np.int64), np.ones(len(word), np.float32), h, inner, 1e-6)
            r, s = np.nonzero(w >= least)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.array(of_doc, np.int64)[r])), pa.array(s.astype(np.int32)), pa.array(w[r, s].astype(np.float64))], ["doc_id", "s", "weight"])

    return run


def _mixtures(sent, k: int, inner: int):
    def run(batches):
        fac: Factors = sent.value
        for batch in batches:
            start, word, count = _entries(batch)
            if len(word):
                w, _ = weights(start, count, fac.h[word], inner)
                part = w[:, :k] / w.sum(axis=1, keepdims=True)
                r, s = np.nonzero(part >= 0.01)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(r)), pa.array(s.astype(np.int32)), pa.array(part[r, s].astype(np.float64))], ["doc_id", "s", "weight"])

    return run


def _words(docs: DataFrame, doc_id: str, text: str, lang: str | None, s: Settings, stages: Stages) -> DataFrame:
    group = F.lower(F.trim(F.col(lang))) if lang else F.lit("")
    narrow = docs.where(F.col(doc_id).isNotNull() & (F.length(F.trim(F.col(text))) > 0)).select(F.col(doc_id).cast("long").alias("doc_id"), group.alias("lang"), F.col(text).alias("text"))
    return stages.save(narrow.mapInArrow(_tokenise(s.features), "doc_id long, lang string, f array<int>, stem array<int>, join array<int>"))


def _prepare(docs, labels, subjects, doc_id, text, lang, s):
    stages = Stages(docs.sparkSession, "subjects")
    listed = [(r[0], r[1]) for r in subjects.where("subject is not null").select("subject", "scope").distinct().orderBy("subject", "scope").limit(64).collect()]
    if len(listed) > 60:
        raise ValueError("more than 60 subjects")
    words = _words(docs, doc_id, text, lang, s, stages)
    model = fit(words, labels, listed, s, stages)
    stages.keep(words, model.entries)
    return words, model


def assign_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", settings: Settings = Settings()) -> DataFrame:
    """Subjects of each document: rows ``doc_id, subject``, one for each it is about.

    ``labels`` has ``doc_id, subject`` by hand, in part wrong or spelled otherwise;
    ``subjects`` has ``subject, scope``, at most 60. ``lang`` groups the documents for the
    rule on common words and may be null or wrong in places.

    Null, empty and blank texts and null ids have no row, nor have texts without two words that name a
    subject near each other. Repeated rows give a subject once. Whole texts are read. Without usable
    labels, or with an empty table, no document has a row. Other columns are ignored.
    """
    words, model = _prepare(docs, labels, subjects, doc_id, text, lang, settings)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((settings.features, model.factors.kept, named(model.share), model.share))
    found = words.select("doc_id", "f", "stem", "join").mapInArrow(_assign(sent, settings.window, 2 * settings.inner, settings.evidence), "doc_id long, s int, weight double")
    return found.join(_names(spark, model), "s").select("doc_id", "subject").distinct()


def subject_mixtures(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", settings: Settings = Settings()) -> DataFrame:
    """Each document's weights in the factorisation: ``doc_id, subject, weight``, from 0.01 on.

    The weights of a document add up to 1 with those of the background. Nulls, empty
    texts and empty tables are treated as by ``assign_subjects``.
    """
    words, model = _prepare(docs, labels, subjects, doc_id, text, lang, settings)
    spark = docs.sparkSession
    if not model.factors.h.any():
        return spark.createDataFrame([], "doc_id long, subject string, weight double")
    sent = spark.sparkContext.broadcast(model.factors)
    found = model.entries.mapInArrow(_mixtures(sent, len(model.subjects), settings.inner), "doc_id long, s int, weight double")
    return found.join(_names(spark, model), "s").groupBy("doc_id", "subject").agg(F.max("weight").alias("weight"))


def _names(spark, model: Model) -> DataFrame:
    return F.broadcast(spark.createDataFrame(pd.DataFrame({"s": range(len(model.subjects)), "subject": model.subjects}).astype({"s": "int32"}), "s int, subject string"))
