"""Language of documents and of their parts, by language-bitmask n-gram filters.

One table of bytes serves all languages: each n-gram sets the bit of every
language it is typical of in the table's bytes at its hash positions, so one
lookup (the ``and`` of those bytes) returns all languages that contain the
n-gram - eight Bloom filters read as slices of one.  A sentence's n-grams are
looked up, the bits are counted per language, corrected for the filters' rate
of false positives, and the highest count decides.

The filters are learned from a bounded sample of labelled documents; labels
may be partly wrong, as only n-grams typical of a language against all others
are kept, and a second pass learns from the sentences' own decisions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes and names by which the eight languages are labelled.
LANGUAGE_NAMES = {
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "ru": ("ru", "rus", "russian", "русский"),
}
LANGUAGES = tuple(LANGUAGE_NAMES)

N = 5  # letters (and word ends) of an n-gram
TABLE_BITS = 22
CHUNK = 1_000_000  # characters worked on at a time
_END = (1 << 16) - 1  # code that separates documents


def label_code(c: Column) -> Column:
    """The language a label denotes (code, ISO 639-2 code or name, any case, with or without a region); NULL if none."""
    s = F.regexp_extract(F.lower(F.trim(c)), r"^([a-zà-ÿа-яё]+)(?:[-_][a-z0-9]+)?$", 1)
    out = F.lit(None).cast("string")
    for code, names in LANGUAGE_NAMES.items():
        out = F.when(s.isin(list(names)), F.lit(code)).otherwise(out)
    return out


def _char_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point below 2^16: is a letter; ends a sentence if nothing of a word follows; always separates."""
    letter = np.fromiter((chr(i).isalpha() and not 0xD800 <= i < 0xE000 for i in range(1 << 16)), dtype=bool, count=1 << 16)
    letter[_END] = False
    stop, cut = np.zeros(1 << 16, dtype=bool), np.zeros(1 << 16, dtype=bool)
    stop[[ord(x) for x in ".!?…。"]] = True
    cut[[ord("<"), ord(">"), _END]] = True
    return letter, stop, cut


_CLASSES: list = []


def _repair(t: str) -> str:
    """Undo UTF-8 that was read as Latin-1, where the whole text is of that kind."""
    if "Ã" in t or "Ð" in t or "Ñ" in t:
        for enc in ("latin-1", "cp1252"):
            try:
                return t.encode(enc).decode("utf-8")
            except ValueError:
                continue
    return t


def sentence_grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, doc, words): n-gram hashes of all sentences, each sentence's first n-gram, its document and its number of words.

    A sentence ends at ``. ! ?`` not followed by a letter or digit, at an empty
    line, at a markup tag and at the end of the text.  Case does not matter;
    each run of other characters counts as one word end.
    """
    if not _CLASSES:
        _CLASSES.extend(_char_classes())
    letter, stop, cut = _CLASSES
    joined = "￿".join(_repair(t) if t else "" for t in texts).lower()
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = np.where(a < _END, a, np.where(a == _END, _END, ord(" "))).astype(np.uint16)
    n = len(a)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint32), z, z, z
    is_l = letter[a]
    nxt = np.empty(n, dtype=np.uint16)
    nxt[:-1], nxt[-1] = a[1:], _END
    digit = (nxt >= 48) & (nxt <= 57)
    end = (stop[a] & ~letter[nxt] & ~digit) | cut[a]
    nl = a == 10
    if nl.any():  # an empty line: a line end after which, but for blanks, another line end follows
        at = np.flatnonzero(nl)
        gap = np.diff(at)
        for d in (1, 2, 3):
            hit = at[:-1][gap == d]
            ok = np.ones(len(hit), dtype=bool)
            for j in range(1, d):
                ok &= np.isin(a[hit + j], (13, 32, 9))
            end[hit[ok]] = True
    keep = is_l.copy()
    keep[1:] |= is_l[:-1]  # one other character after each word
    keep |= end
    sent = np.zeros(n, dtype=np.int32)
    sent[1:] = np.cumsum(end[:-1], dtype=np.int32)
    docs = np.zeros(n, dtype=np.int32)
    docs[1:] = np.cumsum(a[:-1] == _END, dtype=np.int32)
    k = np.flatnonzero(keep)
    code, kl, ks, kd = np.where(is_l[k], a[k], 32).astype(np.uint32), is_l[k], sent[k], docs[k]
    first = kl & ~digit[k]  # a letter before a digit, as in row names of tables, is no word
    first[1:] &= ~kl[:-1]
    h = np.zeros(len(code), dtype=np.uint32)
    padded = np.concatenate([code, np.full(N, 32, dtype=np.uint32)])
    for i in range(N):
        h = h * np.uint32(0x01000193) + padded[i : i + len(code)] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    starts = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]])) if len(ks) else np.zeros(0, dtype=np.int64)
    words = np.add.reduceat(first.astype(np.int32), starts) if len(starts) else np.zeros(0, dtype=np.int32)
    return h, starts, kd[starts], words


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint32((1 << TABLE_BITS) - 1)
    g = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return h & m, (g ^ (g >> np.uint32(13))) & m


@dataclass
class Model:
    """The byte table, each language's rate of false positives, and the languages in bit order."""

    table: np.ndarray
    false_rate: np.ndarray
    languages: tuple[str, ...] = LANGUAGES

    def counts(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per sentence and language the n-grams in the filter, corrected for false positives; and the number of n-grams."""
        total = np.diff(np.append(starts, len(h))).astype(np.float64)
        if not len(starts):
            return np.zeros((0, len(self.languages))), total
        s1, s2 = _slots(h)
        mask = self.table[s1] & self.table[s2]
        raw = np.stack([np.add.reduceat((mask >> mask.dtype.type(b)) & mask.dtype.type(1), starts, dtype=np.int32) for b in range(len(self.languages))], axis=1)
        return np.clip((raw - total[:, None] * self.false_rate) / (1 - self.false_rate), 0, None), total

    def decide(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, words, language index, confidence, share of n-grams known) of every sentence.

        Confidence is the best language's lead over the second as a share of its count.
        """
        h, starts, doc, words = sentence_grams(texts)
        c, total = self.counts(h, starts)
        if not len(c):
            z = np.zeros(0)
            return doc, words, z.astype(int), z, z
        best = c.argmax(axis=1)
        top = c[np.arange(len(c)), best]
        c[np.arange(len(c)), best] = -1
        second = np.clip(c.max(axis=1), 0, None)
        lead = np.where(top > 0, (top - second) / np.maximum(top, 1e-9), 0.0)
        return doc, words, best, lead, top / np.maximum(total, 1)


def mask_type(languages: Sequence[str]) -> type:
    """The smallest unsigned type with a bit for each language; there may be at most 64."""
    for bits, kind in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)):
        if len(languages) <= bits:
            return kind
    raise ValueError("more than 64 languages")


def _learn(h: np.ndarray, lang: np.ndarray, min_count: int, ratio: float, languages: Sequence[str]) -> Model:
    """Filters of the n-grams whose rate in a language is at least ``ratio`` of their highest rate in any."""
    k, kind = len(languages), mask_type(languages)
    ok = lang >= 0
    h, lang = h[ok], lang[ok]
    grams, inv = np.unique(h, return_inverse=True)
    n = np.bincount(inv * k + lang, minlength=len(grams) * k).reshape(-1, k).astype(np.float64)
    rate = n / np.maximum(n.sum(axis=0), 1)
    typical = (n >= min_count) & (rate >= ratio * rate.max(axis=1, keepdims=True))
    table = np.zeros(1 << TABLE_BITS, dtype=kind)
    s1, s2 = _slots(grams)
    for b in range(k):
        on = typical[:, b]
        table[s1[on]] |= kind(1 << b)
        table[s2[on]] |= kind(1 << b)
    fill = np.array([((table >> kind(b)) & kind(1)).mean() for b in range(k)])
    return Model(table, fill**2, tuple(languages))


def fit(texts: Sequence[str], labels: Sequence[str], min_count: int = 2, ratio: float = 0.25, languages: Sequence[str] = LANGUAGES) -> Model:
    """A model from labelled texts; labels not among the ``languages`` (at most 64) are passed over."""
    at = {c: i for i, c in enumerate(languages)}
    lab = np.array([at.get(x, -1) for x in labels], dtype=np.int64)
    h, starts, doc, words = sentence_grams(texts)
    size = np.diff(np.append(starts, len(h)))
    model = _learn(h, np.repeat(lab[doc], size) if len(starts) else np.zeros(0, dtype=np.int64), min_count, ratio, languages)
    for _ in range(2):  # learn again from what the sentences themselves turned out to be
        _, words, best, lead, known = model.decide(texts)
        sure = (lead > 0.3) & (known > 0.3)
        votes = np.zeros((len(texts), len(languages)))
        np.add.at(votes, (doc[sure], best[sure]), words[sure])
        main = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), lab)  # what an undecided sentence counts as
        own = np.where(sure, best, main[doc])
        model = _learn(h, np.repeat(own, size), min_count, ratio, languages) if len(starts) else model
    return model


def training_sample(docs: DataFrame, text: str, label: str, per_language: int = 400, max_chars: int = 4000) -> tuple[list[str], list[str]]:
    """At most 2 x ``per_language`` labelled texts of up to ``max_chars`` characters of each language, picked by hash.

    The bound (8 x 800 texts of 4,000 characters) holds whatever the size of the corpus.
    """
    d = docs.select(F.col(text).alias("t"), label_code(F.col(label)).alias("l")).filter(F.col("l").isNotNull() & (F.length("t").between(40, max_chars)))
    n = {r["l"]: r["n"] for r in d.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not n:
        return [], []
    picked = F.lit(False)
    for code, rows in n.items():
        picked = picked | ((F.col("l") == code) & (F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, per_language / rows)))))
    got = d.filter(picked).limit(2 * per_language * len(LANGUAGES)).collect()
    return [r["t"] for r in got], [r["l"] for r in got]


def _chunks(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    i = 0
    while i < len(ids):
        j, size = i, 0
        while j < len(ids) and (j == i or size + len(texts[j] or "") <= CHUNK):
            size += len(texts[j] or "")
            j += 1
        yield ids[i:j], texts[i:j]
        i = j


def languages_of(docs: DataFrame, doc_id: str, text: str, model: Model, min_words: int = 6, min_lead: float = 0.25, min_known: float = 0.4, carry: str | None = None) -> DataFrame:
    """(doc_id, lang_code, n_sentences, n_words, confidence): each language a document has full sentences in.

    ``carry`` names a text column of the document that is returned too.

    Only sentences of at least ``min_words`` words count whose language leads by
    ``min_lead`` and of whose n-grams it knows ``min_known``.  Confidence is the
    word-weighted mean of the sentences'.  NULL and empty texts, and texts of
    figures only, have no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the table has 2^TABLE_BITS bytes: 4 MiB
    names = [doc_id, "lang_code", "n_sentences", "n_words", "confidence"] + [carry] * bool(carry)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.languages)
        for b in batches:
            more = b.column(2).to_pylist() if carry else []
            done = 0
            for ids, texts in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc, words, best, lead, known = m.decide(texts)
                on = (words >= min_words) & (lead >= min_lead) & (known >= min_known)
                slot = doc[on].astype(np.int64) * k + best[on]
                at, inv = np.unique(slot, return_inverse=True)
                w = np.bincount(inv, weights=words[on]) if len(at) else np.zeros(0)
                conf = np.bincount(inv, weights=words[on] * lead[on]) / np.maximum(w, 1) if len(at) else np.zeros(0)
                cols = [pa.array([ids[i] for i in at // k], type=b.schema.field(0).type), pa.array([m.languages[i] for i in at % k], type=pa.string()), pa.array(np.bincount(inv, minlength=len(at)).astype(np.int64)), pa.array(w.astype(np.int64)), pa.array(conf.astype(np.float64))]
                cols += [pa.array([more[done + i] for i in at // k], type=pa.string())] if carry else []
                done += len(ids)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"{doc_id} {kind}, lang_code string, n_sentences bigint, n_words bigint, confidence double" + (f", {carry} string" if carry else "")
    return docs.select(doc_id, text, *[carry] * bool(carry)).mapInArrow(run, schema)


def segments_of(docs: DataFrame, doc_id: str, text: str, model: Model, min_words: int = 6, min_lead: float = 0.25, min_known: float = 0.4) -> DataFrame:
    """(doc_id, segment, lang_code, first_sentence, last_sentence, n_words, confidence): runs of sentences in one language.

    Sentences that do not count for ``languages_of`` belong to the run around them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            for ids, texts in _chunks(list(b[doc_id]), list(b[text])):
                doc, words, best, lead, known = m.decide(texts)
                f = pd.DataFrame({"doc": doc, "w": words, "l": best, "c": lead * words, "on": (words >= min_words) & (lead >= min_lead) & (known >= min_known)})
                f["i"] = f.groupby("doc").cumcount()
                f = f[f["on"]]
                new = (f["doc"] != f["doc"].shift()) | (f["l"] != f["l"].shift())
                g = f.groupby(new.cumsum()).agg(doc=("doc", "first"), l=("l", "first"), first_sentence=("i", "first"), last_sentence=("i", "last"), n_words=("w", "sum"), c=("c", "sum"))
                yield pd.DataFrame(
                    {
                        doc_id: pd.Series([ids[i] for i in g["doc"]], index=g.index, dtype=object),  # of this type also where there are no rows
                        "segment": g.groupby("doc").cumcount().astype("int64"),
                        "lang_code": pd.Series([m.languages[i] for i in g["l"]], index=g.index, dtype=object),
                        "first_sentence": g["first_sentence"].astype("int64"),
                        "last_sentence": g["last_sentence"].astype("int64"),
                        "n_words": g["n_words"].astype("int64"),
                        "confidence": (g["c"] / g["n_words"]).astype("float64"),
                    }
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInPandas(run, f"{doc_id} {kind}, segment bigint, lang_code string, first_sentence bigint, last_sentence bigint, n_words bigint, confidence double")
