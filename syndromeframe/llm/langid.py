"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps one machine word of language bits per slot. Looking an n-gram up ANDs the words
of its slots, which yields all languages containing it at once. A text's language is the one with the most
n-grams among its popcounts, each corrected for the share that false positives alone would give.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectext

#: Bytes of an n-gram over lower-cased text, runs of other characters than letters as one space.
N = 4
#: Documents of each language that n-grams are learned from, the first ones by a hash of doc_id.
SAMPLE_DOCS = 2000
#: N-grams kept of each language, the most frequent ones.
KEEP = 6000
#: An n-gram belongs to a language if its share there is this part of its largest share in any language.
RATIO = 0.2
SLOTS_LOG2 = 18
HASHES = 3
UNKNOWN = "und"
#: Texts below this corrected share of n-grams of any language are in none of them.
LEAST_SHARE = 0.25

#: A letter by its Unicode category.
_ANY_LETTER = regex.compile(r"\p{L}")
# Bytes of n-grams: signs beyond Latin-1 count as parts of words, which costs a few n-grams and decides nothing alone.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[~_LETTER] = 32
#: Latin-1 signs that aren't letters, by their second UTF-8 byte: after C2 all but these letters, after C3 these two.
_C2_LETTERS = np.array([0xAA, 0xB5, 0xBA], np.uint8)
_C3_SIGNS = np.array([0x97, 0xB7], np.uint8)


def has_letter(texts: list[str | None]) -> np.ndarray:
    """Whether a text holds a letter of any script."""
    return np.fromiter((t is not None and _ANY_LETTER.search(t) is not None for t in texts), bool, len(texts))


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as uint32, n-grams of each document)."""
    low = _LOWER[buf]
    lead = np.flatnonzero((buf == 0xC2) | (buf == 0xC3))
    lead = lead[lead + 1 < len(buf)]
    if len(lead):
        second = buf[lead + 1]
        c2 = buf[lead] == 0xC2
        sign = np.where(c2, ~np.isin(second, _C2_LETTERS), np.isin(second, _C3_SIGNS))
        low[lead[sign]] = 32
        low[lead[sign] + 1] = 32
        up = ~c2 & ~sign & (second < 0x9F)
        low[lead[up] + 1] = second[up] + 0x20
    other = np.flatnonzero(buf == 0xE2)  # punctuation and symbols U+2000 to U+2BFF
    other = other[other + 2 < len(buf)]
    if len(other):
        other = other[buf[other + 1] < 0xB0]
        for k in range(3):
            low[other + k] = 32
    # a run of spaces is one
    first = np.zeros(len(low) + 1, bool)
    first[offs] = True
    keep = low != 32
    keep[1:] |= (low[:-1] != 32) & ~first[1 : len(low)]
    doc = np.cumsum(first[: len(low)] * np.bincount(offs[:-1], minlength=len(low) + 1)[: len(low)]) - 1 if len(low) else np.zeros(0, np.int64)
    text, owner = low[keep], doc[keep]
    # one space before each text and two behind it, so that a single letter makes an n-gram
    m = len(offs) - 1
    bounds = np.searchsorted(owner, np.arange(m + 1))
    at = np.concatenate([bounds[:-1], bounds[1:], bounds[1:]])
    whose = np.concatenate([np.arange(m)] * 3)
    order = np.lexsort((np.repeat([1, 0, 0], m), at, whose))
    text, owner = np.insert(text, at[order], 32), np.insert(owner, at[order], whose[order])
    n = len(text) - N + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
    out = np.zeros(n, np.uint32)
    for k in range(N):
        out = (out << np.uint32(8)) | text[k : k + n]
    whole = owner[:n] == owner[N - 1 :]
    return out[whole], np.bincount(owner[:n][whole], minlength=len(offs) - 1)


@dataclass
class Model:
    """languages: names by bit; slots: (2^SLOTS_LOG2, words) language bits; false_positive: share by language."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray

    def lookup(self, ngrams: np.ndarray) -> np.ndarray:
        """(n-grams, words) bits of the languages that contain each n-gram (or seem to)."""
        found = None
        for slot in _slots(ngrams):
            found = self.slots[slot] if found is None else found & self.slots[slot]
        return found

    def scores(self, ngrams: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """(documents, languages) corrected share of each document's n-grams."""
        bits = self.lookup(ngrams)
        ends = np.cumsum(per_doc)
        out = np.zeros((len(per_doc), len(self.languages)))
        for k in range(len(self.languages)):
            hits = (bits[:, k // 8] >> np.uint8(k % 8)) & np.uint8(1)
            total = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
            share = (total[ends] - total[ends - per_doc]) / np.maximum(per_doc, 1)
            out[:, k] = np.maximum(share - self.false_positive[k], 0) / (1 - self.false_positive[k])
        return out


def _slots(ngrams: np.ndarray) -> list[np.ndarray]:
    x = vectext.mix(ngrams.astype(np.uint64) + np.uint64(1))
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(j) * b) & np.uint64((1 << SLOTS_LOG2) - 1)).astype(np.int64) for j in range(HASHES)]


def build(grams_by_language: dict[str, np.ndarray]) -> Model:
    languages = sorted(grams_by_language)
    slots = np.zeros((1 << SLOTS_LOG2, max(1, -(-len(languages) // 8))), np.uint8)
    for k, name in enumerate(languages):
        for slot in _slots(grams_by_language[name]):
            slots[slot, k // 8] |= np.uint8(1 << (k % 8))
    fill = np.array([((slots[:, k // 8] >> np.uint8(k % 8)) & 1).mean() for k in range(len(languages))])
    return Model(languages, slots, np.minimum(fill**HASHES, 0.5))


def _count(batches):
    counts: dict[str, dict[int, int]] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for row, end, buf, offs in vectext.chunks(batch.column(1)):
            found, per_doc = grams(buf, offs)
            owner = np.repeat(np.arange(row, end), per_doc)
            for name in set(langs[row:end]):
                values, n = np.unique(found[(langs == name)[owner]], return_counts=True)
                own = counts.setdefault(name, {})
                for v, c in zip(values.tolist(), n.tolist(), strict=True):
                    own[v] = own.get(v, 0) + c
    for name, own in counts.items():
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, keep: int = KEEP) -> Model:
    """A model from `text` and non-null `lang` of the given rows (at most sample_docs of each language).

    Only the kept n-grams (at most `keep` by language) reach the driver. Rows with null or empty texts teach nothing.
    """
    common.small_batches(docs.sparkSession)
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    picked = common.first_by_hash(known, "lang", sample_docs, sizes).distinct()
    # at most sample_docs ids of each language
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = common.stored(counts, "lang-grams")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(total), "lang").select("lang", "gram", "n", (F.col("n") / F.col("total")).alias("share"))
    most = share.groupBy("gram").agg(F.max("share").alias("most"))
    own = share.join(most, "gram").filter(F.col("share") >= RATIO * F.col("most"))
    top = own.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= keep)  # of a bounded sample
    found: dict[str, list[int]] = {r.lang: [] for r in total.select("lang").collect()}
    for r in top.select("lang", "gram").collect():
        found[r.lang].append(r.gram)
    return build({k: np.array(v, np.uint32) for k, v in found.items()})


def predict_udf(model: Model):
    """Column function text -> struct(lang_pred, score, share).

    score is the best language's part of all languages' corrected shares, share its corrected share itself.
    A null text or one without a letter (Unicode category L) is `und` with score 0; so is every text if nothing was
    learned. A text with letters whose n-grams are in no language has the first language and score 0.
    """

    @F.arrow_udf("lang_pred string, score double, share double")
    def predict(texts: pa.Array) -> pa.Array:
        names, score, share = [], [], []
        letter = has_letter(texts.to_pylist()) if model.languages else np.zeros(len(texts), bool)
        for row, end, buf, offs in vectext.chunks(texts):
            found, per_doc = grams(buf, offs)
            s = model.scores(found, per_doc) if model.languages and len(found) else np.zeros((len(per_doc), max(1, len(model.languages))))
            best = s.argmax(1)
            top, total = s.max(1), s.sum(1)
            for b, t, all_, n in zip(best.tolist(), top.tolist(), total.tolist(), letter[row:end].tolist(), strict=True):
                names.append(model.languages[b] if n else UNKNOWN)
                score.append(min(1.0, t / all_) if n and all_ > 0 else 0.0)
                share.append(t if n else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], ["lang_pred", "score", "share"])

    return predict


def with_language(docs: DataFrame) -> DataFrame:
    """docs with held_out (crc32 of doc_id modulo 5 is 0), lang_pred, score and share, learned from the other rows.

    Columns that already have these names are replaced, all others stay. Null and empty texts are `und`; rows that
    repeat a doc_id get a prediction each. An empty table gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.drop("held_out", "lang_pred", "score", "share")
    held_out = common.crc_fold("doc_id", 5) == 0
    model = learn(docs.filter(~held_out))
    (found,) = common.fresh([*docs.columns, "held_out", "lang_pred", "score", "share"], "found")
    return docs.withColumn("held_out", held_out).withColumn(found, predict_udf(model)(F.col("text"))).select(*docs.columns, "held_out", *[F.col(found)[c].alias(c) for c in ("lang_pred", "score", "share")])


def known_language(docs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs that read as one of the learned languages, by their corrected share of n-grams.

    Null and empty texts, texts without a letter and texts in none of the languages go; repeated rows stay as often as
    they are; columns stay unchanged. All rows stay if nothing can be learned (no labelled text outside the held-out
    fold). An empty table gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    model = learn(docs.filter(common.crc_fold("doc_id", 5) != 0))
    return docs.filter(predict_udf(model)(F.col("text"))["share"] >= least_share) if model.languages else docs


def query(spark, sf_dir: str) -> DataFrame:
    return with_language(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
