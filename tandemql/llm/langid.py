"""Language identification by interpolated Kneser-Ney character models, one per language.

Counting: the n-grams of orders 1 to ORDER of the labelled sample's texts, per language, on the executors;
the driver gets the distinct n-grams with their counts. The sample is bounded: SAMPLE_DOCS documents of
each language, expected, chosen by a hash of their id, and of these as many as have SAMPLE_CHARS characters together
(one at least). All texts of the sample count whole. More than MAX_LANGS labels are an error, as a model's size grows
with their number; the model travels with the task.

Model: for the highest order the discounted counts, for lower orders the discounted continuation counts
(how many different characters precede), each interpolated with the next lower order; the lowest with a
uniform share. All languages share one sorted array of n-gram hashes, whose rows hold each language's log
probability of the n-gram's last character after the others, and its weight of backing off from the
n-gram as a context. A text is scored by looking its n-grams up in that array: the highest order that is
known there, plus the weights of the contexts that were backed off from.

A text's language is the one of the lowest cross-entropy by character. The texts' best cross-entropies in
the sample calibrate rejection: a text whose own lies above their REJECT_QUANTILE by REJECT_MARGIN bits, and
by SHORT_MARGIN over the root of its length (a short text's mean varies more), is no text of a known
language. ``score`` is the posterior of the best language, all languages alike before,
with the evidence of at most EVIDENCE characters' worth of mean cross-entropy.

Characters are lower-cased; everything but letters counts as a space, and runs of spaces as one.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is rejected; ties go to
the first language by code point; without any labelled text all are ``und``; repeated rows are judged each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemql.llm.common import map_arrow, materialise, pick
from tandemql.llm.shingles import mix

ORDER = 4
DISCOUNT = 0.75
SAMPLE_DOCS = 300
SAMPLE_CHARS = 1 << 22
MAX_LANGS = 500
EVIDENCE = 60
REJECT_QUANTILE = 0.999
REJECT_MARGIN = 1.5
SHORT_MARGIN = 4.0
UNKNOWN = "und"
#: Characters of text that are scored at a time.
CHARACTERS = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_PLANE = 0x10000


def _letters() -> np.ndarray:
    """For the characters of the basic plane: themselves if they are letters or marks, else a space."""
    keep = np.full(_PLANE, 0x20, dtype=np.uint32)
    for cp in range(_PLANE):
        if unicodedata.category(chr(cp))[0] in "LM":
            keep[cp] = cp
    return keep


_KEEP = _letters()


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters, each text with a space before and after, and len(texts) + 1 offsets."""
    joined = "\x00".join((t or "").lower().replace("\x00", " ") for t in texts) + "\x00"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = raw == 0
    high = raw >= _PLANE
    cut = _KEEP[np.where(high, 0x20, raw)]
    if high.any():
        cut[high] = [c if chr(c).isalpha() else 0x20 for c in raw[high].tolist()]
    cut[ends] = 0
    blank = cut == 0x20
    keep = np.ones(len(cut), dtype=bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | ends[:-1]))  # one space of a run; the frame adds its own at the start
    keep[0] = not blank[0]
    cut, ends = cut[keep], ends[keep]
    keep = np.ones(len(cut), dtype=bool)
    keep[:-1] = ~((cut[:-1] == 0x20) & ends[1:])  # nor is the last of a text's runs, now one space, kept at its end
    cut, ends = cut[keep], ends[keep]
    sizes = np.diff(np.concatenate([[-1], np.flatnonzero(ends)])) - 1
    at = np.concatenate([[0], np.cumsum(sizes + 2)])
    out = np.full(at[-1], 0x20, dtype=np.uint32)
    inner = np.ones(at[-1], dtype=bool)
    inner[at[:-1]] = False
    inner[at[1:] - 1] = False
    out[inner] = cut[~ends]
    return out, at


def gram_hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """A hash for the n-gram that begins at each character: a polynomial of its characters, mixed."""
    code = chars.astype(np.uint64)
    rolled = np.full(max(0, len(code) - n + 1), n, dtype=np.uint64)
    for j in range(n):
        rolled = rolled * _BASE + code[j : j + len(rolled)]
    return mix(rolled)


def _inside(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which n-grams lie within one text."""
    ok = np.ones(max(0, size - n + 1), dtype=bool)
    for j in range(1, n):
        edge = at[1:-1] - j
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    return ok


COUNTED = "lang string, n int, gram long, context long, shorter long, seen long"


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a batch, with the hashes of the n-gram's context (without its last) and of its end (without its first character)."""
    for part in parts:
        langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
        for lang in sorted(set(langs)):
            chars, at = characters([t for x, t in zip(langs, texts, strict=True) if x == lang])
            for n in range(1, ORDER + 1):
                inside = _inside(at, len(chars), n)
                grams = gram_hashes(chars, n)[inside]
                if not len(grams):
                    continue
                keys, first, seen = np.unique(grams, return_index=True, return_counts=True)
                where = np.flatnonzero(inside)[first]
                context = gram_hashes(chars, n - 1)[where] if n > 1 else np.zeros(len(keys), np.uint64)
                shorter = gram_hashes(chars, n - 1)[where + 1] if n > 1 else np.zeros(len(keys), np.uint64)
                cols = [pa.array([lang] * len(keys)), pa.array(np.full(len(keys), n, np.int32))]
                cols += [pa.array(x.view(np.int64)) for x in (keys, context, shorter)] + [pa.array(seen.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "n", "gram", "context", "shorter", "seen"])


@dataclass
class Model:
    """Rows of ``keys`` (sorted hashes): ``logp`` and ``backoff`` per language, in bits (negative)."""

    langs: list[str]
    keys: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray
    reject_above: float = np.inf

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        """Row of each n-gram, or -1."""
        at = np.searchsorted(self.keys, grams)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != grams] = -1
        return at

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits by character for each text and language, and which texts have letters. Works on CHARACTERS at a time."""
        chars, at = characters(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        lettered = np.add.reduceat((chars != 0x20).astype(np.int64), at[:-1]) > 0
        for low in range(0, len(chars), CHARACTERS):
            high = min(len(chars), low + CHARACTERS)
            owner = np.searchsorted(at, np.arange(low, high), side="right") - 1
            bits = self._bits(chars[max(0, low - ORDER + 1) : high], np.arange(low, high) - at[owner], min(low, ORDER - 1))
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sums[owner[begin]] -= np.add.reduceat(bits, begin, axis=0, dtype=np.float64)
        return sums / np.maximum(1, np.diff(at) - 1)[:, None], lettered

    def _bits(self, chars: np.ndarray, place: np.ndarray, skip: int) -> np.ndarray:
        """Log probabilities of the characters from ``skip`` on, whose places in their texts are given."""
        bits = np.zeros((len(place), len(self.langs)), dtype=np.float32)
        todo = np.flatnonzero(place > 0)  # the first space is only context
        for n in range(ORDER, 0, -1):
            grams, deep = gram_hashes(chars, n), place[todo] >= n - 1
            rows = np.full(len(todo), -1)
            rows[deep] = self._rows(grams[todo[deep] + skip - n + 1])
            known = rows >= 0
            bits[todo[known]] += self.logp[rows[known]]
            todo, deep = todo[~known], deep[~known]
            if n > 1 and len(todo):
                contexts = np.full(len(todo), -1)
                contexts[deep] = self._rows(gram_hashes(chars, n - 1)[todo[deep] + skip - n + 1])
                had = contexts >= 0
                bits[todo[had]] += self.backoff[contexts[had]]
        bits[todo] += self.logp[-1]  # a character that no language has
        return bits

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits by character of that language, and rejection of each text."""
        if not self.langs:
            zero = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), zero, zero, np.ones(len(texts), dtype=bool)
        bits, lettered = self.entropies(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        sizes = np.array([len(t or "") for t in texts])
        score = 1 / np.exp2((least[:, None] - bits) * np.minimum(EVIDENCE, sizes)[:, None]).sum(axis=1)
        above = self.reject_above + SHORT_MARGIN / np.sqrt(sizes + 1)
        langs = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return langs, np.where(lettered, score, 0.0), np.where(lettered, least, 0.0), ~lettered | (least > above)


def build(counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]) -> Model:
    """``counts``: by language and order the n-grams' hashes, contexts, ends and numbers."""
    langs = sorted(counts)
    keys = np.unique(np.concatenate([c[n][0] for c in counts.values() for n in c])) if langs else np.zeros(0, np.uint64)
    rows = len(keys) + 1  # the last: a character that no language has
    logp, backoff = np.full((rows, len(langs)), -np.inf, dtype=np.float32), np.zeros((rows, len(langs)), dtype=np.float32)
    orders: dict[int, list[np.ndarray]] = {n: [] for n in range(1, ORDER + 1)}
    for c in counts.values():
        for n, (grams, contexts, ends, _) in c.items():
            orders[n].append(np.stack([grams, contexts, ends]))
    every = {n: np.unique(np.concatenate(x, axis=1), axis=1) for n, x in orders.items() if x}
    letters = every[1].shape[1] + 1 if 1 in every else 1
    for k, lang in enumerate(langs):
        p = np.full(rows, 0.0)
        p[-1] = 1.0 / letters
        own = counts[lang]
        for n in range(1, ORDER + 1):
            if n not in every:
                continue
            grams, contexts, ends = every[n]
            number = np.zeros(rows)
            if n == ORDER:
                number[np.searchsorted(keys, own[n][0])] = own[n][3] if n in own else 0
            elif n + 1 in own:  # continuation counts: of the longer n-grams, how many end so
                np.add.at(number, np.searchsorted(keys, own[n + 1][2]), 1)
            at = np.searchsorted(keys, grams)
            mine = number[at]
            if n == 1:
                total, kinds = mine.sum(), (mine > 0).sum()
                free = DISCOUNT * kinds / total if total else 1.0
                p[at] = np.maximum(mine - DISCOUNT, 0) / max(total, 1) + free / letters
                p[-1] = free / letters
            else:
                before = np.searchsorted(keys, contexts)
                total, kinds = np.zeros(rows), np.zeros(rows)
                np.add.at(total, before, mine)
                np.add.at(kinds, before, mine > 0)
                free = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                p[at] = np.maximum(mine - DISCOUNT, 0) / np.maximum(total[before], 1) + free[before] * p[np.searchsorted(keys, ends)]
                used = np.unique(before)
                backoff[used, k] = np.log2(free[used])
        logp[:, k] = np.log2(np.maximum(p, 1e-12))
    return Model(langs, keys, logp, backoff)


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of all languages in ``docs``; labels that are null, and null texts, don't count."""
    rows = pick(docs, doc_id=id_col, lang=lang_col, text=text_col).where("lang IS NOT NULL AND text IS NOT NULL")
    per_lang = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_docs")), "langs")
    kinds = per_lang.count()
    if kinds == 0:
        return build({})
    if kinds > MAX_LANGS:
        raise ValueError(f"{kinds} labels; a model has {MAX_LANGS} at most")
    drawn = rows.withColumn("_draw", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1_000_003)) / 1_000_003)
    drawn = drawn.join(F.broadcast(per_lang), "lang").where(F.col("_draw") < sample_docs / F.col("_docs"))
    before = Window.partitionBy("lang").orderBy("_draw", "doc_id", F.length("text")).rowsBetween(Window.unboundedPreceding, -1)
    sized = drawn.withColumn("_before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    sample = materialise(sized.where(F.col("_before") < SAMPLE_CHARS).select("doc_id", "lang", "text"), "sample")
    counted = map_arrow(sample.select("lang", "text"), _count, COUNTED)
    table = counted.groupBy("lang", "n", "gram").agg(F.min("context").alias("context"), F.min("shorter").alias("shorter"), F.sum("seen").alias("seen")).toPandas()
    counts: dict = {}
    for (lang, n), g in table.groupby(["lang", "n"]):
        g = g.sort_values("gram")
        keys = [g[c].to_numpy().view(np.uint64) for c in ("gram", "context", "shorter")]
        counts.setdefault(lang, {})[int(n)] = (*keys, g["seen"].to_numpy())
    model = build(counts)
    bits = [r.bits for r in identify(sample, model, id_col="doc_id", text_col="text").where("lang_pred <> 'und'").select("bits").collect()]  # the bounded sample
    if bits:
        model.reject_above = float(np.quantile(bits, REJECT_QUANTILE)) + REJECT_MARGIN
    return model


JUDGED = "doc_id long, lang_pred string, score double, bits double, rejected boolean"


def _judged(model: Model, texts: list[str | None]) -> Iterator[tuple[int, int, tuple]]:
    """(from, to, judgement) of runs of the texts of about CHARACTERS each, so that a batch's size doesn't matter."""
    done = 0
    while done < len(texts):
        end, size = done, 0
        while end < len(texts) and (end == done or size + len(texts[end] or "") <= CHARACTERS):
            size += len(texts[end] or "")
            end += 1
        yield done, end, model.judge(texts[done:end])
        done = end


def _judging(model: Model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b, (langs, score, bits, rejected) in _judged(model, part.column(1).to_pylist()):
                ids = part.column(0).slice(a, b - a).cast(pa.int64())
                cols = [ids, pa.array(langs, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "bits", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, lang_pred, score, bits, rejected. No shuffle."""
    return map_arrow(pick(docs, doc_id=id_col, text=text_col), _judging(model), JUDGED)


def keep_known(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` without those that the model rejects, in one pass over whole rows."""
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b, (*_, rejected) in _judged(model, part.column(at).to_pylist()):
                yield part.slice(a, b - a).filter(pa.array(~rejected))

    return map_arrow(docs, run, schema)
