"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND for every passage.

Test items are split at white space and lower-cased (A-Z). An item's sentences but the last are its
question, the last its answer; of an item of one sentence the second half is the answer. Items are numbered
by the score that they need, and terms have postings of (item, BM25 weight) in that order. Postings are cut
at every BLOCK items, alike for all terms; a term has its greatest weight of each block, and of all.

Every document is cut into passages of PASSAGE words, the next beginning STRIDE words on, to its end. A run of
PASSAGE - STRIDE words is whole in some passage. Of a longer item the best passage holds at least 16 + L/2 of its L words,
and SURE at most; which ones depends on the offset. So an item needs ``theta`` of what the best passage holds at
the worst offset, and no more than ``theta`` of the least score that SURE of its words in a row get. First, for all passages of a batch at once,
the sum of the distinct terms' greatest weights is held against the least score that any item needs; for
those that pass, the sums of the blocks' greatest weights against what the block's items need. In the blocks that
are left WAND orders the cursors by item, finds the pivot where the greatest weights first reach the least
score needed, and skips to it or scores.

An item that is retrieved is verified on the document's words around the passage, as far as the item is
long: if these have OVERLAP of the 5-word shingles (all words as one, if fewer) of the question and of the
answer, or of the whole item, the document is contaminated.

The index travels with the task. A benchmark of more than MAX_ITEMS items or MAX_ITEM_WORDS words is dealt by hash to
parts of half of that, as the blocks' greatest weights of a part are a dense table; TOGETHER parts are searched in one
pass over the documents, so that what travels is bounded and passes are few. Statistics (document frequency, mean
length) are those of all items.

Defined cases: null and empty texts have no passages; null or empty items can't be found; repeated items
are found each; a document that is shorter than a passage is one passage; repeated rows are searched each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemql.llm.common import map_arrow, materialise, pick
from tandemql.llm.shingles import batches, hash_words, mix

STRIDE = 32
PASSAGE = 2 * STRIDE
SURE = PASSAGE - STRIDE // 2
K1, B = 1.2, 0.75
THETA = 0.5
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 8
MAX_ITEMS, MAX_ITEM_WORDS = 1024, 100_000
#: Parts of an index that a pass holds, some 3 MB each.
TOGETHER = 16

_U = np.uint64


def item_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def question_and_answer(text: str) -> tuple[int, int]:
    """Numbers of words of the question and of the answer."""
    words = item_words(text)
    ends = [i + 1 for i, w in enumerate(words) if re.search(r"[.?!]['\")\]]*$", w)]
    inner = [e for e in ends if e < len(words)]
    cut = inner[-1] if inner else (len(words) + 1) // 2
    return cut, len(words) - cut


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles; of fewer words, one of all."""
    k = max(1, min(k, len(words)))
    out = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for j in range(k):
        out = mix(out + words[j : j + len(out)] * _U(2 * j + 3))
    return out


@dataclass
class Index:
    ids: list[int]
    words: list[np.ndarray]  # of each item, as hashes
    terms: np.ndarray  # sorted hashes
    greatest: np.ndarray  # of each term
    block_max: np.ndarray  # of each term and block of items
    postings: list[tuple[np.ndarray, np.ndarray]]  # of each term: items, weights
    needed: np.ndarray  # score that each item asks of a passage, ascending
    parts: list[list[tuple[int, np.ndarray]]] = field(default_factory=list)  # of each item: (shingle words, distinct shingles) of question, answer, all

    @property
    def least(self) -> float:
        return float(self.needed[0]) if len(self.needed) else math.inf


def worst_offset(told: dict[int, float], flat: list[int]) -> float:
    """What the passage that holds most of an item's weight has of it, at the offset where that is least."""
    return min(
        max(sum(told[k] for k in set(flat[max(0, a - offset) : max(0, a - offset + PASSAGE)])) for a in range(0, offset + len(flat), STRIDE))
        for offset in range(STRIDE)
    )


def build_index(items: list[tuple[int, str]], *, theta: float = THETA, df: dict[int, int] | None = None, total: int | None = None, mean: float | None = None) -> Index:
    """``df``, ``total`` and ``mean``: statistics of all items, where ``items`` is a part of them."""
    items = [(i, t) for i, t in items if i is not None and item_words(t or "")]
    words, at = hash_words([t.encode("utf-8", "surrogatepass") for _, t in items]) if items else (np.zeros(0, np.uint64), np.zeros(1, int))
    own = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    if df is None:
        df = document_frequencies(own)
        total, mean = len(own), float(np.mean([len(w) for w in own])) if own else 1.0
    weighed: list[dict[int, float]] = []
    needed = np.zeros(len(own))
    for i, w in enumerate(own):
        keys, counts = np.unique(w, return_counts=True)
        told = {}
        for key, tf in zip(keys.tolist(), counts.tolist(), strict=True):
            idf = math.log(1 + (total - df[key] + 0.5) / (df[key] + 0.5))
            told[key] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
        weighed.append(told)
        flat = w.tolist()
        runs = min(sum(told[k] for k in set(flat[j : j + SURE])) for j in range(max(1, len(flat) - SURE + 1)))
        needed[i] = theta * min(runs, worst_offset(told, flat))
    order = np.argsort(needed, kind="stable").tolist()
    gathered: dict[int, list[tuple[int, float]]] = {}
    for number, i in enumerate(order):
        for key, weight in weighed[i].items():
            gathered.setdefault(key, []).append((number, weight))
    terms = np.array(sorted(gathered), dtype=np.uint64)
    postings = [tuple(map(np.array, zip(*gathered[t], strict=True))) for t in terms.tolist()]
    block_max = np.zeros((len(terms), -(-len(own) // BLOCK)), dtype=np.float32)
    for row, (numbers, weights) in zip(block_max, postings, strict=True):
        np.maximum.at(row, numbers // BLOCK, weights.astype(np.float32))
    greatest = block_max.max(axis=1) if len(terms) else np.zeros(0, np.float32)
    index = Index([items[i][0] for i in order], [own[i] for i in order], terms, greatest, block_max, postings, needed[order])
    for i in order:
        cut = question_and_answer(items[i][1])[0]
        w = own[i]
        index.parts.append([(max(1, min(SHINGLE, len(p))), np.unique(_runs(p, SHINGLE))) for p in (w[:cut], w[cut:], w)])
    return index


def document_frequencies(own: list[np.ndarray]) -> dict[int, int]:
    keys, counts = np.unique(np.concatenate([np.unique(w) for w in own]), return_counts=True) if own else ([], [])
    return dict(zip(map(int, keys), map(int, counts), strict=True))


def wand(index: Index, terms: list[int], block: int) -> list[tuple[int, float]]:
    """All (item, score) of a block whose score for the distinct ``terms`` (rows of the index) is at least what the item needs."""
    first, end = block * BLOCK, min((block + 1) * BLOCK, len(index.ids))
    least = float(index.needed[first])  # of the block's items, the first needs least
    cursors = []
    for t in terms:
        if (most := float(index.block_max[t, block])) > 0:
            items, weights = index.postings[t]
            a, b = np.searchsorted(items, (first, end))
            cursors.append([items[a:b].tolist(), weights[a:b].tolist(), most, 0])
    found = []
    item_at = lambda c: c[0][c[3]] if c[3] < len(c[0]) else end
    while True:
        cursors = sorted((c for c in cursors if c[3] < len(c[0])), key=item_at)
        total, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            total += c[2]
            if total >= least - 1e-3:
                pivot = item_at(c)
                break
        if pivot < 0:
            return found
        score = 0.0
        for c in cursors:
            while item_at(c) < pivot:
                c[3] += 1
            if item_at(c) == pivot:
                score += c[1][c[3]]
                c[3] += 1
        if score >= index.needed[pivot] - 1e-6:
            found.append((pivot, score))


def overlaps(index: Index, item: int, words: np.ndarray) -> tuple[float, float, float]:
    """Shares of the shingles of the item's question, answer and whole that ``words`` has."""
    out = []
    cache: dict[int, np.ndarray] = {}
    for k, shingles in index.parts[item]:
        if not len(shingles):
            out.append(1.0)
            continue
        if k not in cache:
            cache[k] = _runs(words, k) if len(words) >= k else np.zeros(0, np.uint64)
        out.append(float(np.isin(shingles, cache[k]).mean()))
    return tuple(out)


def _summed(gains: np.ndarray, stride: np.ndarray, total: int) -> np.ndarray:
    """Sums of the rows of ``gains`` by ``stride``, which ascends."""
    out = np.zeros((total, gains.shape[1]), dtype=np.float32)
    if len(stride):
        begin = np.flatnonzero(np.concatenate([[True], stride[1:] != stride[:-1]]))
        out[stride[begin]] = np.add.reduceat(gains, begin, axis=0)
    return out


def able_passages(index: Index, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word in it, block) of the passages whose distinct terms can reach what the block's items need.

    ``rows``: each word's row in the index or -1; ``at``: where each document's words begin, and the end. A
    passage is two strides, so a word counts for the one that begins with its stride, unless its term came
    before in that, and for the one a stride earlier, unless it came before in either.
    """
    sizes = np.diff(at)
    strides = -(-sizes // STRIDE)
    first = np.concatenate([[0], np.cumsum(strides)])
    known = np.flatnonzero(rows >= 0)
    doc = np.searchsorted(at, known, side="right") - 1
    stride = first[doc] + (known - at[doc]) // STRIDE
    key = doc * len(index.terms) + rows[known]
    order = np.argsort(key, kind="stable")
    before = np.full(len(known), -1)
    same = key[order][1:] == key[order][:-1]
    before[order[1:][same]] = stride[order[:-1][same]]
    here = before < stride
    back = (before < stride - 1) & (stride > first[doc])
    greatest = np.bincount(stride[here], index.greatest[rows[known[here]]], minlength=first[-1])
    greatest += np.bincount(stride[back] - 1, index.greatest[rows[known[back]]], minlength=first[-1])
    owner = np.searchsorted(first, np.arange(first[-1]), side="right") - 1
    number = np.arange(first[-1]) - first[owner]
    begins = (number == 0) | (number < strides[owner] - 1)  # the last stride is in the passage before
    able = begins & (greatest >= index.least - 1e-2)
    here &= able[stride]
    back &= able[np.maximum(stride - 1, 0)]
    sums = _summed(index.block_max[rows[known[here]]], stride[here], first[-1])
    sums += _summed(index.block_max[rows[known[back]]], stride[back] - 1, first[-1])
    passage, block = np.nonzero(sums >= index.needed[::BLOCK] - 1e-2)
    return owner[passage], number[passage] * STRIDE, block


def search_batch(index: Index, words: np.ndarray, at: np.ndarray) -> dict[int, dict[int, tuple[float, float, float, float, int]]]:
    """Contaminated documents of a batch, each as item to (score, question, answer, whole, first word of the best passage)."""
    out: dict[int, dict[int, tuple[float, float, float, float, int]]] = {}
    if not len(words) or not len(index.terms):
        return out
    rows = np.searchsorted(index.terms, words)
    rows[rows == len(index.terms)] = 0
    rows[index.terms[rows] != words] = -1
    for doc, a, block in zip(*(x.tolist() for x in able_passages(index, rows, at)), strict=True):
        terms = np.unique(rows[at[doc] + a : min(at[doc] + a + PASSAGE, at[doc + 1])])
        for item, score in wand(index, terms[terms >= 0].tolist(), block):
            size = len(index.words[item])
            own = words[at[doc] : at[doc + 1]]
            question, answer, whole = overlaps(index, item, own[max(0, a - size) : a + PASSAGE + size])
            mine = out.get(doc, {})
            if (min(question, answer) >= OVERLAP or whole >= OVERLAP) and (item not in mine or score > mine[item][0]):
                out.setdefault(doc, {})[item] = (score, question, answer, whole, a)
    return out


FOUND = "doc_id long, item_id long, score double, question double, answer double, whole double, at_word long"


def _searching(indexes: list[Index]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column(0).to_pylist()
            done = 0
            rows: list[tuple] = []
            for raw in batches(part.column(1).to_pylist()):
                words, at = hash_words(raw)
                for index in indexes:
                    for i, items in sorted(search_batch(index, words, at).items()):
                        rows += [(ids[done + i], index.ids[item], *told) for item, told in sorted(items.items())]
                done += len(raw)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    """The items that can be found: with an id and a word."""
    return pick(benchmark, item_id="item_id", text="text").where(F.col("item_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def _indexes(items: DataFrame, theta: float) -> Iterator[list[Index]]:
    """Indexes of all items, in parts within the bound, as many together as a pass holds; an ordinary benchmark is one part."""
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()
    parts = 2 * max(math.ceil(n / MAX_ITEMS), math.ceil((size or 0) / MAX_ITEM_WORDS))
    if parts <= 2:
        yield [build_index([(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()], theta=theta)]
        return
    word = F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " ")), " ")))
    dealt = materialise(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")), "items")
    frequencies = materialise(dealt.select(word.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")), "frequencies")
    for low in range(0, parts, TOGETHER):
        own = dealt.where((F.col("part") >= low) & (F.col("part") < low + TOGETHER))
        rows: dict[int, list[tuple[int, str]]] = {}
        for r in own.orderBy("part", "item_id", "text").collect():  # within the bound of TOGETHER parts
            rows.setdefault(r.part, []).append((r.item_id, r.text))
        terms = frequencies.join(own.select(word.alias("w")).distinct(), "w").collect()
        keys, _ = hash_words([r.w.encode() for r in terms])
        df = dict(zip(map(int, keys), (r.c for r in terms), strict=True))
        yield [build_index(rows[p], theta=theta, df=df, total=n, mean=size / n) for p in sorted(rows)]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", theta: float = THETA) -> DataFrame:
    """A row per document and item that it holds: doc_id, item_id, score, question, answer, whole, at_word. No shuffle."""
    texts = pick(docs, doc_id=id_col, text=text_col)
    items = _items(benchmark)
    found = None
    for indexes in _indexes(items, theta):
        one = map_arrow(texts, _searching(indexes), FOUND)
        found = one if found is None else found.unionByName(one)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", theta: float = THETA) -> DataFrame:
    """``docs`` without the documents that hold a test item, in one pass over whole rows for each group of parts of the index."""
    at = docs.columns.index(text_col)
    items = _items(benchmark)

    def keeping(indexes: list[Index]):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                clean = []
                for raw in batches(part.column(at).to_pylist()):
                    words, offsets = hash_words(raw)
                    found = set().union(*(search_batch(index, words, offsets) for index in indexes))
                    clean += [i not in found for i in range(len(raw))]
                if clean:
                    yield part.filter(pa.array(clean))

        return run

    for indexes in _indexes(items, theta):
        docs = map_arrow(docs, keeping(indexes), docs.schema)
    return docs
