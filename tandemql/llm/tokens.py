"""Token ids of whole texts in binary shards, compressed by Re-Pair grammars.

Documents are dealt and sorted by id, and encoded. A shard holds the documents of about SHARD_IDS ids.
In it, pairs of neighbouring symbols that are frequent are replaced by nonterminals, until none is: each
round counts the pairs that may be, gives the PAIRS_A_ROUND most frequent a rule each,
and replaces their occurrences from left to right, where they overlap the earlier. A pair is frequent if it occurs
LEAST_COUNT times: a rule takes 8 bytes (two symbols and a length) and saves 2 for each. A run of one symbol counts
its overlapping pairs, of which every second is replaced. Pairs never reach over
the end of a document, so each document has a symbol string of its own and can be decoded alone.

The file format is Parquet with a row per shard, written by Spark, so that it goes wherever Spark writes,
and a task that is lost or run twice leaves no half-written file:

* ``part``, ``shard``: the partition (ascending in id ranges) and the shard's number in it,
* ``before``: ids in the partition's earlier shards, ``n_ids``: ids in this one,
* ``first``: the number of the first nonterminal (symbols below are ids), ``wide``: bytes of a symbol,
* ``rules``: two symbols for each nonterminal, ``lengths``: how many ids it stands for (uint32),
* ``symbols``: the documents' symbols, ``offsets``: where each document's begin, and the end (uint32),
* ``doc_ids``: their ids, ascending.

All binary columns are little-endian. A document is read by its slice of ``symbols``; the rules' lengths
say where each symbol's ids go, so any of its ids can be found without decoding what comes before.

Defined cases: a null text is empty, and has the end id only; a null doc_id sorts first; rows of one id
are ordered by text length and digest; an empty table gives files without rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemql.llm.common import map_arrow, pick, running_before
from tandemql.storage import fresh_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SHARD_IDS = 1 << 18
PAIRS_A_ROUND = 1024
LEAST_COUNT = 8
#: Slots of the table that pairs are looked up in.
SLOTS = 1 << 17
#: Bytes of texts that are encoded at a time, or one text if that is longer.
GROUP_BYTES = 1 << 22
#: Pieces whose ids a worker remembers, some 50 bytes each.
REMEMBERED = 1 << 20
#: Pieces that are given to the library in one text.
TOGETHER = 100

SHARD = (
    "part int, shard int, before long, n_ids long, first int, wide int, rules binary, lengths binary, "
    "symbols binary, offsets binary, doc_ids array<long>"
)


def repair(ids: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols, offsets of the documents' symbols) for ``ids``, whose documents end before ``ends``."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), dtype=bool)
    last[ends[ends > 0] - 1] = True
    empty = np.diff(np.concatenate([[0], ends])) == 0
    rules: list[np.ndarray] = []
    fresh = first
    table, rank = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=np.uint32)
    maybe = np.ones(len(symbols), dtype=bool)  # where a frequent pair may begin: others have been counted, and counts only fall
    while len(symbols) > 1:
        maybe &= ~last
        at = np.flatnonzero(maybe[:-1])
        left, right = symbols[at], symbols[at + 1]
        slots = _slots(left, right)
        near = np.flatnonzero(np.bincount(slots, minlength=SLOTS)[slots] >= LEAST_COUNT)  # no frequent pair is elsewhere
        at, slots = at[near], slots[near]
        pairs = (left[near].astype(np.int64) << 32) | right[near]
        ordered = np.sort(pairs)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(near) else near
        counts, keys = np.diff(np.append(edge, len(ordered))), ordered[edge]
        often = np.flatnonzero(counts >= LEAST_COUNT)
        if not len(often):
            break
        if len(often) > PAIRS_A_ROUND:
            often = often[np.argsort(-counts[often], kind="stable")[:PAIRS_A_ROUND]]
        chosen = np.sort(keys[often])
        slot, kept = np.unique(_slots((chosen >> 32).astype(np.uint32), chosen.astype(np.uint32)), return_index=True)
        order = np.argsort(kept)  # of pairs in one slot of the table, one has its turn in this round
        slot, chosen = slot[order], chosen[np.sort(kept)]
        table[slot], rank[slot] = chosen, np.arange(len(chosen))
        found = np.flatnonzero(table[slots] == pairs)
        table[slot] = -1
        hit, numbers = at[found], rank[slots[found]]
        run = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
        begun = np.repeat(hit[run], np.diff(np.append(run, len(hit))))
        own = np.flatnonzero((hit - begun) % 2 == 0)
        hit, numbers = hit[own], numbers[own]
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1))
        symbols[hit] = np.uint32(fresh) + numbers
        fresh += len(chosen)
        last[hit] = last[hit + 1]
        maybe[:] = False
        maybe[at] = True
        stay = np.ones(len(symbols), dtype=bool)
        stay[hit + 1] = False
        kept = np.flatnonzero(stay)  # numpy takes by numbers faster than by truths
        symbols, last, maybe = symbols.take(kept), last.take(kept), maybe.take(kept)
        made = hit - np.arange(len(hit))
        maybe[made] = True
        maybe[np.maximum(made - 1, 0)] = True
    finish = np.flatnonzero(last) + 1
    offsets = np.zeros(len(ends) + 1, dtype=np.int64)
    offsets[1:] = np.maximum.accumulate(np.concatenate([[0], finish]))[np.cumsum(~empty)]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)), symbols, offsets


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A slot below SLOTS for each pair; pairs may share one."""
    mixed = left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)
    return (mixed >> np.uint32(32 - SLOTS.bit_length() + 1)).astype(np.int64)


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for. A pass settles the rules whose parts are settled."""
    out = np.zeros(len(rules), dtype=np.int64)
    known = np.ones(first + len(rules), dtype=np.int64)
    while True:
        known[first:] = out
        parts = known[rules]
        new = np.where((parts > 0).all(axis=1), parts.sum(axis=1), 0)
        if np.array_equal(new, out):
            return out
        out = new


class Shard:
    """A row of the files, for reading."""

    def __init__(self, row: dict):
        kind = {2: "<u2", 4: "<u4"}[row["wide"]]
        self.first = row["first"]
        self.rules = np.frombuffer(row["rules"], dtype=kind).reshape(-1, 2).astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], dtype="<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], dtype=kind).astype(np.int64)
        self.offsets = np.frombuffer(row["offsets"], dtype="<u4").astype(np.int64)
        self.doc_ids = row["doc_ids"]
        self._at = np.concatenate([[0], np.cumsum(self.lengths)])
        self._spelled: np.ndarray | None = None

    def _rules_spelled(self) -> np.ndarray:
        """The ids of all nonterminals, one after the other. A rule has only earlier ones in it."""
        if self._spelled is None:
            out = self.first + np.arange(len(self.rules))
            while len(rule := np.flatnonzero(out >= self.first)):
                sizes = np.ones(len(out), dtype=np.int64)
                sizes[rule] = 2
                to = np.cumsum(sizes)[rule]
                parts = self.rules[out[rule] - self.first]
                out = np.repeat(out, sizes)
                out[to - 2], out[to - 1] = parts[:, 0], parts[:, 1]
            self._spelled = out
        return self._spelled

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        rule = np.maximum(symbols - self.first, 0)
        return np.where(symbols < self.first, 1, self.lengths[rule]) if len(self.lengths) else np.ones(len(symbols), dtype=np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.lengths):
            return symbols
        spelled, sizes = self._rules_spelled(), self.sizes(symbols)
        source = np.concatenate([spelled, np.arange(self.first)])
        begin = np.where(symbols < self.first, len(spelled) + symbols, self._at[np.maximum(symbols - self.first, 0)])
        to = np.cumsum(sizes) - sizes
        return source[np.repeat(begin - to, sizes) + np.arange(int(sizes.sum()))]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.offsets[i] : self.offsets[i + 1]])

    def token(self, i: int, j: int) -> int:
        """The ``j``-th id of document ``i``, by the lengths alone: only one symbol is expanded."""
        own = self.symbols[self.offsets[i] : self.offsets[i + 1]]
        ends = np.cumsum(self.sizes(own))
        s = int(np.searchsorted(ends, j, side="right"))
        x, j = int(own[s]), j - int(ends[s] - self.sizes(own[s : s + 1])[0])
        while x >= self.first:
            a, b = self.rules[x - self.first].tolist()
            n = 1 if a < self.first else int(self.lengths[a - self.first])
            x, j = (a, j) if j < n else (b, j - n)
        return x


_encoders: dict[str, "Encoder"] = {}

#: Letters and marks of ASCII between which a byte-level pattern always cuts; an apostrophe may belong to what follows.
MARK = r"[!-&(-/:-@\[-`{-~]"
#: White space, and some more that the library doesn't hold for it: where two stand together, cuts are found one by one.
SPACE = "[\\t-\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: A space and Latin letters are one piece of the pattern, also between line breaks, which make no token with them.
WORD_PIECE = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
LONE_SPACE, LONE_BREAK = re.compile(r" (?=\S)"), re.compile(r"(?<=\S)\n(?=\S)")


class Encoder:
    """Whole texts to ids by the tokenizers library; a worker loads a vocabulary once.

    Where the vocabulary is byte-level BPE with the usual pattern, texts are cut at places where that pattern
    cuts in any case: before a space that a non-space follows, around a single line break, and between a letter
    and a mark of ASCII. The library encodes each different piece of many texts once, and its ids are remembered
    for up to REMEMBERED pieces, which are found by two 64-bit hashes with weights drawn by the process. Texts with a zero character or an added token, and all texts of other
    vocabularies, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.cuts = (
            usual.items() <= (told["pre_tokenizer"] or {}).items()
            and told["model"]["type"] == "BPE"
            and not (told["model"].get("dropout") or any(told[k] for k in ("normalizer", "post_processor", "truncation", "padding")))
        )
        self.added = [t["content"] for t in told["added_tokens"]]
        alone = self.whole.encode("\n", add_special_tokens=False).ids
        self.line_break = alone[0] if self.cuts and len(alone) == 1 else None
        self._begin()

    @classmethod
    def get(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids."""
        if not self.cuts:
            return self._whole(texts.to_pylist())
        odd = pc.match_substring(texts, "\0")
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        plain = pc.if_else(odd, "", texts)
        out = np.split(*self._pieces(plain)) if len(texts) else []
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(at, self._whole(texts.take(pa.array(at, pa.int64())).to_pylist()), strict=True):
            out[i] = ids
        return out

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in encoded]

    def _cut(self, texts: pa.Array) -> pa.Array:
        """The texts' pieces, a list for each."""
        marked = pc.replace_substring_regex(texts, f"([A-Za-z])({MARK})", "\\1\0\\2")
        marked = pc.replace_substring_regex(marked, f"({MARK})([A-Za-z])", "\\1\0\\2")
        crowded = pc.match_substring_regex(texts, f"{SPACE}{{2}}")
        out = pc.replace_substring(pc.replace_substring(marked, "\n", "\0\n\0"), " ", "\0 ")
        if pc.any(crowded).as_py():
            few = [LONE_SPACE.sub("\0 ", LONE_BREAK.sub("\0\n\0", t)) for t in marked.filter(crowded).to_pylist()]
            out = pc.replace_with_mask(out, crowded, pa.array(few, out.type))
        return pc.split_pattern(out, "\0")

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where the second and later texts' begin)."""
        lists = self._cut(texts)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary
        hashes, checks, short = _piece_hashes(pieces)
        order = np.argsort(hashes)
        slot = np.searchsorted(self.hashes, hashes[order])
        had = np.flatnonzero((slot < len(self.hashes)) & short[order])
        had = had[self.hashes[slot[had]] == hashes[order[had]]]
        had = had[self.checks[self.numbers[slot[had]]] == checks[order[had]]]
        new = np.delete(np.arange(len(order)), had)
        known, number, unknown = order[had], self.numbers[slot[had]], order[new]
        sizes, starts = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        sizes[known], starts[known] = self.sizes[number], self.starts[number]
        self.again[number] = True
        ids, starts[unknown], sizes[unknown] = self._encoded(pieces.take(pa.array(unknown)).to_pylist())
        starts[unknown] += len(self.ids)
        flat = np.concatenate([self.ids, ids])
        at = coded.indices.to_numpy()
        own = sizes.take(at)
        to = np.concatenate([[0], np.cumsum(own)])
        all_ids = _gathered(flat, starts.take(at), own)
        new, unknown = new[short[unknown]], unknown[short[unknown]]
        self._remember(_gathered(flat, starts[unknown], sizes[unknown]), hashes[unknown], checks[unknown], sizes[unknown], slot[new])
        return all_ids, to[lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py()]

    def _begin(self) -> None:
        """Remembered pieces by number: where their ids begin in ``ids``, how many, and whether they came again; ``hashes`` ascend, with the pieces' ``numbers``."""
        self.hashes = self.checks = np.zeros(0, dtype=np.uint64)
        self.numbers = self.starts = self.sizes = np.zeros(0, dtype=np.int64)
        self.ids, self.again = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=bool)

    def _remember(self, ids: np.ndarray, hashes: np.ndarray, checks: np.ndarray, sizes: np.ndarray, slot: np.ndarray) -> None:
        """Pieces whose hashes ascend, and belong before ``slot``. When they are too many, those stay that came again, if these are few enough."""
        self.hashes, self.numbers = np.insert(self.hashes, slot, hashes), np.insert(self.numbers, slot, len(self.sizes) + np.arange(len(hashes)))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.checks, self.sizes, self.ids = (np.concatenate(x) for x in ((self.checks, checks), (self.sizes, sizes), (self.ids, ids)))
        self.again = np.concatenate([self.again, np.zeros(len(hashes), dtype=bool)])
        if len(self.hashes) > REMEMBERED:
            kept = np.flatnonzero(self.again[self.numbers])
            if len(kept) > REMEMBERED // 2:
                kept = kept[:0]
            old = self.numbers[kept]
            stay = _gathered(self.ids, self.starts[old], self.sizes[old]), self.hashes[kept], self.checks[old], self.sizes[old]
            self._begin()
            self._remember(*stay, np.zeros(len(kept), dtype=np.int64))

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's begin, how many). Words that begin with a space stand in lines of TOGETHER, as the library is faster then."""
        starts, sizes = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        is_word = np.fromiter((self.line_break is not None and WORD_PIECE(p) is not None for p in pieces), dtype=bool, count=len(pieces))
        at_words, at_others = np.flatnonzero(is_word), np.flatnonzero(~is_word)
        ids = np.zeros(0, dtype=np.uint32)
        if len(at_words):
            words = [pieces[i] for i in at_words.tolist()]
            lines = ["\n".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
            encoded = self.whole.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.concatenate([np.array([*e.ids, self.line_break], dtype=np.uint32) for e in encoded])
            ends = np.flatnonzero(ids == self.line_break)
            sizes[at_words] = np.diff(ends, prepend=-1) - 1
            starts[at_words] = ends - sizes[at_words]
        found = self._whole([pieces[i] for i in at_others.tolist()])
        sizes[at_others] = [len(x) for x in found]
        starts[at_others] = len(ids) + np.cumsum(sizes[at_others]) - sizes[at_others]
        return np.concatenate([ids, *found]), starts, sizes


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that begin at ``starts``, one after the other."""
    to = np.cumsum(sizes)
    return flat.take(np.repeat(starts - (to - sizes), sizes) + np.arange(to[-1] if len(to) else 0))


#: Bytes of the longest piece that is remembered.
LONG = 256
_WEIGHTS = np.frombuffer(os.urandom(2 * 8 * LONG), dtype=np.uint64).reshape(2, LONG) | np.uint64(1)


def _piece_hashes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text, sums of its bytes by random weights of their places, and which are no longer than LONG bytes."""
    _, offsets, data = pieces.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, dtype=np.int64)
    sizes = np.diff(offsets)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1) if data is not None else np.zeros(0, dtype=np.uint64)
    ends = offsets - offsets[0]
    place = np.minimum(np.arange(len(raw)) - np.repeat(ends[:-1], sizes), LONG - 1)
    both = []
    for weights in _WEIGHTS:
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(raw * weights.take(place), dtype=np.uint64)])
        both.append(sums[ends[1:]] - sums[ends[:-1]])
    return both[0], both[1], sizes <= LONG


def _groups(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """(doc_ids, texts) of some batches together, or of a part of one: GROUP_BYTES of texts at most, or one text."""
    own: list = []
    held: list[pa.Array] = []
    size = 0
    for batch in parts:
        ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        begin = 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            if size and size + n > GROUP_BYTES:
                yield own + ids[begin:i], pa.concat_arrays([*held, texts.slice(begin, i - begin)])
                own, held, size, begin = [], [], 0, i
            size += n
        own, held = own + ids[begin:], [*held, texts.slice(begin)]
    if own:
        yield own, pa.concat_arrays(held)


def _shards(path: str, end_id: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.get(path), TaskContext.get().partitionId()
        first = encoder.whole.get_vocab_size(with_added_tokens=True)
        shard = before = size = 0
        docs: list[np.ndarray] = []
        ids: list[int | None] = []

        def written() -> pa.RecordBatch:
            nonlocal shard, before, size, docs, ids
            flat = np.concatenate(docs)
            rules, symbols, offsets = repair(flat, np.cumsum([len(d) for d in docs])[1::2], first)
            wide = 2 if first + len(rules) <= 1 << 16 else 4
            kind = f"<u{wide}"
            blobs = [rules.astype(kind), rule_lengths(rules, first).astype("<u4"), symbols.astype(kind), offsets.astype("<u4")]
            cols = [pa.array([x], t) for x, t in ((part, pa.int32()), (shard, pa.int32()), (before, pa.int64()), (size, pa.int64()), (first, pa.int32()), (wide, pa.int32()))]
            cols += [pa.array([b.tobytes()], pa.binary()) for b in blobs] + [pa.array([ids], pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SHARD.split(", ")])
            shard, before, size, docs, ids = shard + 1, before + size, 0, [], []
            return out

        end = np.array([end_id], dtype=np.uint32)
        for own, texts in _groups(parts):
            for doc_id, tokens in zip(own, encoder.encode(texts), strict=True):
                docs.append(tokens)
                docs.append(end)
                ids.append(doc_id)
                size += len(tokens) + 1
                if size >= SHARD_IDS:
                    yield written()
        if docs:
            yield written()

    return run


def write_shards(docs: DataFrame, to: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode ``docs`` to files under ``to``, in ascending order of the id."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_size", "_digest"]
    rows = pick(docs, doc_id=id_col, text=text_col).withColumns({"_size": F.length("text"), "_digest": F.xxhash64("text")})
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.col("doc_id").cast("long"), "text")
    map_arrow(dealt, _shards(tokenizer_path, end_id), SHARD).write.option("compression", "zstd").parquet(to)


READ = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for row in batch.to_pylist():
            shard = Shard(row)
            sizes = np.concatenate([[0], np.cumsum(shard.sizes(shard.symbols))])[shard.offsets]
            flat = shard.expand(shard.symbols).astype("<u4")
            n = len(shard.doc_ids)
            crcs = [zlib.crc32(flat[sizes[i] : sizes[i + 1]]) for i in range(n)]
            cols = [pa.array([row["part"]] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(row["before"] + sizes[:-1])]
            cols += [pa.array(np.diff(sizes)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in READ.split(", ")])


def read_digest(spark: SparkSession, at: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Starts need only one sum per partition."""
    files = spark.read.parquet(at)
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = running_before(per_part, "part", "n", "_before").select(F.col("part").alias("_part"), "_before")
    told = map_arrow(files, _read, READ)
    placed = told.join(F.broadcast(before), F.col("part") == F.col("_part"))  # a row per partition
    return placed.select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    spark = docs.sparkSession
    to = fresh_path(spark, "tokens")
    write_shards(docs, to, tokenizer_path, **options)
    return read_digest(spark, to)
