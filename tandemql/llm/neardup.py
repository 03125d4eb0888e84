"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set is that of its distinct word shingles. SuperMinHash gives each element a random
permutation of the signature's slots: at step j the element puts the value j + u at its j-th slot. A slot
keeps the least value. Because an element's values are correlated over slots, estimates vary less than with
independent hashes, and a text with many shingles needs few steps: once all slots are filled at step j,
later steps can't lower any (early stopping).

Documents of equal sets are one class, with their least id for a name; only classes go on. The signature's
bands deal classes to buckets. Pairs to verify are, in each bucket, every member with its leader, the least
one (a star); then, where a bucket's members are not yet one component, the pairs across components that
exact bounds on the overlap allow, dealt by blocks of the bucket so that no task gets a large bucket whole.
Each pair is confirmed on the full sets. No pair that shares a bucket is left out but those already known
to be of one component and those that the bounds prove dissimilar.

With 32 bands of 5, a pair of similarity 0.8 shares no bucket with a probability of 3 in a million.

Defined cases: null, empty and blank texts have no shingles, and are linked with nothing; a null id is
linked with nothing, its component is null, and the row is kept; rows of one id are one document, all kept
if one is; equal texts are of one class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemql.llm.common import join_hot, map_arrow, materialise, pick
from tandemql.llm.components import components
from tandemql.llm.shingles import batches, mix, shingle_sets

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Members of a bucket that meet each other in one block of pairs.
BLOCK = 128

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
#: Elements whose permutations are held at a time.
_HELD = 1 << 15


def _step(elements: np.ndarray, j: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """For step ``j``: each element's value (j + u, scaled by 2**48), and the place from j on that it swaps with."""
    r = mix(elements ^ mix(np.array([j + 1], dtype=np.uint64)))
    return (_U(j) << _U(48)) | (r >> _U(16)), j + ((r & _U(0xFFFF)) % _U(slots - j)).astype(np.int64)


def super_min_hash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures, a row per set; a row of an empty set is all _EMPTY."""
    out = np.full((len(sets), slots), _EMPTY, dtype=np.uint64)
    if not sets:
        return out
    sizes = np.array([len(s) for s in sets])
    flat = out.reshape(-1)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    value, place = _step(elements, 0, slots)
    np.minimum.at(flat, owner * slots + place, value)
    open_sets = np.flatnonzero((out == _EMPTY).any(axis=1) & (sizes > 0))
    run: list[int] = []
    held = 0
    for i in [*open_sets.tolist(), -1]:
        if run and (i < 0 or held + sizes[i] > _HELD):
            _later_steps(out, [sets[x] for x in run], np.array(run), slots)
            run, held = [], 0
        if i >= 0:
            run.append(i)
            held += sizes[i]
    return out


def _later_steps(out: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, slots: int) -> None:
    """Steps from 1 on for sets that step 0 has left with open slots, until each set's slots are filled."""
    elements = np.concatenate(sets)
    owner = np.repeat(rows, [len(s) for s in sets])
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
    at = np.arange(len(elements))
    flat = out.reshape(-1)
    for j in range(slots):
        value, place = _step(elements, j, slots)
        here, there = order[at, j], order[at, place]
        order[at, place] = here
        order[at, j] = there
        if j == 0:
            continue
        np.minimum.at(flat, owner * slots + there, value)
        live = (out[rows] == _EMPTY).any(axis=1)
        if not live.any():
            return
        if live.mean() < 0.7:
            rows = rows[live]
            stay = np.isin(owner, rows)
            elements, owner, order = elements[stay], owner[stay], order[stay]
            at = np.arange(len(elements))


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A long per signature and band, that tells bands apart too."""
    cut = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15), cut.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _U(0xD1B54A32D192ED03) + cut[:, :, r])
    return key.view(np.int64)


SIGNED = "doc_id long, n long, f1 long, f2 long, bands array<long>"


def _sign(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0), part.column(1).to_pylist()
            done = 0
            for raw in batches(texts):
                sets = shingle_sets(raw, k)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                f1 = np.array([np.add.reduce(mix(s)) for s in sets], dtype=np.uint64).view(np.int64)
                f2 = np.array([np.bitwise_xor.reduce(mix(s * _U(0xD1B54A32D192ED03))) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
                bands = band_keys(super_min_hash(sets))
                offsets = pa.array(np.arange(0, len(sets) + 1, dtype=np.int32) * BANDS)
                keys = pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1)))
                own = ids.slice(done, len(sets)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([own, pa.array(n), pa.array(f1), pa.array(f2), keys], names=["doc_id", "n", "f1", "f2", "bands"])
                done += len(sets)

    return run


def _sets(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = 0
            for raw in batches(part.column(1).to_pylist()):
                sets = [s.tobytes() for s in shingle_sets(raw, k)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(done, len(sets)).cast(pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "elements"])
                done += len(sets)

    return run


def _overlap(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        both, na, nb = [], [], []
        for x, y in zip(part.column(2), part.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            both.append(np.intersect1d(x, y, assume_unique=True).size)
            na.append(len(x))
            nb.append(len(y))
        cols = [part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in (both, na, nb))]
        yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "both", "na", "nb"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids with the sizes of their sets and of what these share, written to the shared folder."""
    one = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb"))
    two = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea"))
    hot = materialise(pairs, "pairs")
    hubs = join_hot(hot, two, "a").select("a", "b", "ea")
    joined = hubs.join(one, "b").select("a", "b", "ea", "eb")
    return materialise(map_arrow(joined, _overlap, "a long, b long, both long, na long, nb long"), "overlaps")


def _similar(percent: int, both: Column, na: Column, nb: Column) -> Column:
    return (both > 0) & (100 * both >= percent * (na + nb - both))


def _explode_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for doc_id, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            own = np.frombuffer(raw.as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), doc_id)), pa.array(own)], names=["id", "element"])


def _unshared(sets: DataFrame) -> DataFrame:
    """(id, unshared): how many of a document's shingles no other one in ``sets`` has."""
    spread = map_arrow(sets, _explode_sets, "id long, element long")
    once = spread.groupBy("element").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    return once.groupBy("id").agg(F.count(F.lit(1)).alias("unshared"))


def _across(members: DataFrame, labels: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a bucket, are not of one component yet, and can still be similar.

    Each bucket's rows know the set size n, the overlap o with the bucket's leader, and the shingles u that no
    other candidate has. Two sets share at most min(oa, ob) of the leader's shingles and
    min(na - oa - ua, nb - ob - ub) others; pairs for which that is too little are never made. One side is
    the bucket's rows outside its largest component; the other, all rows, is dealt by blocks.
    """
    named = members.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = materialise(named, "members")
    per = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("key").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("largest"), F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("c"))
    mixed = materialise(per.where("kinds > 1").select("key", "largest", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "mixed")
    rows = named.join(mixed, "key")
    alone = _unshared(sets.join(rows.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    led = stars.select(F.col("a").alias("leader"), F.col("b").alias("id"), F.col("both").alias("o"))
    rows = rows.join(led, ["leader", "id"], "left").join(alone, "id", "left")
    shared = named.join(mixed.select("key"), "key").groupBy("id").agg(F.collect_list("key").alias("keys"))  # one a band at most
    rows = rows.join(shared, "id")
    leads = F.col("id") == F.col("leader")
    rows = materialise(
        rows.select(
            "key", "id", "n", "component", "largest", "blocks", "keys",
            F.when(leads, F.col("n")).otherwise(F.col("o")).alias("o"),
            F.when(leads, F.lit(0).cast("long")).otherwise(F.coalesce("unshared", F.lit(0).cast("long"))).alias("u"),
        ),
        "rows",
    )
    out = rows.where("component <> largest").select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("o").alias("oa"), F.col("u").alias("ua"), F.col("component").alias("ca"), F.col("keys").alias("ka"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    every = rows.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("o").alias("ob"), F.col("u").alias("ub"), F.col("component").alias("cb"), F.col("keys").alias("kb"), (F.col("component") == F.col("largest")).alias("main"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    most = F.least("oa", "ob") + F.least(F.expr("na - oa - ua"), F.expr("nb - ob - ub"))
    able = (F.col("ca") != F.col("cb")) & (F.col("main") | (F.col("a") < F.col("b"))) & _similar(percent, most, F.col("na"), F.col("nb"))
    first = out["key"] == F.array_min(F.array_intersect("ka", "kb"))  # of the buckets that both are in, one makes the pair
    pairs = out.join(every, on=(out["key"] == every["key"]) & (out["block"] == every["block"]) & able & first)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept, and class_id (the least id of equal sets).

    Two documents are linked if 100 * common shingles >= ``percent`` * shingles of either;
    ``component_id`` is the least id that links reach, itself included.
    """
    texts = pick(docs, doc_id=id_col, text=text_col)
    signed = materialise(map_arrow(texts, _sign(k), SIGNED), "signatures")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"))
    classes = materialise(classes, "classes")
    dealt = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = materialise(dealt.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "buckets")
    members = materialise(dealt.join(shared, "key").select("key", "id", "n", "leader"), "dealt")
    asked = members.select(F.col("id").alias("doc_id")).distinct()
    sets = materialise(map_arrow(texts.join(asked, "doc_id", "left_semi"), _sets(k), "doc_id long, elements binary"), "sets")
    star = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    stars = overlaps(star, sets)
    similar = _similar(percent, F.col("both"), F.col("na"), F.col("nb"))
    links = stars.where(similar).select("a", "b")
    labels = components(links)
    cross = _across(members, labels, stars, sets, percent).join(stars.select("a", "b"), ["a", "b"], "left_anti")
    more = overlaps(cross, sets).where(similar).select("a", "b")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = classes.join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("f1", "f2", "n", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component"))
    out = signed.drop("bands").join(named, ["f1", "f2", "n"], "left")
    usable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    component = F.when(usable, F.col("component")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component).withColumn("class_id", F.when(usable, F.col("class_id")).otherwise(F.col("doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "class_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents of each group that aren't kept."""
    told = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = told.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    key = docs[id_col] if docs.columns.count(id_col) == 1 else F.col(id_col)
    return docs.join(gone, key == gone["_gone"], "left_anti")
