"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame operations: no Python code runs on the executors.

A source's target is its weight's share of the words wanted, but no more than ``max_epochs`` times
its own words. What a clamped source can't take is dealt to the others by weight, until none is above
its clamp. A source of rate ``r = target / size`` is repeated ``floor(r)`` times as a whole; of the rest,
documents in an order seeded by ``seed`` are repeated once more until the fraction is met. The last of
them is repeated in part (its first words), so that a source meets its target to a word or so for each
bucket of BUCKET_ROWS documents, however long single documents are. ``mix(whole_texts=True)`` takes that last
document whole or not at all, whichever is nearer, unless its bucket then misses its target by more than MISS.

Defined cases: a null text, or one of white space only, has size 0 and is taken 0 times; the null source
is a source of its own, ranked last; a source without words has target 0; weights that are null or
negative count as 0; repeated rows are documents of their own; an empty table gives an empty mix. If all
sources reach their clamp, the mix is smaller than wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemql.llm import common

#: Documents of a source that are ordered together; a hot source has many such buckets.
BUCKET_ROWS = 2000
MAX_EPOCHS = 3.0
#: Share of a bucket's target that it may miss or exceed so that its last text stays whole.
MISS = 0.01
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def seeded_order(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of a digest, the same in every run and on every engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"), text))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def cycled_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """``sources`` with ``weight``: the given weights in turn, over sources by code point, null last."""
    ranked = common.global_rank(sources, [F.col("source").asc_nulls_last()], "_rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    return ranked.withColumn("weight", turn).drop("_rank")


def water_fill(sources: DataFrame, total: float | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, docs, weight) with ``target``.

    Each round is one small aggregate over the table of sources; only its two sums reach the driver.
    A round clamps every source whose share is above its clamp; shares only grow, so it ends.
    ``total`` is the number of words wanted: all of them, if None.
    """
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    table = common.materialise(sources.withColumn("weight", weight).withColumn("_cap", cap), "sources")
    size, whole = table.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = float(size or 0) if total is None else float(total)
    rest, left = wanted, float(whole or 0)

    def clamped(rest: float, left: float) -> Column:
        return F.col("_cap") * F.lit(left) <= F.col("weight") * F.lit(rest)

    while left > 0:
        above = clamped(rest, left)
        caps, free = table.agg(F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        now = wanted - float(caps or 0), float(free or 0)
        if now == (rest, left):
            break
        rest, left = now
    share = F.lit(rest) * F.col("weight") / F.lit(left) if left > 0 else F.col("_cap")
    target = F.when(F.col("weight") == 0, F.lit(0.0)).when(clamped(rest, left), F.col("_cap")).otherwise(share)
    return table.withColumn("target", target).drop("_cap")


def plan_mix(
    docs: DataFrame,
    weights: list[float] | DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    total: float | None = None,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
    keep_rows: bool = False,
) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, whole, extra, taken.

    ``weights``: a list dealt in turn over the sources by code point, or a table (source, weight);
    sources that it lacks weigh 0. ``keep_rows`` carries each whole row along as ``row``, with ``bucket_target``.
    ``whole`` is the number of full repetitions, ``extra`` the words of one more, partial or full.
    """
    wanted = {"doc_id": id_col, "text": text_col, "source": source_col}
    picked = common.with_row(docs, **wanted) if keep_rows else common.pick(docs, **wanted)
    sized = picked.withColumns({"size": word_count(F.col("text")), "_order": seeded_order(F.col("doc_id"), F.col("text"), seed)}).drop("text")
    if not keep_rows:
        sized = common.materialise(sized, "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    if isinstance(weights, DataFrame):
        given = common.pick(weights, _source="source", weight="weight").groupBy("_source").agg(F.max("weight").alias("weight"))
        sources = sums.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    else:
        sources = cycled_weights(sums, weights)
    targets = water_fill(sources, total, max_epochs).drop("weight")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    buckets = F.ceil(F.col("docs") / F.lit(BUCKET_ROWS))
    rows = common.join_groups(sized, targets, "source", F.col("_order")).withColumns(
        {"whole": F.floor(rate).cast("long"), "_fraction": rate - F.floor(rate), "_bucket": F.pmod(F.col("_order"), buckets)}
    )
    bucket = Window.partitionBy("source", "_bucket")
    so_far = F.sum("size").over(bucket.orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    quota = F.round(F.col("_fraction") * F.sum("size").over(bucket)).cast("long")
    rows = rows.withColumn("_left", quota - (so_far - F.col("size")))
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_left")))
    out = rows.withColumn("extra", extra).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
    cols = ["doc_id", "source", "size", "source_size", "target", "whole", "extra", "taken"]
    share = (F.col("target") / buckets).alias("bucket_target")
    return out.select(*cols, *([share, "row"] if keep_rows else []))


def mix(docs: DataFrame, weights: list[float] | DataFrame, *, text_col: str = "text", chars_col: str | None = None, whole_texts: bool = False, **options) -> DataFrame:
    """The mixed table itself, with the columns of ``docs``: each document as often as the plan says.

    A partial repetition has the document's first words, with the white space between them as it was;
    ``chars_col``, if given, is set to its length. ``whole_texts`` makes it whole or leaves it out, within MISS.
    """
    plan = plan_mix(docs, weights, text_col=text_col, keep_rows=True, **options)
    if whole_texts:
        nearer = F.when(2 * F.col("extra") >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
        near = F.abs(nearer - F.col("extra")) <= F.lit(MISS) * F.col("bucket_target")
        plan = plan.withColumn("extra", F.when(near, nearer).otherwise(F.col("extra"))).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
    at = docs.columns.index(text_col)
    part = F.when(F.col("extra") > 0, F.array("extra")).otherwise(F.array().cast("array<long>"))
    copies = F.concat(F.array_repeat(F.col("size"), F.col("whole").cast("int")), part)
    dealt = plan.where(F.col("taken") > 0).withColumn("_words", F.explode(copies))
    pieces = F.split(F.col(f"row._c{at}"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.col("_words") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(pieces, 1, F.col("_words").cast("int")), "")).otherwise(F.col(f"row._c{at}"))
    replaced = {text_col: text}
    if chars_col:
        i = docs.columns.index(chars_col)
        replaced[chars_col] = F.when(cut, F.length(text).cast(docs.schema[chars_col].dataType)).otherwise(F.col(f"row._c{i}"))
    return common.unpack_row(dealt, docs.columns, **replaced)
