"""Mix sources to target weights.

The words of each source are laid end to end and cut into blocks of ``block`` words (the last may
be shorter). A source gets as many slots as blocks make up its target, the last one cut to the words
still due; each of its slots is thrown into an output shard by a hash, so the counts of a source over the
shards are a multinomial draw and its total stays at the target. Slots are walked in rounds over the
blocks, each round in an order of its own: a swap-or-not permutation of the block numbers. Slots
and blocks are then joined by block number. All columns are native expressions; equal input gives equal output.

Order within a source: chunks by hash of the id, ids inside a chunk, so that the running word
offsets of a source with any share of the rows are computed chunk by chunk. The list of sources
itself is taken as short (it is what the weights are set for): one task ranks it.

Defined results: null text has no words; null is a source, the last one; a source without words has
target 0; documents without words are never taken; repeated rows are rows of their own; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.llm.common import SPACE, WORD_GAP, fresh, n_words, same
from sightline.llm.registry import query
from sightline.session import store

ROUNDS = 16
CHUNK_ROWS = 8_192
PIECE = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size) with ``sid`` (rank), ``target`` words: shares by weight, capped.

    With sources ordered by cap/weight and the first i of them capped, the others would get
    level_i x weight; the level that holds is the largest of these.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn(
        "sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1))
    ).withColumn("most", F.col("source_size") * cap)
    before = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    open_ = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        ranked.withColumn("level", left / open_)
        .withColumn("level", F.max("level").over(everything))
        .select(
            "source", "sid", "source_size",
            F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"),
        )
    )


def permuted(at: Column, size: Column, *keys: Column, back: bool = False) -> Column:
    """``at`` in [0, size) sent through a pseudorandom permutation chosen by ``keys``.

    Swap-or-not: each round pairs x with K - x (mod size) and swaps the pair or not by one hash bit.
    Every round undoes itself, so the rounds in reverse order lead ``back``.
    """

    def swapped(x: Column, n: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(n, *keys), size) - x, size)
        bit = F.xxhash64(F.lit(-1) - n, F.greatest(x, other), *keys).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    rounds = (ROUNDS, 1) if back else (1, ROUNDS)
    return F.aggregate(F.sequence(*map(F.lit, rounds)), at, swapped)


def laid_out(words: DataFrame) -> DataFrame:
    """(id, source, size) with ``sid``, ``source_size``, ``target`` and ``start``, the row's word
    offset within its source."""
    chunks = words.count() // CHUNK_ROWS + 1
    words = words.withColumn("chunk", F.pmod(F.xxhash64("mark"), F.lit(chunks)))
    sources = targets(words.groupBy("source").agg(F.sum("size").alias("source_size")))
    in_source = Window.partitionBy("source").orderBy("chunk")
    chunk_starts = (
        words.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
        .withColumn("chunk_start", F.sum("chunk_size").over(in_source) - F.col("chunk_size"))
        .join(sources.withColumnRenamed("source", "s"), same(F.col("source"), F.col("s")))
        .select(
            F.col("source").alias("s"), F.col("chunk").alias("c"), "chunk_start", "sid",
            "source_size", "target",
        )
    )
    in_chunk = Window.partitionBy("source", "chunk").orderBy("id", "size", "mark").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        words.withColumn("ahead", F.sum("size").over(in_chunk) - F.col("size"))
        .join(
            chunk_starts, same(F.col("source"), F.col("s")) & (F.col("chunk") == F.col("c"))
        )
        .withColumn("start", F.col("chunk_start") + F.col("ahead"))
        .drop("s", "c", "chunk", "ahead", "chunk_start")
    )


def slots_of(sources: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """One row per slot: (sid, block_no, round, slot, shard, due), ``due`` being the words it takes."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size, blocks = F.col("source_size"), F.ceil(F.col("source_size") / block)
    per = sources.filter("source_size > 0").select(
        "sid", blocks.alias("blocks"), (size - (blocks - 1) * block).alias("short"),
        F.floor(F.round("target") / size).alias("full"),
    ).join(sources.select("sid", F.round("target").cast("long").alias("words"), "source_size"), "sid").select(
        "*", (F.col("words") - F.col("full") * F.col("source_size")).alias("rest"),
        # where the round that is not walked to its end comes to the shorter last block
        permuted(
            F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("sid"), F.col("full"), back=True
        ).alias("turn"),
    )
    lack = F.lit(block) - F.col("short")
    plain = F.ceil(F.col("rest") / block)
    walked = F.when(plain <= F.col("turn"), plain).otherwise(F.ceil((F.col("rest") + lack) / block))
    per = per.withColumn("slots", F.col("full") * F.col("blocks") + walked).filter("slots > 0")
    pieces = per.select(
        "*", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / PIECE))).alias("piece")
    ).repartition(parts, "sid", "piece")
    last = F.least(F.col("slots") - 1, F.col("piece") * PIECE + PIECE - 1)
    at = F.col("slot") - F.col("full") * F.col("blocks")
    before = at * block - F.when(at > F.col("turn"), lack).otherwise(F.lit(0))
    due = F.when(at >= 0, F.least(F.lit(block), F.col("rest") - before)).otherwise(F.lit(block))
    slots = pieces.select(
        "*", F.explode(F.sequence(F.col("piece") * PIECE, last)).alias("slot")
    ).withColumn("round", F.floor(F.col("slot") / F.col("blocks")))
    return slots.select(
        "sid", "slot", "round", due.alias("due"),
        F.pmod(F.xxhash64(F.lit(seed), "sid", "slot"), F.lit(shards)).cast("int").alias("shard"),
        permuted(
            F.pmod("slot", "blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), F.col("round")
        ).alias("block_no"),
    )


def row_mark(key: Column, source: Column, text: Column) -> Column:
    """128 bits that name a row by its id, source and text; rows that agree in these are alike."""
    parts = [F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0")) for c in (key, source)]
    whole = F.concat_ws("\n", F.sha2(F.coalesce(text, F.lit("")), 256), *parts)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def mix(
    docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source",
    block: int = 64, shards: int = 16, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """The rows laid out (see :func:`laid_out`), and the mix: one row per slot and row it takes
    words from, (shard, slot, round, sid, start, first, last) with word numbers [first, last) of the
    row that ``sid`` and ``start`` name (of those with words).

    ``mark`` in the rows names them by id, source and text (:func:`row_mark`).
    """
    words = store(
        docs.select(
            F.col(key).alias("id"), F.col(source).alias("source"),
            row_mark(F.col(key), F.col(source), F.col(text)).alias("mark"), n_words(F.col(text)).alias("size"),
        ),
        "mix-words",
    )
    rows = store(laid_out(words), "mix-rows")
    sources = rows.groupBy("sid").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    end = F.col("start") + F.col("size")
    from_word = F.greatest(F.lit(0), F.col("block_no") * block - F.col("start"))
    to_word = F.least(F.col("size"), (F.col("block_no") + 1) * block - F.col("start"))
    parts = rows.filter(F.col("size") > 0).select(
        "sid", "start", "size",
        F.explode(
            F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
        ).alias("block_no"),
    ).withColumns({"first": from_word, "last": to_word})
    # never broadcast: a few rows per source become a slot per block
    slots = slots_of(sources, block, shards, seed).hint("merge")
    in_block = F.col("start") + F.col("first") - F.col("block_no") * block
    taken = parts.join(slots, ["sid", "block_no"]).withColumn(
        "last", F.least(F.col("last"), F.col("first") + F.col("due") - in_block)
    ).filter(F.col("last") > F.col("first"))
    return rows, taken.drop("block_no", "due", "size")


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` as the mix takes them: one row per document and round in which words of it are
    taken. A round that takes all words keeps the text as it is; otherwise the text becomes the
    taken words, in order, joined by one space. Columns are those of ``docs``.
    """
    m, spans, r, w = fresh(docs, "_m", "_spans", "_round", "_words")
    source = options.get("source", "source")
    rows, taken = mix(docs, text, key, **options)
    per_round = taken.groupBy("sid", "start", "round").agg(
        F.sum(F.col("last") - F.col("first")).alias("n"),
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias(spans),
    )
    # rows of one mark are interchangeable: number them on both sides
    twin = F.row_number().over(Window.partitionBy("mark").orderBy("start"))
    named = rows.filter(F.col("size") > 0).select(
        "sid", "start", "size", F.col("mark").alias(f"{m}_r"), twin.alias(f"{r}_r")
    )
    taken_of = per_round.join(named, ["sid", "start"]).select(
        f"{m}_r", f"{r}_r", spans, (F.col("n") == F.col("size")).alias(f"{spans}_all")
    )
    others = [c for c, kind in docs.dtypes if c != text and "map<" not in kind and kind != "variant"]
    own = docs.withColumn(m, row_mark(F.col(key), F.col(source), F.col(text)))
    own = own.withColumn(r, F.row_number().over(Window.partitionBy(m).orderBy(F.xxhash64(*others))))
    # the numbers are compared, not equated: then the rows stay where the numbering put them
    joined = own.join(
        taken_of, (F.col(m) == F.col(f"{m}_r")) & (F.abs(F.col(r) - F.col(f"{r}_r")) < 1)
    )
    # a column of its own: inside a lambda the split would run once per span
    whole = F.col(f"{spans}_all")
    joined = joined.withColumn(
        w, F.when(~whole, F.split(F.btrim(F.col(text), F.lit(SPACE)), WORD_GAP))
    )
    cut = F.array_join(
        F.flatten(
            F.transform(
                F.col(spans),
                lambda s: F.slice(
                    F.col(w), (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")
                ),
            )
        ),
        " ",
    )
    new = F.when(F.col(w).isNull(), F.col(text)).otherwise(cut)
    return joined.select(*[new.alias(text) if c == text else F.col(c) for c in docs.columns])


def per_document(rows: DataFrame, taken: DataFrame, shards: int = 16) -> DataFrame:
    """``rows`` with ``taken``: the words the mix takes of each, repeats counted, and
    ``shard_words``: the same by output shard."""
    n = F.col("last") - F.col("first")
    by_shard = F.array(*[F.sum(F.when(F.col("shard") == k, n).otherwise(F.lit(0))) for k in range(shards)])
    sums = taken.groupBy("sid", "start").agg(F.sum(n).alias("taken"), by_shard.alias("shard_words"))
    hit = (F.col("size") > 0) & (F.col("taken").isNotNull())
    nothing = F.array_repeat(F.lit(0).cast("long"), shards)
    return rows.join(sums, ["sid", "start"], "left").withColumns({
        "taken": F.when(hit, F.col("taken")).otherwise(F.lit(0)),
        "shard_words": F.when(hit, F.col("shard_words")).otherwise(nothing),
    })


@query("op7_mixing", "documents")
def op7(documents: DataFrame) -> DataFrame:
    rows, taken = mix(documents)
    return per_document(rows, taken).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shard_words"
    )
