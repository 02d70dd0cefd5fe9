"""Mixing sources to target weights: fixed-length word blocks, multinomial source counts per output shard, per-source
pseudorandom index permutations, and a join of slots with blocks by index. DataFrame functions only."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.llm.common import cut, running_start, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, SHARD_SLOTS, MOST, ROUNDS = 128, 1024, 3, 16


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Targets by water filling. `sizes`: one row per source (source, source_size). Adds weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Those whose cap of `most` times their size lies under
    the water level are capped, the rest share what is left by weight. In order of cap / weight the capped ones come
    first; the level left by capping the first k rises with k while too few are capped and falls from then on, so the
    water level is the largest of them. The windows run over the table of sources, one small row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    w = w.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("after", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("level", (F.col("total") - F.col("before")) / F.col("after"))
    w = w.withColumn("water", F.max("level").over(all_rows))
    return w.select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.col("water")).alias("target"))


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """Pseudorandom permutation of 0..n-1: the swap-or-not shuffle (Hoang, Morris and Rogaway 2012). Each round pairs
    x with (k - x) mod n and swaps the pair if a hash bit of its larger member says so; right for any n, without tables."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), r, *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, step)


def sized(docs: DataFrame) -> DataFrame:
    """The rows' own columns plus size, key (source, null told apart), bucket and start (words of the source before it).

    Rows are ordered within a source by a hash of doc_id and text, so the order is the same in each run, whatever the
    partitions; wholly equal rows change places without effect.
    """
    h = F.xxhash64("doc_id", F.col("_h"))
    rows = docs.withColumn("key", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))).withColumn("h", h)
    rows = rows.withColumn("bucket", F.pmod("h", F.greatest(F.lit(256), F.expr("_n div 20000"))))
    return running_start(rows, "key", "bucket", [F.col("h"), F.col("doc_id")], "size", "start")


def mix_plan(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, most: int = MOST, seed: int = 17) -> dict[str, Any]:
    """Plan a mix of `docs` (doc_id, text, source; other columns are ignored).

    sources: source, key, source_size, target, n_blocks, n_slots.
    documents: doc_id, source, key, size, start, h (place on its source's word axis, packed into blocks of `block_words`).
    blocks: document_blocks() of them. counts: shard, key, slots. slots: shard, slot, key, block: which block fills each slot of each output shard.
    Places are dealt to output shards by one pseudorandom permutation, so a shard's source counts are a multinomial draw
    given the totals, which meet their targets. A shard's slots of a source follow on those of the shards before it: the
    k-th takes block permutation_epoch(k mod n_blocks), epoch = k div n_blocks, so no block is taken more than `most`
    times, and all blocks are taken equally often, give or take one. Slots of a shard stand in a pseudorandom order.
    Null text has size 0; empty texts and sources of size 0 are never taken; an empty table gives empty tables.
    """
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_h"))
    base = cut(base, "mix-sizes")
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(totals, most).withColumn("key", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))))
    sources = sources.withColumn("n_blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    sources = sources.withColumn("n_slots", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("n_blocks") / F.greatest("source_size", F.lit(1))).cast("long"), F.col("n_blocks") * most)).otherwise(F.lit(0)).cast("long"))
    by_key = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("slot_base", F.coalesce(F.sum("n_slots").over(by_key), F.lit(0))).withColumn("all_slots", F.sum("n_slots").over(Window.partitionBy(F.lit(1))))
    sources = cut(sources.coalesce(1), "mix-sources")
    count = base.agg(F.count("*").alias("_n"))
    documents = sized(base.crossJoin(F.broadcast(count))).select("doc_id", "source", "key", "size", "start", "h")
    # A source's slots come in runs, so that a source with a third of them is dealt over many tasks; their number follows
    # that of the slots, since the few rows here do not tell how many they become.
    total = sources.agg(F.max("all_slots")).first()[0] or 0
    tasks = min(20_000, total // 32_768 + 1)
    runs = sources.filter("n_slots > 0").select("*", F.explode(F.expr("sequence(0, (n_slots - 1) div 4096)")).alias("run")).repartition(tasks, "key", "run")
    places = runs.select("key", "n_blocks", "all_slots", F.explode(F.expr("sequence(slot_base + run * 4096, slot_base + least(n_slots, (run + 1) * 4096) - 1)")).alias("place"))
    at = permuted(F.col("place"), F.col("all_slots"), F.lit(seed))
    counts = places.withColumn("at", at).groupBy(F.expr(f"at div {shard_slots}").alias("shard"), "key", "n_blocks", "all_slots").agg(F.count("*").alias("slots"))
    counts = cut(counts, "mix-counts")
    draws = running_start(counts.withColumn("bucket", F.expr("shard div 256")), "key", "bucket", [F.col("shard")], "slots", "first").drop("bucket").repartition(tasks, "shard")
    inside = Window.partitionBy("shard").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    draws = draws.withColumn("offset", F.coalesce(F.sum("slots").over(inside), F.lit(0)))
    slots = draws.select("*", F.explode(F.expr("sequence(0L, slots - 1)")).alias("i")).withColumn("k", F.col("first") + F.col("i"))
    held = F.least(F.lit(shard_slots).cast("long"), F.col("all_slots") - F.col("shard") * shard_slots)
    slot = permuted(F.col("offset") + F.col("i"), held, F.lit(seed), F.col("shard"))
    block = permuted(F.expr("k % n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("key"), F.expr("k div n_blocks"))
    slots = slots.select("shard", slot.alias("slot"), "key", block.alias("block"))
    return {"sources": sources, "documents": documents, "blocks": document_blocks(documents, block_words), "slots": slots, "counts": counts.select("shard", "key", "slots"), "block_words": block_words}


def document_blocks(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and block that it reaches into: key, block, doc_id, h, start, size, words (the overlap)."""
    d = documents.filter("size > 0").select("doc_id", "key", "h", "start", "size", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
    words = F.expr(f"least(start + size, (block + 1) * {block_words}) - greatest(start, block * {block_words})")
    return d.select("key", "block", "doc_id", "h", "start", "size", words.alias("words"))


def mixed_shards(plan: dict[str, Any]) -> DataFrame:
    """The mix as output shards: shard, slot, doc_id, first_word (in the document, from 0), words. Slots join blocks by index;
    a slot's pieces stand in order of their place on the source's axis (`at`). A block fills at most three slots."""
    at = F.greatest(F.lit(0), F.col("block") * F.lit(plan["block_words"]) - F.col("start"))
    met = plan["slots"].hint("merge").join(plan["blocks"], ["key", "block"])
    return met.select("shard", "slot", "doc_id", at.alias("first_word"), "words", (F.col("start") + at).alias("at"))


def _uses(plan: dict[str, Any]) -> DataFrame:
    """How often each block is taken. It grows with the corpus, so it is merged, never broadcast."""
    return plan["slots"].groupBy("key", "block").agg(F.count("*").alias("uses")).hint("merge")


def taken(plan: dict[str, Any]) -> DataFrame:
    """Words that the mix takes of each document: doc_id, size, source_size, target, taken."""
    held = plan["blocks"].join(_uses(plan), ["key", "block"], "left")
    # A document with words has its place on the axis to itself; those without have none and take nothing.
    took = held.groupBy("doc_id", "key", "start", "size").agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken")).drop("start")
    none = plan["documents"].filter("size = 0").select("doc_id", "key", "size", F.lit(0).cast("long").alias("taken"))
    s = plan["sources"].select("key", "source_size", "target")  # one row per source
    return took.unionByName(none).join(s, "key").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents with the input's own columns, whatever their names: the c-th copy of a document holds its words
    in blocks taken c times or more (c = 1..3). A copy that keeps all words keeps its text as it is, else the words are
    joined by spaces. n_chars follows the text. Rows without words are never taken."""
    plan = mix_plan(docs, block_words)
    held = plan["blocks"].join(_uses(plan), ["key", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    # A document's blocks follow one another, so the uses of its k-th block are entry k of an array.
    per_doc = held.groupBy("key", "doc_id", "h", "start").agg(F.array_sort(F.collect_list(F.struct("block", "uses"))).getField("uses").alias("uses")).filter(F.array_max("uses") > 0)
    # Wholly equal rows share a hash; each takes its own place on the axis.
    per_doc = per_doc.select("doc_id", "h", "start", "uses", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("key", "start")).alias("nth"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("doc_id", F.xxhash64("text")).alias("own_h"), F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).alias("own_key"))
    rows = rows.withColumn("own_nth", F.row_number().over(Window.partitionBy("own_id", "own_h").orderBy("own_key")))
    j = rows.join(per_doc.hint("merge"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_h") == F.col("h")) & (F.col("own_nth") == F.col("nth")))
    words = F.regexp_extract_all(F.col("row").getField("text"), F.lit(WORD), F.lit(0))
    j = j.withColumn("words", words).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("uses"))))
    block = lambda i: F.expr(f"cast(start % {block_words} as int)") + i
    chosen = F.filter("words", lambda w, i: F.get("uses", F.floor(block(i) / block_words).cast("int")) >= F.col("copy"))
    j = j.withColumn("kept", chosen)
    text = F.when(F.size("kept") == F.size("words"), F.col("row").getField("text")).otherwise(F.array_join("kept", " "))
    j = j.withColumn("new_text", text)
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return j.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix_plan(table(spark, sf_dir, "documents")))
