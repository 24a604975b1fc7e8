"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only (id, source, size) rows take part, one small row per document. A source of n documents is cut into about the root of
n blocks by a hash of the document, so a source that holds a third of all rows is spread like any other, and neither its
blocks nor a block's documents are many. Block sizes are summed before the shuffle;
whole passes over a source and one partial pass reach its target to the word. Block draws are dealt to output shards by
a tree: every node splits its exact quotas between its halves by one multivariate hypergeometric draw. The draws of a
source are laid out in permuted order and handed to the shards in disjoint runs; a shard shuffles its own rows locally.

On the driver: one row per source (at most ``MAX_SOURCES``, checked) and sources x shards quotas.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import settle, shuffle_partitions

#: Fixed values of the contract: weights in turn, the mix's share of all sizes, and how often a source may be repeated.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 1_000_000
#: Sources up to which small tables about them are broadcast, and the most block draws that numpy deals (10**11 documents in 10**6 sources have fewer).
BROADCAST_SOURCES, MOST_DRAWS = 10_000, 10**9


def fill_targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's target: its weight's part of ``share`` of all sizes, at most ``most`` times its size, the excess reshared by weight.

    Resharing ends where all open sources get the same number of words for each unit of weight, so sources fill up in the
    order of what they hold for each unit.
    """
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    total, full, open_ = share * sum(sizes), 0.0, sum(weights)
    level = 0.0
    for i in order:
        level = (total - full) / open_
        if level <= most * sizes[i] / weights[i]:
            break
        full += most * sizes[i]
        open_ -= weights[i]
    return [min(most * s, level * w) for s, w in zip(sizes, weights, strict=True)]


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows: shards, columns: sources. A splitting tree; at each node one hypergeometric draw divides the quotas, exactly, in the ratio of the shards below."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    rng = np.random.default_rng([seed, shards])
    total = int(quotas.sum())
    if total >= MOST_DRAWS:
        raise ValueError(f"{total} block draws; at most {MOST_DRAWS} are dealt")
    share = np.zeros_like(quotas)
    need, rest = total * left // shards, total
    for i, q in enumerate(quotas.tolist()):  # the marginals of a multivariate hypergeometric draw
        rest -= q
        share[i] = rng.hypergeometric(q, rest, need) if need else 0
        need -= int(share[i])
    return np.vstack([split_quotas(share, left, 2 * seed + 1), split_quotas(quotas - share, shards - left, 2 * seed + 2)])


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, salt) with the number of words (null texts have none) and a digest of id and text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _salt(F.col(f"`{id_col}`"), text).alias("salt"))


def _salt(doc_id: Column, text: Column) -> Column:
    """A digest that orders documents alike in any engine."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))


def _digest(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)).cast("binary"))


def mix_sources(docs: DataFrame, shards: int = 16, seed: int = 11, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(one row per document, one row per draw of a document).

    The first has doc_id, source, size, source_size, target, taken; the second doc_id, source, salt (a digest of
    id and text), size, pass_no, shard, words, whole (whether all rows that agree in id, text and source draw the same),
    order_key, where a shard's rows sorted by order_key are its local shuffle. Null texts have size 0 and are never
    drawn; a very long text is a row like any other, of which only the words are counted. A null source is a source of
    its own, the last. Repeated rows and ties are separate rows; among rows that agree in everything either may be the one
    that is cut. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = settle(document_sizes(docs, id_col, text_col, source_col))
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.size for r in totals]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], share, most)
    table = []
    for i, (r, t) in enumerate(zip(totals, targets, strict=True)):
        passes = min(int(t // r.size), int(most)) if r.size else 0
        table.append((r.source, i, r.size, t, math.isqrt(r.n), passes, min(math.floor(t + 0.5), int(most * r.size)) - passes * r.size if r.size else 0))
    plan = spark.createDataFrame(table, "source string, sid int, source_size long, target double, blocks int, passes int, partial long")
    near = F.broadcast if len(table) <= BROADCAST_SOURCES else lambda df: df  # one row per source
    rows = rows.join(near(plan.withColumnRenamed("source", "its_source")), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source").withColumn("block", F.pmod(F.conv(F.substr("salt", F.lit(1), F.lit(8)), 16, 10).cast("long"), F.col("blocks")).cast("int"))
    order = Window.partitionBy("sid").orderBy(_digest(seed, "sid", "block"), "block")
    blocks = rows.groupBy("sid", "block").agg(F.sum("size").alias("block_size"))
    blocks = settle(blocks.withColumns({"rank": F.row_number().over(order) - 1, "before": F.coalesce(F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}))
    # The partial pass takes blocks in permuted order until the source's words are reached; within the last one, documents.
    within = Window.partitionBy("sid", "block").orderBy("salt", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(blocks, ["sid", "block"]).withColumn("reached", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.withColumns({"part": F.greatest(F.lit(0), F.least(F.col("size"), F.col("partial") - F.col("reached"))), "even": F.col("before") + F.col("block_size") <= F.col("partial")})
    rows = settle(rows.select("doc_id", "source", "sid", "size", "salt", "source_size", "target", "passes", "part", "even", "blocks", "rank"))
    # Quotas in blocks: whole passes draw all of a source's blocks, the partial pass those that it reaches.
    reached = dict(blocks.join(near(plan), "sid").where("before < partial").groupBy("sid").count().collect())
    quotas = np.array([t[5] * t[4] + reached.get(t[1], 0) for t in table], np.int64)
    dealt = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    ends = near(spark.createDataFrame([(i, dealt[:, i].tolist()) for i in range(len(table))], "sid int, ends array<long>"))  # sources x shards
    # Each document's draws, dealt to the shards by the quotas; only what a shard got is taken.
    draw = lambda p: F.struct(p.alias("pass_no"), F.when(p < F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words"), F.size(F.filter("ends", lambda e: e <= p * F.col("blocks") + F.col("rank"))).alias("shard"), ((p < F.col("passes")) | F.col("even")).alias("whole"))
    dealt_rows = rows.join(ends, "sid").withColumn("dealt", F.filter(F.transform(F.sequence(F.lit(0), F.col("passes")), draw), lambda d: (d["words"] > 0) & (d["shard"] < shards)))
    documents = dealt_rows.select("doc_id", "source", "size", "source_size", "target", F.aggregate("dealt", F.lit(0).cast("long"), lambda n, d: n + d["words"]).alias("taken"))
    draws = dealt_rows.select("doc_id", "source", "salt", "size", F.inline("dealt"))
    return documents, draws.select("doc_id", "source", "salt", "size", "pass_no", "shard", "words", "whole", _digest(seed, "salt", "pass_no").alias("order_key"))


def write_mix(draws: DataFrame, path: str) -> None:
    """Each shard's rows, in their shuffled order, as Parquet below ``shard=``."""
    draws.repartition("shard").sortWithinPartitions("shard", "order_key", "doc_id").write.partitionBy("shard").parquet(path)


def take_mix(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """The mix itself: each document as often as it is drawn, whole passes unchanged, a cut one reduced to its first words.

    Partitions hold the shards in turn, each in its shuffled order; a shard may take several partitions. Has the columns of
    ``docs`` (which has doc_id, text and source; n_chars is renewed for cut texts; names that begin with __mix are an
    error). Documents that are never drawn go, null and wordless texts among them. Very long texts are rows like any
    other. Repeated rows and ties are drawn as rows of their own; where only some rows that agree in id, text and source
    are drawn, any of them may be. An empty table gives no rows.

    Texts are shuffled twice: to meet their draws, and to their shards. Rows that are alike share one row of draws, however
    many they are; only those that straddle the end of a source's last pass are numbered, one such group in a source.
    """
    if any(c.startswith("__mix") for c in docs.columns):
        raise ValueError("columns named __mix... are the operator's own")
    who = ["__mix_key", "__mix_salt", "__mix_source"]
    key = lambda doc_id, source: (F.coalesce(doc_id.cast("long"), F.lit(-1)), F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")))
    draws = mix_sources(docs, shards=shards, **options)[1]
    i, s = key(F.col("doc_id"), F.col("source"))
    draw = lambda words: F.struct("pass_no", "shard", "order_key", words.alias("words"))
    last, size = ~F.col("whole"), F.col("words") == F.col("size")
    drawn = draws.groupBy(i.alias(who[0]), F.col("salt").alias(who[1]), s.alias(who[2])).agg(
        F.max("size").alias("__mix_size"),
        F.collect_set(F.when(F.col("whole"), draw(F.col("words")))).alias("__mix_draws"),
        F.max(F.when(last, draw(F.col("size")))).alias("__mix_last"),
        F.count(F.when(last & size, 1)).alias("__mix_full"),
        F.max(F.when(last & ~size, F.col("words"))).alias("__mix_cut"),
    )
    i, s = key(F.col("doc_id"), F.col("source"))
    rows = docs.withColumns({who[0]: i, who[1]: _salt(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit(""))), who[2]: s})
    met = rows.join(drawn, who)
    alike = met.where("__mix_last is null").withColumn("__mix_one", F.explode("__mix_draws"))
    nth = F.row_number().over(Window.partitionBy(*who).orderBy(F.lit(0)))
    words = F.when(F.col("__mix_nth") <= F.col("__mix_full"), F.col("__mix_size")).when(F.col("__mix_nth") == F.col("__mix_full") + 1, F.col("__mix_cut"))
    cut = met.where("__mix_last is not null").withColumn("__mix_nth", nth).withColumn("__mix_words", words)
    own = F.when(F.col("__mix_words").isNotNull(), F.array(F.col("__mix_last").withField("words", F.col("__mix_words")))).otherwise(F.array().cast("array<struct<pass_no:int,shard:int,order_key:string,words:bigint>>"))
    cut = cut.withColumn("__mix_one", F.explode(F.concat("__mix_draws", own))).drop("__mix_nth", "__mix_words")
    out = alike.unionByName(cut)
    short = F.col("__mix_one.words") < F.col("__mix_size")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("__mix_one.words").cast("int")), " ")
    out = out.withColumn("text", F.when(short, first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(short, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    # The order key is an even digest, so its first digits cut a shard into parts of like size that follow each other.
    parts = max(1, shuffle_partitions(docs.sparkSession) // shards)
    part = F.shiftright(F.conv(F.substr("__mix_one.order_key", F.lit(1), F.lit(8)), 16, 10).cast("long") * parts, 32).cast("int")
    out = out.repartitionById(shards * parts, F.col("__mix_one.shard") * parts + part)
    return out.sortWithinPartitions("__mix_one.shard", "__mix_one.order_key", who[0], "__mix_one.pass_no").select(*docs.columns)


#: What ``mix_sources`` returns first, without the column source, with its default parameters.
ORACLE_SQL = r"""WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS salt FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM rows GROUP BY source),
weighted AS (SELECT *, CAST([3, 1, 2][CAST(sid % 3 AS INT) + 1] AS DOUBLE) AS w FROM sources),
ranked AS (SELECT *, 2.0 * source_size / w AS room, sum(w) OVER (ORDER BY 2.0 * source_size / w DESC, sid DESC) AS open_w, coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, 1.5 * sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 2.0 * source_size / w, sid) AS nth FROM weighted),
level AS (SELECT coalesce(arg_min((total - filled) / open_w, nth) FILTER ((total - filled) / open_w <= room), arg_max((total - filled) / open_w, nth)) AS per_weight FROM ranked),
plan AS (SELECT source, sid, source_size, least(2.0 * source_size, per_weight * w) AS target, CAST(floor(sqrt(n)) AS BIGINT) AS blocks FROM weighted, level),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS passes FROM plan),
quotas AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 2 * source_size) - passes * source_size AS part FROM passes),
placed AS (SELECT r.*, q.* EXCLUDE (source), CAST('0x' || substr(salt, 1, 8) AS BIGINT) % blocks AS block FROM rows r JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source),
filled AS (SELECT sid, block, sum(block_size) OVER (PARTITION BY sid ORDER BY md5('11:' || sid || ':' || block), block) - block_size AS before FROM (SELECT sid, block, sum(size) AS block_size FROM placed GROUP BY ALL)),
reached AS (SELECT *, before + sum(size) OVER (PARTITION BY sid, block ORDER BY salt, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS reached FROM placed JOIN filled USING (sid, block))
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, part - reached)) AS BIGINT) AS taken FROM reached"""
