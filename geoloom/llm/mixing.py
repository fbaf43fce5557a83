"""Mixing sources to target word counts by Pareto order sampling.

Per source the target gives an expected number of copies of its words. The whole
part is allocated to all of its documents for certain. The remaining words are
filled by a further copy of some documents: a document's inclusion probability is
min(1, level * size ** POWER), where the level makes the expected words the
remaining ones. Documents whose probability reaches 1 (the longest) get that copy
for certain too. Of the others a sample of fixed size, the rounded sum of their
probabilities, is drawn by Pareto order sampling: the documents with the smallest
random odds divided by inclusion odds. Random numbers come from a hash of the
identifier, so reruns agree and any executor can recompute them.

Shuffled are sums per source, per source and size, and per source and bucket of
the order. The order's cut lies in one bucket, whose documents alone are sorted;
all others compare their bucket with it. The order's cut is near 1 in every
source, so a bucket there holds about 2 / BUCKETS of the source's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.storage import job, materialize, result, running_sums

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by source order, repeating; share of all words; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Inclusion odds follow this power of the size: 0 equal chances, 1 chances in proportion to size.
POWER = 0.5
BUCKETS = 4096
#: Documents a source that may change sides to bring its words near the target.
TURNS = 4
SEED = "mix-1"
#: The table with a row a source is broadcast up to this many rows; beyond it each row is joined in SALTS copies.
BROADCAST_ROWS, SALTS = 50_000, 64


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the key only."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(2.0**52)


def source_targets(per: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (source, source_size) each source's target, copies of all its documents, and words that remain.

    The share of all words is dealt by weight; targets stop at ``most`` times the
    source's size and the excess is dealt again. Sources are capped in the order of
    cap over weight; the first that isn't shows the water level: what the capped ones
    leave of the share, by the others' weights. Sums over the order are taken in ranges.
    """
    cap, weight = F.col("source_size") * most, F.col("weight")
    named = running_sums(per.select("source", "source_size"), [F.col("source").isNull(), F.col("source")], {}, rows="number")
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    sums = running_sums(named, [cap / weight, F.col("source").isNull(), F.col("source")], {"cap_before": cap, "weight_before": weight})
    total = sums.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weights")).first()
    everything = total["words"] * share
    sums = sums.withColumn("capped", cap * (F.lit(total["weights"]) - F.col("weight_before")) <= (F.lit(everything) - F.col("cap_before")) * weight)
    free = sums.agg(F.sum(F.when(~F.col("capped"), weight)).alias("weights"), F.coalesce(F.sum(F.when(F.col("capped"), cap)), F.lit(0)).alias("caps")).first()
    level = (everything - free["caps"]) / free["weights"] if free["weights"] else 0.0
    out = sums.withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(F.lit(level) * weight))
    out = out.withColumn("copies", F.expr(f"least({most}, cast(floor(coalesce(try_divide(target, cast(source_size as double)), 0.0D)) as bigint))"))
    return out.select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("remaining"))


def inclusion_levels(sizes: DataFrame, power: float) -> DataFrame:
    """From (source, remaining, size, n) each source's level, the size from which a copy is certain, and how many of the other documents to draw.

    The window goes over the distinct sizes of a source, longest first: a size is
    certain if the level, with all longer ones taken as certain, brings it to 1.
    """
    mass = F.col("n") * F.col("size")
    chance = F.pow(F.col("size").cast("double"), F.lit(power))
    down = W.partitionBy("source").orderBy(F.desc("size"))
    s = sizes.where("size > 0").withColumns({"mass": mass, "chance": chance, "pull": mass * chance})
    s = s.withColumn("left", F.col("remaining") - (F.sum("mass").over(down) - F.col("mass")))
    s = s.withColumn("rest", F.sum("pull").over(W.partitionBy("source")) - (F.sum("pull").over(down) - F.col("pull")))
    s = s.withColumn("certain", (F.col("left") > 0) & (F.col("left") * F.col("chance") >= F.col("rest")))
    per = s.groupBy("source").agg(
        F.min(F.when(F.col("certain"), F.col("size"))).alias("certain_from"),
        (F.first("remaining") - F.coalesce(F.sum(F.when(F.col("certain"), F.col("mass"))), F.lit(0))).alias("words"),
        F.sum(F.when(~F.col("certain"), F.col("pull"))).alias("pull"),
        F.sum(F.when(~F.col("certain"), F.col("n") * F.col("chance"))).alias("chances"),
    )
    per = per.withColumn("level", F.greatest(F.coalesce(F.try_divide("words", "pull"), F.lit(0.0)), F.lit(0.0)))
    return per.select("source", "level", "certain_from", F.coalesce(F.round(F.col("level") * F.col("chances")), F.lit(0)).cast("bigint").alias("wanted"))


def probability(power: float) -> Column:
    """A document's chance of a further copy, from its size and its source's level."""
    own = F.col("level") * F.pow(F.col("size").cast("double"), F.lit(power))
    return F.when(F.col("size") >= F.col("certain_from"), 1.0).otherwise(F.coalesce(F.least(own, F.lit(1.0)), F.lit(0.0)))


def order_of(u: Column, p: Column) -> Column:
    """Pareto order: random odds over inclusion odds; null where the chance is 0 or 1."""
    return F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, power: float = POWER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, p, in_sample, drawn.

    Null text has size 0, null source is a source of its own, ordered last. p is the
    chance of a copy beyond those that all documents of the source get; in_sample
    tells whether it was certain or drawn. As documents are whole, words may still
    be missing or over; up to TURNS documents a source then change sides, each time
    the one that brings the words nearest to the target, and ``drawn`` tells what
    counts. Repeated rows of one identifier and size share their place in the order.
    Documents without words are never drawn. An empty table gives an empty result;
    further columns are ignored; texts of any length are counted whole.
    """
    with job(docs.sparkSession):
        picked = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
        return result(_mix_sources(picked, weights, share, most, power), "mix")


def _mix_sources(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, power: float) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = materialize(docs.select("doc_id", "source", size.alias("size"), uniform(F.col("doc_id")).alias("u")), "sized")
    sizes = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    plan = materialize(source_targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most), "targets")
    few = plan.count() <= BROADCAST_ROWS

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        """Left join by source. A source may hold a third of the left rows, so beyond the broadcast its one right row is met in SALTS tasks."""
        right = right.withColumnRenamed("source", "of")
        same = F.col("source").eqNullSafe(F.col("of"))
        if few:
            return left.join(F.broadcast(right), same, "left").drop("of")
        left = left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
        right = right.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        return left.join(right, same & (F.col("salt") == F.col("of_salt")), "left").drop("of", "salt", "of_salt")

    plan = materialize(with_source(plan, inclusion_levels(with_source(sizes, plan.select("source", "remaining")), power)), "levels")

    # the bucket in which each source's sample is complete
    p = probability(power)
    placed = with_source(sized, plan.select("source", "level", "certain_from", "wanted")).withColumn("order", order_of(F.col("u"), p))
    placed = placed.withColumn("bucket", F.floor(F.col("order") / (1 + F.col("order")) * BUCKETS).cast("int"))
    counts = placed.where(F.col("order").isNotNull()).groupBy("source", "wanted", "bucket").agg(F.count("*").alias("n"))
    counts = counts.withColumn("reached", F.sum("n").over(W.partitionBy("source").orderBy("bucket")))
    edge = counts.where("reached >= wanted and wanted > 0").groupBy("source").agg(F.min("bucket").alias("edge"), F.min_by(F.col("wanted") - F.col("reached") + F.col("n"), "bucket").alias("open"))
    edge = materialize(edge, "edges")
    rank = F.struct("order", "doc_id", "size")
    at_edge = with_source(placed, edge).where("bucket = edge")
    cut = at_edge.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("order", "doc_id", "size"))).where("k <= open").groupBy("source").agg(F.max(rank).alias("cut"))
    plan = materialize(with_source(with_source(plan, edge), cut), "cuts")

    def drawn(plan: DataFrame, *further: str) -> DataFrame:
        """All documents with their chance, their place in the order, and whether they are in the sample."""
        all_ = with_source(sized, plan.select("source", "source_size", "target", "copies", "level", "certain_from", "edge", "cut", *further))
        all_ = all_.withColumn("p", probability(power)).withColumn("order", order_of(F.col("u"), F.col("p")))
        all_ = all_.withColumn("bucket", F.floor(F.col("order") / (1 + F.col("order")) * BUCKETS).cast("int"))
        inside = (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (rank <= F.col("cut")))
        return all_.withColumn("in_sample", (F.col("p") == 1) | F.coalesce(inside, F.lit(False)))

    # who may change sides: of each source, size and side the TURNS first in the order, since equal sizes bring equal gains
    own = drawn(plan).where("size > 0").withColumn("rank", F.struct(F.coalesce("order", F.lit(0.0)).alias("order"), F.col("doc_id"), F.col("size")))
    first = own.withColumn("k", F.row_number().over(W.partitionBy("source", "size", "in_sample").orderBy("rank"))).where(F.col("k") <= TURNS)
    first = materialize(first.select("source", "size", "in_sample", "rank"), "first")
    words = own.where("in_sample").groupBy("source").agg(F.sum("size").alias("words"))
    state = with_source(plan.select("source", "remaining"), words)
    state = state.select("source", (F.col("remaining") - F.coalesce("words", F.lit(0))).alias("missing"), F.filter(F.array(F.lit(None).cast(first.schema["rank"].dataType)), lambda x: F.lit(False)).alias("turned"))
    state = materialize(state, "turns")
    left = F.when(F.col("in_sample"), F.col("missing") + F.col("size")).otherwise(F.col("missing") - F.col("size"))
    for _ in range(TURNS):
        free = with_source(first, state).where(~F.array_contains("turned", F.col("rank")) & (F.abs(left) < F.abs("missing")))
        turn = free.groupBy("source").agg(F.min(F.struct(F.abs(left).alias("gap"), F.col("rank"), left.alias("left"))).alias("turn"))
        state = with_source(state, turn)
        state = materialize(state.select("source", F.coalesce("turn.left", "missing").alias("missing"), F.when(F.col("turn").isNull(), F.col("turned")).otherwise(F.concat("turned", F.array("turn.rank"))).alias("turned")), "turns")
    out = drawn(with_source(plan, state.select("source", "turned")), "turned")
    turned = F.exists("turned", lambda t: t["doc_id"].eqNullSafe(F.col("doc_id")) & (t["size"] == F.col("size")))
    copies = F.col("copies") + F.col("drawn").cast("bigint")
    out = out.withColumn("drawn", F.col("in_sample") != F.coalesce(turned, F.lit(False)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "p", "in_sample", "drawn")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("p", 9).alias("p"), "in_sample", "drawn")


def _turn(k: int) -> str:
    """One document of each source changes sides."""
    after = "CASE WHEN drawn THEN missing + size ELSE missing - size END"
    best = f"row_number() OVER (PARTITION BY source ORDER BY CASE WHEN abs({after}) < abs(missing) AND NOT turned AND size > 0 THEN 0 ELSE 1 END, abs({after}), q0, doc_id, size) = 1 AND abs({after}) < abs(missing) AND NOT turned AND size > 0"
    return f"""pick{k} AS (SELECT *, {after} AS after, {best} AS best FROM turn{k}),
turn{k + 1} AS (SELECT * EXCLUDE (drawn, missing, turned, after, best), drawn <> best AS drawn, turned OR best AS turned, coalesce(max(CASE WHEN best THEN after END) OVER (PARTITION BY source), missing) AS missing FROM pick{k})"""


OP8_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / pow(2::DOUBLE, 52) AS u
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM sized GROUP BY source),
filled AS (
  SELECT *, source_size * 2 AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(source_size * 2) OVER b, 0) AS left_over,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left
  FROM per WINDOW b AS (ORDER BY source_size * 2::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap * weight_left <= left_over * weight AS capped FROM filled),
leveled AS (SELECT *, (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN weight END) OVER () AS water FROM capped),
target AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE water * weight END AS target FROM leveled),
plan AS (
  SELECT *, least(2, CAST(floor(coalesce(target / nullif(CAST(source_size AS DOUBLE), 0), 0)) AS BIGINT)) AS whole FROM target),
rest AS (SELECT *, target - whole * source_size AS remaining FROM plan),
chances AS (
  SELECT s.*, r.source_size, r.target, r.whole, r.remaining, pow(CAST(s.size AS DOUBLE), {POWER}) AS chance
  FROM sized s JOIN rest r ON s.source IS NOT DISTINCT FROM r.source),
longest AS (
  SELECT *, remaining - coalesce(sum(size) OVER longer, 0) AS still,
         sum(size * chance) OVER (PARTITION BY source ORDER BY size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pull
  FROM chances WINDOW longer AS (PARTITION BY source ORDER BY size DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)),
sure AS (SELECT *, size > 0 AND still > 0 AND still * chance >= pull AS certain FROM longest),
leveling AS (
  SELECT *, greatest(coalesce((remaining - coalesce(sum(CASE WHEN certain THEN size END) OVER (PARTITION BY source), 0))
         / nullif(sum(CASE WHEN NOT certain THEN size * chance END) OVER (PARTITION BY source), 0), 0), 0) AS level FROM sure),
inclusion AS (
  SELECT *, CASE WHEN certain THEN 1::DOUBLE ELSE least(level * chance, 1::DOUBLE) END AS p,
         CAST(round(level * coalesce(sum(CASE WHEN NOT certain THEN chance END) OVER (PARTITION BY source), 0)) AS BIGINT) AS wanted FROM leveling),
odds AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM inclusion),
ranked AS (SELECT *, coalesce(q, 0) AS q0, row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size) AS k FROM odds),
sampled AS (SELECT *, p = 1 OR (q IS NOT NULL AND k <= wanted) AS in_sample FROM ranked),
turn0 AS (SELECT *, in_sample AS drawn, false AS turned, remaining - coalesce(sum(CASE WHEN in_sample THEN size END) OVER (PARTITION BY source), 0) AS missing FROM sampled),
{", ".join(_turn(k) for k in range(TURNS))}
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN drawn THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(whole + CASE WHEN drawn THEN 1 ELSE 0 END AS BIGINT) AS copies, round(p, 9) AS p, in_sample, drawn
FROM turn{TURNS}
"""
