"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, word_count

#: each of the two narrowing steps splits the order of a source into this many buckets
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Targets of the sources from (``source``, ``source_size``), a row per source.

    Sources in code-point order, null last, take the weights in turn. Weighted shares of the
    whole are capped at ``most`` times the source; the excess goes to the others by weight until
    none is above. Sorted by cap over weight, the capped sources are a prefix, so running sums
    over the sources give the level at once. An empty source has target 0.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_place", place).withColumn("_w", weight.cast("long"))
    cap = F.col("source_size") * most
    order = Window.orderBy((cap.cast("double") / F.col("_w")).asc(), "_place")
    whole = Window.partitionBy()
    run = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(run), F.lit(0))
    left_w = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(run), F.lit(0))
    level = left.cast("double") / left_w
    leveled = ranked.withColumn("_level", level).withColumn("_free", cap.cast("double") / F.col("_w") > F.col("_level"))
    first = F.min(F.when(F.col("_free"), F.struct(cap.cast("double") / F.col("_w"), "_place", "_level"))).over(whole)
    share = F.col("_w") * first["_level"]
    target = F.when(first.isNotNull(), F.least(cap.cast("double"), share)).otherwise(cap.cast("double"))
    return leveled.select("source", "source_size", target.alias("target"))


def _uniform(doc_id: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"mix-{seed}-"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds ``_q``: the odds of the random number over the odds of inclusion; null: not drawn.

    A document that would use up a share of its source's rest is included with a probability
    smaller by that share; one as large as the rest is left to the closing choice.
    """
    inclusion = F.col("_rest") / F.col("source_size") * (1 - F.col("size") / F.col("_rest"))
    odds = inclusion / (1 - inclusion)
    open_ = (F.col("_rest") > 0) & (F.col("size") < F.col("_rest")) & (F.col("source_size") > 0)
    return rows.withColumn("_q", F.when(open_, F.col("_u") / (1 - F.col("_u")) / odds))


def _bucketed(rows: DataFrame) -> DataFrame:
    """Adds the place of the rank, put between 0 and 1, in the two histograms."""
    fine = F.floor(F.col("_q") / (1 + F.col("_q")) * float(BUCKETS * BUCKETS)).cast("long")
    rows = rows.withColumn("_fine", F.when(F.col("_q").isNotNull(), F.least(fine, F.lit(BUCKETS * BUCKETS - 1))))
    return rows.withColumn("_coarse", F.floor(F.col("_fine") / BUCKETS).cast("long"))


def mixing_plan(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: its target, whole copies, last rank of the sample and closing document.

    ``rows``: ``doc_id, source, size, _u``. The sample of a source is the prefix of its documents
    by Pareto rank whose words still fit its rest; then the one document whose size is
    nearest to what is missing is added, if that brings the source closer. The prefix is found
    by two histograms of the rank and an ordered window over one bucket of the second, so no
    source is ever ordered as a whole.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("_copies", ratio.cast("long")).withColumn(
        "_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_copies") * F.col("source_size"))
    )
    plan = materialise(plan, "mix-targets")
    drawn = _bucketed(_ranked(_with(rows, plan, ["source_size", "_rest"])))

    open_rows = drawn.filter("_q IS NOT NULL")
    plan = _crossing(plan, open_rows, "_coarse", "_rest", "_c1", "_before1")
    in_first = _with(open_rows, plan, ["_c1", "_before1"]).filter("_coarse = _c1")
    plan = _crossing(plan, in_first.withColumn("_left", F.col("_rest") - F.col("_before1")), "_fine", "_left", "_c2", "_before2")
    last = _with(in_first, plan, ["_c2", "_before2"]).filter("_fine = _c2")
    # peers (equal rank and id: a repeated row) stand or fall together: the default range frame
    words = F.sum("size").over(Window.partitionBy("source").orderBy("_q", F.col("doc_id").asc_nulls_first()))
    fits = last.withColumn("_words", words + F.col("_before1") + F.col("_before2")).filter("_words <= _rest")
    cut = fits.groupBy("source").agg(F.max(F.struct("_q", "doc_id")).alias("_cut"), F.max("_words").alias("_got"))
    plan = _add(plan, cut, ["_cut", "_got"])
    got = F.coalesce(F.col("_got"), F.col("_before1") + F.col("_before2"), F.lit(0)).cast("long")
    plan = materialise(plan.withColumn("_gap", F.col("_rest") - got), "mix-cuts")

    out = _with(drawn, plan, ["_c1", "_c2", "_cut", "_gap"]).filter(~_sampled())
    miss = F.abs(F.col("size") - F.col("_gap"))
    closing = (
        out.filter(miss < F.col("_gap"))
        .groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "doc_id", "size")).alias("_closing"))
    )
    return materialise(_add(plan, closing, ["_closing"]), "mix-plan")


def _with(rows: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the per-source plan beside each row; Spark broadcasts the plan if it is small."""
    side = plan.select(F.col("source").alias("_source"), *columns)
    return rows.join(side, rows["source"].eqNullSafe(side["_source"]), "left").drop("_source")


_add = _with


def _crossing(plan: DataFrame, rows: DataFrame, bucket: str, rest: str, name: str, before: str) -> DataFrame:
    """The bucket of each source in which the running words pass the rest, and the words before it."""
    hist = rows.groupBy("source", bucket).agg(F.sum("size").alias("_n"), F.max(rest).alias("_limit"))
    running = F.sum("_n").over(Window.partitionBy("source").orderBy(bucket))
    found = (
        hist.withColumn("_run", running).filter(F.col("_run") > F.col("_limit")).groupBy("source")
        .agg(F.min(F.struct(F.col(bucket), (F.col("_run") - F.col("_n")).alias("before"))).alias("_found"))
        .select("source", F.col("_found")[bucket].alias(name), F.col("_found")["before"].alias(before))
    )
    return materialise(_add(plan, found, [name, before]), "mix-crossing")


def _sampled() -> Column:
    """Whether a row is in the prefix of its source; without a crossing all drawn rows are."""
    drawn = F.col("_q").isNotNull()
    cut_id = F.col("_cut")["doc_id"]
    upto = (F.col("_q") < F.col("_cut")["_q"]) | (
        (F.col("_q") == F.col("_cut")["_q"]) & (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") <= cut_id, F.lit(False)))
    )
    inside = (
        F.when(F.col("_c1").isNull(), True)
        .when(F.col("_coarse") != F.col("_c1"), F.col("_coarse") < F.col("_c1"))
        .when(F.col("_c2").isNull(), True)
        .when(F.col("_fine") != F.col("_c2"), F.col("_fine") < F.col("_c2"))
        .otherwise(F.coalesce(upto, F.lit(False)))
    )
    return drawn & inside


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``most``).

    A source's target over its size is the expected number of copies of each of its words: the
    whole part is given to every document, the rest is drawn by Pareto order sampling (see
    ``mixing_plan``). The random number is a hash of the id, so reruns agree.

    Null texts have size 0 and count as taken 0 times their size; a null source is a source, the
    last one; a null id hashes as ``null``. Rows repeated under one id are drawn together. An
    empty table gives an empty result. Columns of ``docs`` named like the new ones are replaced.
    """
    new = ("size", "source_size", "target", "copies")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _uniform(F.col(id_col), seed).alias("_u"),
    )
    plan = mixing_plan(materialise(rows.drop("_row"), "mix-sizes"), weights, most)
    columns = [c for c in plan.columns if c != "source"]
    rows = _bucketed(_ranked(_with(rows, plan, columns)))
    closes = F.col("doc_id").eqNullSafe(F.col("_closing")["doc_id"]) & (F.col("size") == F.col("_closing")["size"])
    extra = _sampled() | (F.col("_closing").isNotNull() & closes)
    copies = F.col("_copies") + F.coalesce(extra, F.lit(False)).cast("long")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in new]
    return rows.withColumn("copies", copies).select(*kept, *new)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as the mix takes it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")
    packed = docs.select(whole, *[F.col(c).alias(a) for c, a in ((id_col, "doc_id"), (text_col, "text"), (source_col, "source"))])
    taken = mix_sources(packed, **settings).filter("copies > 0")
    return taken.select("_whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_whole.*")
