"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share a part of all words; a target
stops at `CAP` times its source's size and the excess is shared again by weight.

Rates: of all document rates q in [0, CAP] that meet a source's words, the ones nearest to 1 in relative entropy are
exponentially tilted, q = min(CAP, exp(lambda * size / mean size)). The multiplier of each source is the root of the
slope of a convex dual. Newton steps, kept inside a bracket, run for all sources at once: each is one aggregate over
(source, size, number of documents), which holds the same as the documents.

Rounding: a document gets floor(q) copies and one more if the rest of q exceeds a hash of the document by the
source's cut. The cut that meets the target to within one document is found by three rounds of 1,024 bins.

Cases: null text has no words; null source is a source of its own; rows equal in id, source and size share their
decision; a source without words gets the target 0; an empty table gives an empty plan. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import WORD, free_name, staged

CAP = 2.0
SHARE = 1.5
WEIGHTS = (5.0, 2.0, 1.0)
BINS = 1024
CLOSE = 1e-9


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place_of(doc_id: Column, source: Column, size: Column) -> Column:
    """A number in [0, 1) that only the document decides."""
    return F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), source, size), 11) / F.lit(float(1 << 53))


def targets(histogram: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, docs, source_size, weight, target from (source, size, n). Each round is two sums over the sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    sources = histogram.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    nth = (F.row_number().over(order) - 1) % len(weights)
    sources = staged(sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), nth)), "mix-sources")
    total = sources.agg(F.sum("source_size").alias("s")).first().s or 0
    unit = 0.0
    while True:
        held = F.col("weight") * unit >= cap * F.col("source_size")
        row = sources.agg(F.sum(F.when(held, cap * F.col("source_size"))).alias("full"),
                          F.sum(F.when(~held, F.col("weight"))).alias("free")).first()
        if not row.free:
            break
        following = (share * total - (row.full or 0.0)) / row.free
        if following <= unit * (1 + 1e-15):
            break
        unit = following
    return sources.withColumn("target", F.least(F.col("weight") * unit, cap * F.col("source_size")))


def rate(size: Column, cap: float = CAP) -> Column:
    """Rate of a document under its source's multiplier (columns lam, docs, source_size, full)."""
    power = F.least(F.col("lam") * size * F.col("docs") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(50.0))
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.least(F.exp(power), F.lit(cap)))


def multipliers(histogram: DataFrame, sources: DataFrame, cap: float = CAP, rounds: int = 80) -> DataFrame:
    """`sources` with lam and full (everything taken `cap` times)."""
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = sources.withColumns({"full": full, "lam": F.lit(0.0), "low": F.lit(None).cast("double"),
                                 "high": F.lit(None).cast("double"), "done": full})
    state = staged(state, "mix-newton")
    keys = state.columns
    size = F.col("size")
    for _ in range(rounds):
        if state.where(~F.col("done")).limit(1).count() == 0:
            break
        q = rate(size, cap)
        scaled = size * F.col("docs") / F.greatest(F.col("source_size"), F.lit(1))
        sums = histogram.join(state.where(~F.col("done")).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).groupBy("source").agg(
            F.sum(F.col("n") * size * q).alias("words"),
            F.sum(F.when(q < cap, F.col("n") * size * q * scaled).otherwise(0.0)).alias("slope")).withColumnRenamed("source", "of")
        step = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        off = F.col("words") - F.col("target")
        step = step.withColumns({
            "low": F.when(off < 0, F.col("lam")).otherwise(F.col("low")),
            "high": F.when(off >= 0, F.col("lam")).otherwise(F.col("high")),
            "hit": F.col("done") | F.col("words").isNull() | (F.abs(off) <= CLOSE * F.col("target"))})
        newton = F.col("lam") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("low").isNull() | (newton > F.col("low"))) & (
            F.col("high").isNull() | (newton < F.col("high"))) & (F.abs(newton - F.col("lam")) <= 1 + F.abs(F.col("lam")))
        apart = F.when(F.col("low").isNull(), F.col("high") - 1 - F.abs(F.col("high"))).when(
            F.col("high").isNull(), F.col("low") + 1 + F.abs(F.col("low"))).otherwise((F.col("low") + F.col("high")) / 2)
        step = step.withColumn("lam", F.when(F.col("hit"), F.col("lam")).when(inside, newton).otherwise(apart))
        state = staged(step.withColumn("done", F.col("hit")).select(keys), "mix-newton")
    return state.drop("low", "high", "done")


def _with_rates(slim: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """Adds whole (copies at least) and rest, how far the rate's fraction exceeds the place; null for whole rates."""
    of = free_name(slim, "of")
    joined = slim.join(plan.withColumnRenamed("source", of), F.col("source").eqNullSafe(F.col(of))).drop(of)
    q = rate(F.col("size"), cap)
    part = q - F.floor(q)
    return joined.withColumns({"whole": F.floor(q), "rest": F.when(part > 0, part - F.col("place"))})


def mixing_plan(slim: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: source, docs, source_size, weight, target, full, lam, cut. `slim`: source, size, place."""
    histogram = staged(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    plan = multipliers(histogram, targets(histogram, share, weights, cap), cap)
    rated = _with_rates(slim, plan, cap)
    # Between `bottom` and `top` lies the cut; `above` words have more than `top`.
    whole = rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure")).withColumnRenamed("source", "of")
    state = plan.join(whole, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumns({
        "need": F.col("target") - F.col("sure"), "bottom": F.lit(-1.0), "top": F.lit(1.0), "above": F.lit(0.0), "cut": F.lit(1.0)})
    names = state.columns
    state = staged(state, "mix-cut")
    for last in (False, False, True):
        at = F.floor((F.col("rest") - F.col("bottom")) / (F.col("top") - F.col("bottom")) * BINS)
        bins = _with_rates(slim, state, cap).where((F.col("rest") >= F.col("bottom")) & (F.col("rest") < F.col("top"))).groupBy(
            "source", F.greatest(F.least(at, F.lit(BINS - 1)), F.lit(0)).alias("bin")).agg(F.sum("size").alias("s"))
        down = Window.partitionBy("source").orderBy(F.col("bin").desc())  # BINS rows a source at most
        bins = bins.withColumn("c", F.sum("s").over(down)).withColumnRenamed("source", "of")
        met = state.join(bins, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        over = F.col("above") + F.col("c")
        found = met.where(over >= F.col("need")).groupBy("source").agg(F.max(F.struct("bin", "s", "c")).alias("hit")).withColumnRenamed("source", "of")
        merged = state.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        width = (F.col("top") - F.col("bottom")) / BINS
        low = F.col("bottom") + F.col("hit.bin") * width
        met_over = F.col("above") + F.col("hit.c")
        take = F.abs(met_over - F.col("need")) < F.abs(met_over - F.col("hit.s") - F.col("need"))
        state = staged(merged.withColumns({
            # No crossing: all that is left is taken.
            "cut": F.when(F.col("need") <= 0, F.lit(1.0)).when(F.col("hit").isNull(), F.col("bottom")).when(F.lit(last) & take, low).otherwise(low + width),
            "above2": F.when(F.col("hit").isNull(), F.col("above")).otherwise(met_over - F.col("hit.s")),
            "bottom2": F.when(F.col("hit").isNull(), F.col("bottom")).otherwise(low),
            "top2": F.when(F.col("hit").isNull(), F.col("bottom")).otherwise(low + width),
        }).drop("above", "bottom", "top").withColumnsRenamed({"above2": "above", "bottom2": "bottom", "top2": "top"}).select(names), "mix-cut")
    return state.drop("sure", "need", "bottom", "top", "above")


def _slim(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    return slim.withColumn("place", place_of(F.col("doc_id"), F.col("source"), F.col("size")))


def copies_of(cap: float = CAP) -> Column:
    """Number of copies, from the columns whole and rest of a row and cut of its source."""
    return (F.col("whole") + F.when(F.col("rest") >= F.col("cut"), 1).otherwise(0)).cast("bigint")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    slim = staged(_slim(docs, doc_id, text, source), "mix-docs")
    rated = _with_rates(slim, mixing_plan(slim), CAP)
    return rated.select("doc_id", "source", "size", "source_size", "target", rate(F.col("size")).alias("rate"),
                        copies_of().alias("copies"), (copies_of() * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `docs` as often as the mix takes them. Only the plan, a row per source, is joined to texts."""
    plan = mixing_plan(staged(_slim(docs, doc_id, text, source), "mix-docs"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    rows = rows.withColumn("place", place_of(F.col("doc_id"), F.col("source"), F.col("size")))
    counted = _with_rates(rows, plan, CAP).select("row", copies_of().alias("copies")).where("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("nth")).select("row.*")
