"""Popularity of pages from the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import sigmoid
from corpusloom.session import broadcast_if_small, materialize

# Fixed values of the iterated rank.
LEAST_OUT, LEAST_WEIGHT, CLOSE = 1e-6, 1e-6, 1e-4
FIRST_STEP, SHRINK, GROW, DAMP, STEP_BORDER, STEP_BOUNDS = -0.7, 0.43, 2.11, 0.95, 1.1, (-9999999.99, -0.01)


def edges(links: DataFrame, url: DataFrame, same_site: bool = True) -> DataFrame:
    """(src, dst, weight) of distinct links between known, different pages; without those inside a site if same_site is false."""
    e = links.filter("ot <> k and k <> 0").groupBy(F.col("ot").alias("src"), F.col("k").alias("dst")).agg(F.max("weight").alias("weight"))
    pages = url.select("rec_id", "site_id")
    e = e.join(pages.select(F.col("rec_id").alias("src"), F.col("site_id").alias("a")), "src").join(pages.select(F.col("rec_id").alias("dst"), F.col("site_id").alias("b")), "dst")
    return (e if same_site else e.filter("a <> b or a is null or b is null")).select("src", "dst", "weight")


def link_counts(e: DataFrame, url: DataFrame) -> DataFrame:
    """(rec_id, inlinks, outlinks) of all pages: links as rows of one table, summed in one aggregate (popular targets collapse on the map side)."""
    ends = e.select(F.col("dst").alias("rec_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("rec_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    all_ = ends.unionByName(url.select("rec_id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return all_.groupBy("rec_id").agg(F.sum("i").alias("inlinks"), F.sum("o").alias("outlinks"))


def site_weights(url: DataFrame, servers: DataFrame) -> DataFrame:
    """(site_id, page_weight): a site's weight by its number of pages."""
    pages = url.filter("site_id is not null").groupBy("site_id").agg(F.count("*").alias("pages"))
    return pages.join(broadcast_if_small(servers.select(F.col("rec_id").alias("site_id"), F.col("pop_weight").alias("w"))), "site_id").select("site_id", (F.col("w") / F.col("pages")).alias("page_weight"))


def goo(url: DataFrame, links: DataFrame, servers: DataFrame, shows_weight: float = 0.01) -> DataFrame:
    """(rec_id, pop_rank): each page passes its weight to its targets in equal parts; then shows are added.

    All link weights are known before any sum is taken, so the order of pages does not matter.
    """
    weight = site_weights(url, servers)
    e = edges(links, url)
    out = e.groupBy("src").agg(F.count("*").alias("n"))
    pages = url.select("rec_id", "site_id", "shows").join(weight, "site_id").select(F.col("rec_id").alias("src"), "page_weight")
    share = pages.join(out, "src").select("src", (F.col("page_weight") / F.col("n")).alias("share"))
    got = e.select("src", "dst").join(share, "src").groupBy(F.col("dst").alias("rec_id")).agg(F.sum("share").alias("got"))
    return url.select("rec_id", "shows").join(got, "rec_id", "left").select("rec_id", (F.coalesce("got", F.lit(0.0)) + F.col("shows") * shows_weight).alias("pop_rank"))


def neo(url: DataFrame, links: DataFrame, iterations: int = 3) -> DataFrame:
    """(rec_id, pop_rank): the balance of what comes in and what goes out, by damped steps.

    All pages step at once (the order of pages does not matter); the links' weights are the state, a written table each round.
    """
    rank = url.select("rec_id", F.coalesce("pop_rank", F.lit(0.0)).alias("p"))
    e = materialize(edges(links, url), "edges")
    clamp = lambda x: F.least(F.greatest(x, F.lit(LEAST_OUT)), F.lit(1 - LEAST_OUT))
    state = None
    for _ in range(iterations):
        into = e.join(rank.select(F.col("rec_id").alias("src"), "p"), "src").groupBy(F.col("dst").alias("rec_id")).agg(F.sum(F.col("p") * F.col("weight")).alias("i"))
        out = e.join(rank.select(F.col("rec_id").alias("dst"), "p"), "dst").groupBy(F.col("src").alias("rec_id")).agg(F.sum(F.col("p") * F.col("weight")).alias("o"))
        base = rank if state is None else rank.join(state, "rec_id", "left")
        old_gap, step = (F.lit(None).cast("double"), F.lit(FIRST_STEP)) if state is None else (F.col("gap"), F.col("step"))
        rows = base.join(into, "rec_id", "left").join(out, "rec_id", "left")
        di, oi = clamp(sigmoid(F.coalesce("i", F.lit(0.0)))), clamp(sigmoid(F.coalesce("o", F.lit(0.0))))
        rows = rows.select("rec_id", "p", di.alias("di"), oi.alias("oi"), old_gap.alias("was"), step.alias("s"))
        gap = F.abs(F.col("di") - F.col("oi"))
        delta = F.when(gap > CLOSE, F.col("s") * (F.col("oi") - F.col("di")) * F.col("di") * (1 - F.col("di"))).otherwise(0.0)
        nxt = F.when(F.col("was").isNotNull() & (gap > F.col("was") + CLOSE), F.col("s") * SHRINK).when(F.abs(delta) < STEP_BORDER, F.col("s") * GROW).otherwise(F.col("s") * DAMP)
        rows = materialize(rows.select("rec_id", "p", "di", "oi", gap.alias("gap"), delta.alias("delta"), F.least(F.greatest(nxt, F.lit(STEP_BOUNDS[0])), F.lit(STEP_BOUNDS[1])).alias("step")), "neo")
        moved = e.join(rows.select(F.col("rec_id").alias("src"), "delta"), "src").join(rank.select(F.col("rec_id").alias("dst"), "p"), "dst")
        e = materialize(moved.select("src", "dst", F.least(F.greatest(F.col("weight") + F.col("delta") * F.col("p"), F.lit(LEAST_WEIGHT)), F.lit(1.0)).alias("weight")), "edges")
        rank = rows.select("rec_id", ((F.col("di") + F.col("oi")) / 2).alias("p"))
        state = rows.select("rec_id", "gap", "step")
    return rank.select("rec_id", F.col("p").alias("pop_rank"))
