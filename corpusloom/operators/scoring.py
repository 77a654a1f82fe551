"""Relevance of documents for the words of a query.

Hits are postings joined with the (few) query terms: (doc_id, section, pos, ord, origin). All window and group steps have
the key doc_id, so that one exchange serves them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import config as c
from corpusloom.config import Settings


def hits(post: DataFrame, terms: list[tuple[str, int, str]]) -> DataFrame:
    """Postings of the terms (word, order in query, origin)."""
    spark = post.sparkSession
    table = spark.createDataFrame(terms, "word string, ord int, origin string")
    return post.filter(F.col("word").isin([t[0] for t in terms])).join(F.broadcast(table), "word")  # at most MAX_TERMS rows a form


def _by_origin(which: int) -> Column:
    return reduce(lambda a, kv: a.when(F.col("origin") == kv[0], kv[1][which]), c.ORIGINS.items(), F.when(F.lit(False), 0)).otherwise(0)


def _section_weight(s: Settings) -> Column:
    if not s.weights:
        return F.lit(1)
    return reduce(lambda a, kv: a.when(F.col("section") == kv[0], kv[1]), s.weights.items(), F.when(F.lit(False), 0)).otherwise(1)


def _over(value: Column, best: float, more: float, less: float) -> Column:
    return F.when(value > best, more * (value - best)).otherwise(less * (best - value))


def _floor(a: Column, b: Column | int) -> Column:
    return F.floor(a / b)


def full(rows: DataFrame, n: int, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, hits, score): the full score of hits for n query words."""
    doc = Window.partitionBy("doc_id").orderBy("pos", "ord")
    so_far = doc.rowsBetween(Window.unboundedPreceding, -1)
    # The last position of the word before in the query; none counts as 0.
    last = [F.max(F.when(F.col("ord") == k, F.col("pos"))).over(so_far) for k in range(n)]
    before = reduce(lambda a, k: a.when(F.col("ord") == k, last[(k - 1) % n]), range(n), F.when(F.lit(False), 0))
    step = rows.withColumn("gap", F.col("pos") - F.coalesce(before, F.lit(0)))
    first = F.row_number().over(doc) == 1
    run = F.col("ord") == 0
    exact = F.col("origin") == "query"
    for k in range(1, n):
        run = run & (F.lead("ord", k).over(doc) == k) & (F.lead("pos", k).over(doc) == F.col("pos") + k) & (F.lead("section", k).over(doc) == F.col("section"))
        exact = exact & (F.lead("origin", k).over(doc) == "query")
    step = step.withColumn("first", first).withColumn("run", F.coalesce(run & F.lit(n > 1), F.lit(False))).withColumn("exact", F.coalesce(exact, F.lit(False)))
    per_order = [F.sum((F.col("ord") == k).cast("int")).alias(f"c{k}") for k in range(n)]
    firsts = [F.min(F.when(F.col("ord") == k, F.col("pos"))).alias(f"f{k}") for k in range(n)]
    bits = [F.bit_or(F.when(F.col("ord") == k, _by_origin(0)).otherwise(0)).alias(f"x{k}") for k in range(n)]
    origins = [F.sum((F.col("origin") == o).cast("int")).alias(f"o_{o}") for o in c.ORIGINS]
    wf = _section_weight(settings)
    g = step.groupBy("doc_id").agg(
        F.count("*").alias("hits"), F.sum("pos").alias("positions"), F.sum(F.when(~F.col("first"), F.col("gap")).otherwise(0)).alias("gaps"),
        F.sum((F.col("run")).cast("int")).alias("phrases"), F.sum((F.col("run") & F.col("exact")).cast("int")).alias("exacts"),
        F.collect_set(F.struct("section", wf.alias("w"))).alias("sections"), *per_order, *firsts, *bits, *origins,
    )
    size = F.col("hits") + 2
    nsec = F.aggregate("sections", F.lit(0), lambda a, x: a + x["w"])
    xy = reduce(lambda a, b: a + b, [F.col(f"x{k}") for k in range(n)]) * nsec
    median = _floor(size, n)
    spread = reduce(lambda a, b: a + b, [F.abs(F.col(f"c{k}") - median) for k in range(n)])
    uniform = F.floor(F.floor(spread * c.BEST_WORD_COUNT / n) / (median + 1))
    order = list(c.ORIGINS)  # query, accent, spell, acronym, aspell, synonym; the first of equals leads
    most = F.greatest(*[F.col(f"o_{o}") for o in order])
    lead = reduce(lambda a, io: F.when(F.col(f"o_{io[1]}") == most, io[0]).otherwise(a), reversed(list(enumerate(order))), F.lit(0))
    rank = lambda e: F.when(F.col(e) == 0, F.lit(10000)).otherwise(F.floor(100 / (2 * F.col(e))))
    first_sum = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"f{k}"), F.lit(0)) for k in range(n)])
    y = rank("phrases") + rank("exacts") + xy * lead
    y = y + _over(size, c.BEST_WORD_COUNT * n, c.WORD_COUNT_FACTOR, c.LESS_WORD_COUNT)
    y = y + F.when(uniform > c.UNIFORMITY_BORDER, c.UNIFORMITY_FACTOR).otherwise(c.LESS_UNIFORMITY) * uniform
    y = y + _over(_floor(F.lit(c.POSITION_START) + F.col("positions"), size), c.AVG_POSITION, c.POSITION_FACTOR, c.LESS_POSITION)
    y = y + _over(first_sum, c.BEST_POSITION, c.POSITION_FACTOR, c.LESS_POSITION)
    y = y + _over(_floor(F.lit(c.DISTANCE_START) + F.col("gaps"), size), c.AVG_DISTANCE, c.DISTANCE_FACTOR, c.LESS_DISTANCE)
    x = float(c.COMMON_FULL * n * settings.all_weights)
    score = F.floor(100000.0 * (xy * (size - 1) / size) / (F.lit(x) + y) + 1)
    return g.select("doc_id", "hits", score.cast("bigint").alias("score"))


def _gaps(rows: DataFrame, n: int) -> DataFrame:
    """Hits with the distance to the hit before, and the penalty for words out of order."""
    doc = Window.partitionBy("doc_id").orderBy("pos", "ord")
    prev, was = F.lag("pos").over(doc), F.lag("ord").over(doc)
    apart = (was != (F.col("ord") + 1) % n) & (F.col("ord") != (was + 1) % n)
    return rows.withColumn("gap", F.coalesce(F.col("pos") - prev + F.when(apart, c.ORDER_PENALTY).otherwise(0), F.lit(0))).withColumn("nth", F.row_number().over(doc))


def _summed(rows: DataFrame, n: int, *more: Column) -> DataFrame:
    per_order = [F.sum((F.col("ord") == k).cast("int")).alias(f"c{k}") for k in range(n)]
    return _gaps(rows, n).groupBy("doc_id").agg(F.count("*").alias("hits"), F.sum("gap").alias("gaps"), F.min("pos").alias("first"), *per_order, *more)


def _uneven(n: int) -> Column:
    median = _floor(F.col("hits"), n)
    return reduce(lambda a, b: a + b, [F.when(F.col(f"c{k}") > 0, F.abs(F.col(f"c{k}") - median)).otherwise(c.MISSING_TERM) for k in range(n)])


def section_mask(section: Column, settings: Settings) -> Column:
    """The four bits of a section's weight in its slot, six slots above the origin's."""
    slot = 4 + 4 * ((section - 1) % 6)
    return reduce(lambda a, k: a.when(slot == k, F.shiftleft(_section_weight(settings), k)), range(4, 28, 4), F.when(F.lit(False), 0)).otherwise(0)


def fast(rows: DataFrame, n: int, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, hits, score): the fast score, by the bits in which a document's words differ from ideal ones."""
    ideal = 0xF
    for s in range(1, settings.sections + 1):
        ideal |= settings.weight(s) << (4 + 4 * ((s - 1) % 6))
    masks = [F.bit_or(F.when(F.col("ord") == k, section_mask(F.col("section"), settings).bitwiseOR(_by_origin(1))).otherwise(0)).alias(f"m{k}") for k in range(n)]
    g = _summed(rows, n, *masks)
    x = bin(ideal).count("1") * n
    xy = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"m{k}").bitwiseXOR(F.lit(ideal))) for k in range(n)])
    y = _over(F.col("hits"), c.BEST_WORD_COUNT * n, c.WORD_COUNT_FACTOR, c.LESS_WORD_COUNT) + c.UNIFORMITY_FACTOR * _uneven(n)
    y = y + _over(F.col("first"), c.AVG_POSITION, c.POSITION_FACTOR, c.LESS_POSITION)
    y = y + _over(_floor(F.lit(c.DISTANCE_START) + F.col("gaps"), F.col("hits")), c.AVG_DISTANCE, c.DISTANCE_FACTOR, c.LESS_DISTANCE)
    score = F.when(xy >= x, 1).otherwise(F.floor(100000.0 * (x - xy) / (x + y) + 1))
    return g.select("doc_id", "hits", score.cast("bigint").alias("score"))


def ultra(rows: DataFrame, n: int, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, hits, score): the ultra score. Word counts of all documents are compared alike."""
    wf, ow = _section_weight(settings), _by_origin(2)
    sums = [F.sum(F.when(F.col("ord") == k, ow).otherwise(0)).alias(f"w{k}") for k in range(n)]
    g = _summed(rows, n, F.sum(wf).alias("wf"), F.bit_or(ow).alias("ow"), F.collect_set(F.struct("section", wf.alias("w"))).alias("sections"), *sums)
    xy = F.col("wf") / (F.col("hits") * 15) * F.col("ow") / c.COMMON_ULTRA
    means = reduce(lambda a, b: a + b, [F.when(F.col(f"c{k}") > 0, F.floor(F.col(f"w{k}") / F.col(f"c{k}"))).otherwise(0) for k in range(n)])
    xy = xy * means / (n * c.ORIGINS["query"][2])
    xy = xy * (1 + F.aggregate("sections", F.lit(0), lambda a, s: a + s["w"])) / settings.all_weights
    words = reduce(lambda a, b: a + b, [F.abs(F.col(f"c{k}") - c.BEST_WORD_COUNT) for k in range(n)])
    y = 1 + c.WORD_COUNT_FACTOR * words + c.UNIFORMITY_FACTOR * _uneven(n)
    y = y + _over(F.col("first"), c.AVG_POSITION, c.POSITION_FACTOR, c.LESS_POSITION)
    y = y + _over(_floor(F.lit(c.DISTANCE_START) + F.col("gaps"), F.col("hits")), c.AVG_DISTANCE, c.DISTANCE_FACTOR, c.LESS_DISTANCE)
    return g.select("doc_id", "hits", F.floor(100000.0 * xy / (1 + F.log(y)) + 1).cast("bigint").alias("score"))
