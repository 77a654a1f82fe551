"""Lines that many pages of one site repeat, kept as tables of counts that grow by deltas.

State is a folder of tables, each with one part a merge, so that a merge writes in proportion to its delta:
`lines` (site, page, line_no and the line's hashes: the index from a line to its pages), `pages` (digest of the body that
counted), `retired` (page versions that a changed body replaced), `counts` (changes of the number of pages by line, in
folders by a hash of the site; parts are summed up into one from time to time) and `commits` (the merges that are whole).
A merge takes (page, body) rows: unknown pages and those whose body has changed. It adds and takes away counts, finds
which lines have crossed the threshold, in either direction, among the lines of the delta alone, and looks up in the
index the older documents that hold one. Only these and the new documents have to be rebuilt. `LineCounts.open` goes on
with the state in another session.

Lines are compared in a normal form (white space runs as one blank, trimmed, lower case, digit runs as 0), by two
64-bit hashes of it. Counting is by partial aggregates, so a site or line that a third of the pages share
sends one row per task.

Cases: a null body, site or page is left out; lines with an empty normal form do not count; repeated rows of a page count
once, and several bodies of a page in one merge count as one page; the least site is taken if a page should have several; a body
without a known site waits (give it again with its site); a page given again with the same body changes nothing; a merge that
was broken off is not part of the state and is written anew; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import exists, materialize

#: Pages of one site on which a line has to stand to be removed.
MIN_PAGES = 5


def site_of(url: Column) -> Column:
    """The host of a URL, lower case, without user, port and one leading 'www.'; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@\s]+)", 1)
    return F.when(host != "", host)


def normal_line(line: Column) -> Column:
    """The form in which lines are compared."""
    blank = r"[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]+"
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, blank, " "))), "[0-9]+", "0")


def lines_of(bodies: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, page, line_no, h1, h2) of the lines that count, of bodies (page, body) whose page is in sites (page, site).

    Hashes are joined with the sites, not texts: a line is 30 bytes on the way, however long it is.
    """
    normal = F.transform(F.split("body", "\n", -1), normal_line)
    rows = bodies.filter("page is not null and body is not null").select("page", F.posexplode(normal).alias("line_no", "line")).filter("line <> ''")
    rows = rows.select("page", "line_no", F.xxhash64("line").alias("l1"), F.xxhash64(F.length("line"), F.reverse("line")).alias("l2"))
    site = sites.filter("page is not null and site is not null").groupBy("page").agg(F.min("site").alias("site"))
    return rows.join(site, "page").select("site", "page", "line_no", F.xxhash64("l1", "site").alias("h1"), F.xxhash64("site", "l2").alias("h2"))


@dataclass
class Merge:
    """What a merge has changed. affected: (page) of the documents to rebuild; removed: (page, line_no) of all lines to remove from these; crossed: (h1, h2, up)."""

    affected: DataFrame
    removed: DataFrame
    crossed: DataFrame


#: Folders that the counts of sites are dealt to, and parts of counts that are summed up into one.
BUCKETS, PARTS = 16, 8
_SCHEMAS = {
    "lines": "site string, page {page}, line_no int, h1 bigint, h2 bigint, v int", "pages": "page {page}, digest bigint, v int", "retired": "page {page}, old int, v int",
    "counts": "h1 bigint, h2 bigint, n bigint, bucket int",
}


class LineCounts:
    """The state in a folder that all executors share. A new one is empty."""

    def __init__(self, spark: SparkSession, path: str, threshold: int = MIN_PAGES):
        self.spark, self.path, self.threshold, self.version, self.base = spark, path.rstrip("/"), threshold, 0, 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, threshold: int = MIN_PAGES) -> LineCounts:
        """The state as the last whole merge left it."""
        state = cls(spark, path, threshold)
        if exists(spark, f"{state.path}/commits"):
            rows = spark.read.schema("v int, base int").parquet(f"{state.path}/commits").collect()  # one row a merge
            state.version, state.base = max((r.v, r.base) for r in rows)
        return state

    def _write(self, name: str, rows: DataFrame, v: int, by: str | None = None) -> DataFrame:
        path = f"{self.path}/{name}/part={v}"
        out = rows.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _read(self, name: str, page: str, first: int = 1) -> DataFrame | None:
        paths = [f"{self.path}/{name}/part={v}" for v in range(max(1, first), self.version + 1)]
        paths = [p for p in paths if name != "retired" or exists(self.spark, p)]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").schema(_SCHEMAS[name].format(page=page)).parquet(*paths)
        return rows.drop("part")

    def merge(self, bodies: DataFrame, sites: DataFrame) -> Merge:
        """Merge (page, body) rows with the (page, site) they belong to."""
        v, page = self.version + 1, bodies.schema["page"].dataType.simpleString()
        new = bodies
        old_pages = self._current("pages", page)
        if old_pages is not None:  # pages whose body is the one that counted are nothing new
            digests = bodies.filter("page is not null and body is not null").groupBy("page").agg(_digest().alias("digest"))
            known = digests.join(old_pages, ["page", "digest"], "left_semi").select("page")
            new = bodies.join(known, "page", "left_anti")
        lines = self._write("lines", lines_of(new, sites).withColumn("v", F.lit(v)), v)
        digests = new.filter("page is not null and body is not null").groupBy("page").agg(_digest().alias("digest"))
        with_site = sites.filter("site is not null").select("page").distinct()
        counted = self._write("pages", digests.join(with_site, "page", "left_semi").select("page", "digest", F.lit(v).alias("v")), v).select("page")
        added = lines.select("site", "page", "h1", "h2").distinct().groupBy("site", "h1", "h2").agg(F.count("*").alias("n"))
        if old_pages is None:
            delta = added
        else:
            retired = self._write("retired", old_pages.join(counted, "page", "left_semi").select("page", F.col("v").alias("old"), F.lit(v).alias("v")), v)
            gone = self._read("lines", page).join(retired.select("page", F.col("old").alias("v")), ["page", "v"], "left_semi")
            gone = gone.select("site", "page", "h1", "h2").distinct().groupBy("site", "h1", "h2").agg((-F.count("*")).alias("n"))
            delta = added.unionByName(gone).groupBy("site", "h1", "h2").agg(F.sum("n").alias("n"))
        delta = self._write("counts", delta.select("h1", "h2", "n", F.pmod(F.xxhash64("site"), F.lit(BUCKETS)).cast("int").alias("bucket")), v, "bucket")
        before = self._read("counts", page, self.base)
        if before is None:
            crossed = delta.filter(F.col("n") >= self.threshold).select("h1", "h2", F.lit(True).alias("up"))
        else:
            old = before.join(delta.select("h1", "h2", "bucket"), ["h1", "h2", "bucket"], "left_semi").groupBy("h1", "h2", "bucket").agg(F.sum("n").alias("old"))
            both = delta.join(old, ["h1", "h2", "bucket"], "left").withColumn("old", F.coalesce("old", F.lit(0))).withColumn("now", F.col("old") + F.col("n"))
            crossed = materialize(both.filter((F.col("now") >= self.threshold) != (F.col("old") >= self.threshold)).select("h1", "h2", (F.col("now") >= self.threshold).alias("up")), "crossed")
        if v - self.base >= PARTS:  # the parts become one
            everything = delta if before is None else before.unionByName(delta.select(before.columns))
            summed = materialize(everything.groupBy("h1", "h2", "bucket").agg(F.sum("n").alias("n")).filter("n <> 0"), "summed")
            self._write("counts", summed.select("h1", "h2", "n", "bucket"), v, "bucket")
            self.base = v
        self.spark.range(1).select(F.lit(v).alias("v"), F.lit(self.base).alias("base")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/part={v}")
        self.version = v
        if old_pages is None:
            return Merge(counted, to_remove(lines, crossed), crossed)
        live = self._current("lines", page)
        affected = materialize(live.join(crossed, ["h1", "h2"], "left_semi").select("page").unionByName(counted).distinct(), "affected")
        return Merge(affected, to_remove(live.join(affected, "page", "left_semi"), self.crossed()), crossed)

    def _current(self, name: str, page: str) -> DataFrame | None:
        """Rows of lines or pages without those of replaced page versions."""
        rows, retired = self._read(name, page), self._read("retired", page)
        return rows if rows is None or retired is None else rows.join(retired.select("page", F.col("old").alias("v")), ["page", "v"], "left_anti")

    def crossed(self) -> DataFrame:
        """All lines at or above the threshold."""
        sums = self._read("counts", "int", self.base).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        return sums.filter(F.col("n") >= self.threshold).select("h1", "h2")


def _digest():
    """Of all bodies of a page, whatever their order and number."""
    return F.xxhash64(F.array_sort(F.collect_set(F.xxhash64("body", F.length("body")))))  # a number for each different body


def to_remove(lines: DataFrame, crossed: DataFrame) -> DataFrame:
    """(page, line_no) of the lines that are among the crossed ones."""
    return lines.join(crossed, ["h1", "h2"], "left_semi").select("page", "line_no").distinct()


def rebuild(bodies: DataFrame, removed: DataFrame) -> DataFrame:
    """(page, body, removed) of the documents that hold removed lines: the body without them, and their number.

    bodies has page and body; removed has page and line_no.
    """
    gone = removed.groupBy("page").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    kept = F.filter(F.split("body", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    return bodies.join(gone, "page").select("page", F.array_join(kept, "\n").alias("body"), F.size("gone").alias("removed"))
