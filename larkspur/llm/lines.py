"""Site-relative line de-duplication.

The column ``site`` holds URLs, whose hosts are the sites (:func:`host_of`), or names
of sites.  A line of a site is boilerplate if the pages of the site that contain it, over
all pages of the site, exceed a ratio (and are a few at least).  Those lines are
dropped from every page of that site; other sites keep theirs.

Lines are compared by the text between line feeds without surrounding spaces,
tabs and carriage returns.  Counting shuffles one 16-byte digest per distinct
line of a page, combined on the map side; page texts are only joined with the
short list of their site, by broadcast while that list is under
``BROADCAST_ROWS`` and by a shuffle join of two plain tables beyond, which the
adaptive rule can split where a site has very many pages.

Cases.  Null text stays null with no lines.  Blank lines are neither counted nor
dropped.  Null site: the site is unknown, so nothing is dropped.  A line repeated
in one page counts once there, and all its copies are dropped.  Repeated rows are
pages of their own.  An empty table gives no rows.  Other columns pass through;
columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans.staging import stage

#: A line on more than this share of a site's pages, and on so many pages at least, is boilerplate.
RATIO, MIN_PAGES = 0.1, 3
#: Boilerplate lines (16 bytes and a site name each) that may be broadcast.
BROADCAST_ROWS = 200_000


def host_of(place: Column) -> Column:
    """The host of a URL, in lower case without user and port; what is no URL stands for its host itself."""
    place = place.cast("string")
    host = F.regexp_extract(place, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:]+)", 1)
    return F.when(host != "", F.lower(host)).otherwise(place)


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _digest(key: Column) -> Column:
    """128 bits in two hashes of unlike seeds."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def boilerplate_lines(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, digest) of every boilerplate line."""
    pages = docs.select(host_of(F.col(site)).alias("site"), F.col(text).cast("string").alias("text")).where("site is not null")
    each = pages.select("site", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), _key))).alias("line")).where("line <> ''")
    counts = each.select("site", _digest(F.col("line")).alias("digest")).groupBy("site", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(totals, "site").where(F.col("n") > F.lit(ratio) * F.col("pages")).select("site", "digest")


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``, and n_lines and n_dropped."""
    found = stage(boilerplate_lines(docs, site, text, ratio, min_pages), "boilerplate")
    by_site = stage(found.groupBy("site").agg(F.collect_set("digest").alias("junk")), "junk")
    if found.count() <= BROADCAST_ROWS:
        by_site = F.broadcast(by_site)
    rows = docs.select(F.struct("*").alias("row"), host_of(F.col(site)).alias("site"), F.split(F.col(text).cast("string"), "\n", -1).alias("lines"))
    kept = F.when(F.col("junk").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("junk"), _digest(_key(x)))))
    out = rows.join(by_site, "site", "left").select("row", "lines", kept.alias("kept"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    columns = [F.array_join("kept", "\n").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in names]
    return out.select(*columns, F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
     e AS (SELECT r, source, trim(line, ' ' || chr(9) || chr(13)) AS line FROM (SELECT r, source, unnest(ls) AS line FROM d)),
     c AS (SELECT source, line, count(DISTINCT r) AS n FROM e WHERE line <> '' AND source IS NOT NULL GROUP BY 1, 2),
     p AS (SELECT source, count(*) AS pages FROM d GROUP BY 1),
     b AS (SELECT source, list(line) AS junk FROM c JOIN p USING (source) WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages GROUP BY 1),
     k AS (SELECT doc_id, ls, CASE WHEN junk IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(junk, trim(x, ' ' || chr(9) || chr(13)))) END AS kept
           FROM d LEFT JOIN b USING (source))
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped,
       CASE WHEN ls IS NOT NULL THEN md5(coalesce(array_to_string(kept, chr(10)), '')) END AS kept_md5
FROM k
"""
