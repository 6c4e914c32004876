"""Operator 3: drop lines that too large a share of a site's pages carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import materialize, text_or_empty

#: Lists of lines are broadcast when they hold no more than this many lines altogether (16 bytes each).
BROADCAST_LINES = 200_000
#: Hosts of more than one in HOT_SHARE of all pages are hot: their lists are broadcast in any case, of the others shuffled.
HOT_SHARE = 1_000
#: Parts that a host's list is cut into by the lines' hashes, so that a line is looked up among few.
PARTS = 64


def _fingerprint(line: Column) -> Column:
    """128 bits for a line: two XXH64 of different input. Counting these instead of texts keeps the shuffle small."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _part(f: Column) -> Column:
    return F.pmod(f["a"], F.lit(PARTS)).cast("int") + 1


def site_boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(h, pages, bad): for each host the fingerprints of its boilerplate lines, in PARTS arrays by their hashes.

    A page is a different text of the host. Lines on enough rows are found first, by counts that are aggregated before the
    shuffle; only for these, few at most (mean lines of a page) * (rows of a page) / ratio a host, different texts are counted.
    """
    rows = docs.select(F.col(host).alias("h"), _fingerprint(text_or_empty(text)).alias("t"), F.array_distinct(F.split(text_or_empty(text), "\n")).alias("lines"))
    pages = materialize(rows.groupBy("h", "t").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("pages")))
    each = rows.select("h", "t", F.explode("lines").alias("line")).where(F.trim("line") != "").select("h", "t", _fingerprint(F.col("line")).alias("f"))
    seen = each.groupBy("h", "f").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    enough = lambda d: d.alias("s").join(pages.alias("p"), F.col("s.h").eqNullSafe(F.col("p.h"))).where(F.col("n") > ratio * F.col("pages")).select("s.*", "pages")
    likely = materialize(enough(seen).select(F.col("h").alias("h0"), F.col("f").alias("f0")))
    few = likely.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    again = each.join(F.broadcast(likely) if few else likely, (F.col("f") == F.col("f0")) & F.col("h").eqNullSafe(F.col("h0")), "left_semi")
    exact = again.groupBy("h", "f", "t").agg(F.lit(1)).groupBy("h", "f").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    lists = enough(exact).groupBy("h", "pages").agg(F.collect_list("f").alias("fs"))
    parts = F.transform(F.sequence(F.lit(1), F.lit(PARTS)), lambda k: F.filter("fs", lambda f: _part(f) == k))
    return lists.select("h", "pages", F.size("fs").alias("n"), parts.alias("bad"))


def drop_site_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.01, min_pages: int = 5) -> DataFrame:
    """Remove from every text the lines that more than `ratio` of its host's pages hold (and at least min_pages).

    Pages are the different texts of a host, so copies of a text don't make its lines boilerplate. A page holds a line if the
    exact line stands anywhere in it (told by 128 bits of hashes); repeats within a page count once. Blank lines never count and
    are kept. A null host is a host of its own; null texts count as empty and stay null; equal rows fare alike; an empty table
    stays empty. Returns the input's columns, `text` replaced, with n_lines and n_dropped added (replaced if there already).

    Hosts' lists are broadcast if they are small altogether. If not, those of hot hosts are (HOT_SHARE at most), and the
    other documents are shuffled by host.
    """
    bad = materialize(site_boilerplate(docs, host, text, ratio, min_pages).withColumnsRenamed({"h": "__h", "bad": "__bad"}))
    same = F.col(host).eqNullSafe(F.col("__h"))
    size, pages = bad.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    lists = bad.select("__h", "__bad")
    if size <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(lists), same, "left")
    else:
        hot = F.broadcast(bad.where(F.col("pages") > pages // HOT_SHARE).select("__h", "__bad"))
        rest = docs.join(hot, same, "left_anti").join(bad.where(F.col("pages") <= pages // HOT_SHARE).select("__h", "__bad"), same, "left")
        joined = docs.join(hot, same).unionByName(rest)
    lines = F.split(F.col(text), "\n")

    def good(x: Column) -> Column:
        f = _fingerprint(x)
        return ~F.array_contains(F.element_at("__bad", _part(f)), f)

    kept = F.when(F.col("__bad").isNull(), lines).otherwise(F.filter(lines, good))
    out = joined.withColumn("__kept", kept)
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    dropped = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("__kept")).cast("long")
    out = out.withColumns({"n_lines": n, "n_dropped": dropped, text: F.array_join("__kept", "\n")})
    return out.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])


def oracle(ratio: float = 0.01, min_pages: int = 5, docs: str = "documents") -> str:
    return f"""
WITH texts AS (SELECT DISTINCT source, coalesce(text, '') AS text FROM {docs}),
pages AS (SELECT source, count(*) AS pages FROM texts GROUP BY source),
lines AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM texts),
seen AS (SELECT source, line, count(*) AS n FROM lines WHERE trim(line) <> '' GROUP BY source, line),
bad AS (SELECT s.source, list(s.line) AS bad FROM seen s JOIN pages p ON s.source IS NOT DISTINCT FROM p.source
        WHERE s.n >= {min_pages} AND s.n > {ratio} * p.pages GROUP BY s.source),
cut AS (SELECT d.*, string_split(d.text, chr(10)) AS lines,
               [x FOR x IN string_split(d.text, chr(10)) IF NOT list_contains(coalesce(b.bad, []), x)] AS kept
        FROM {docs} d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
       coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped FROM cut"""
