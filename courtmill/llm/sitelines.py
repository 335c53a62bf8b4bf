"""Lines repeated across one site's documents: log-likelihood ratio with false-discovery control.

For each (source, line) the number of the source's records that hold the line is set against the
line's frequency outside the source. Sources that repeat the line themselves (``REPEATS`` records or
more) are left out of the outside side: a notice shared by several sites is no ordinary use of the line.
Where that leaves fewer outside records than the source has, the line is set against the mean line
frequency within the source instead. P-values are conservative upper bounds of the chi-square
tail, kept as logarithms; the Benjamini-Hochberg cut is found on a histogram of them, so nothing is
sorted globally and nothing but the histogram (one row per tenth of a nat) is in one place.

Only 128 bits per line are shuffled, never texts; a record's own repeats are dropped before the shuffle.
Where no ``ord`` comes twice, which is looked up first, counts are combined on the map side; where some do,
each (source, line, ord) is shuffled once, spread by all three, so a hot source or line is no hot task
either way. The counts are written once and read by every later step.

Defined results: null segments and blank lines have no line; a null source is a source of its own;
repeated rows with the same ``ord`` count once; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtmill.session import checkpoint

MIN_RECORDS = 15
#: Records of another source from which that source counts as repeating the line itself.
REPEATS = 3
FALSE_DISCOVERIES = 0.05
#: Width of the histogram's bins of log p, in nats.
BIN = 0.1
KEYS = ("site", "k1", "k2")


def normal_line(line: Column) -> Column:
    """A line as it is compared: runs of spaces, tabs and CRs shrunk, trimmed, in lower case."""
    return F.lower(F.btrim(F.regexp_replace(line, "[ \t\r]+", " "), F.lit(" ")))


def _keyed(line: Column) -> Column:
    text = normal_line(line)
    return F.when(text != "", F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("line"), text, F.length(text)).alias("k2")))


def _records(records: DataFrame) -> DataFrame:
    return records.select("ord", F.coalesce(F.col("source"), F.lit("\u0000")).alias("site"), "review_text")


def occurrences(records: DataFrame) -> DataFrame:
    """(ord, site, seg_no, line_no, k1, k2) of every line that isn't blank; positions start at 0."""
    segments = _records(records).select("ord", "site", F.posexplode("review_text").alias("seg_no", "segment"))
    lines = segments.select("ord", "site", "seg_no", F.posexplode(F.transform(F.split("segment", "\n", -1), _keyed)).alias("line_no", "key"))
    return lines.filter(F.col("key").isNotNull()).select("ord", "site", "seg_no", "line_no", "key.k1", "key.k2")


def line_counts(records: DataFrame) -> DataFrame:
    """(site, k1, k2, n): the number of a site's records that hold a line."""
    keys = F.flatten(F.transform(F.filter("review_text", lambda s: s.isNotNull()), lambda s: F.transform(F.split(s, "\n", -1), _keyed)))
    each = _records(records).select("ord", "site", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
    once = records.groupBy("ord").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    n = F.count(F.lit(1)) if once else F.countDistinct("ord")
    return each.select("site", "key.k1", "key.k2", "ord").groupBy(*KEYS).agg(n.alias("n"))


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.log(y)).otherwise(F.lit(0.0))


def _log_p(ratio: Column) -> Column:
    """Upper bound of ln P(chi-square with 1 degree of freedom > ratio)."""
    return F.when(ratio > 1.0, -ratio / 2 - 0.5 * F.log(ratio * 3.141592653589793 / 2)).otherwise(F.lit(0.0))


def excess_lines(records: DataFrame, min_records: int = MIN_RECORDS, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(site, k1, k2, n, expected, ratio, log_p) of the lines a site repeats significantly often."""
    counts = checkpoint(line_counts(records))  # 128 bits and two short columns a line; read three times
    sites = _records(records).groupBy("site").agg(F.countDistinct("ord").alias("site_records"))
    lines = counts.groupBy("site").agg(F.avg("n").alias("mean_n"), F.count(F.lit(1)).alias("tests"))
    sites = sites.join(lines, "site", "left")
    total = sites.agg(F.sum("site_records").alias("all_records"), F.sum("tests").alias("all_tests"))
    often = counts.filter(F.col("n") >= min_records)
    carried = counts.join(often.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").join(sites.select("site", "site_records"), "site")
    repeats = F.col("n") >= min(REPEATS, min_records)
    outside = carried.groupBy("k1", "k2").agg(
        F.sum(F.when(~repeats, F.col("n")).otherwise(0)).alias("elsewhere"),
        F.sum(F.when(repeats, F.col("site_records")).otherwise(0)).alias("carriers_records"),
    )
    tested = often.join(outside, ["k1", "k2"]).join(sites, "site").crossJoin(F.broadcast(total))  # total is one row
    a, n1 = F.col("n").cast("double"), F.col("site_records").cast("double")
    b, n2 = F.col("elsewhere").cast("double"), (F.col("all_records") - F.col("carriers_records")).cast("double")
    pooled = (a + b) / (n1 + n2)
    two_sided = 2 * (_xlogy(a, a / (n1 * pooled)) + _xlogy(b, b / (n2 * pooled)) + _xlogy(n1 - a, (n1 - a) / (n1 * (1 - pooled))) + _xlogy(n2 - b, (n2 - b) / (n2 * (1 - pooled))))
    within = F.col("mean_n")
    one_sided = 2 * (a * F.log(a / within) - (a - within))
    compares = (n2 >= n1) & (pooled < 1)
    tested = tested.withColumn("expected", F.when(compares, n1 * b / n2).otherwise(within))
    tested = tested.withColumn("ratio", F.when(a <= F.col("expected"), F.lit(0.0)).when(compares, two_sided).otherwise(one_sided))
    tested = tested.withColumn("log_p", _log_p(F.col("ratio"))).withColumn("bin", F.floor(F.col("log_p") / BIN))
    # Benjamini-Hochberg: the largest bin whose upper edge is within rate * rank / tests.
    bins = tested.groupBy("bin").agg(F.count(F.lit(1)).alias("in_bin"), F.first("all_tests").alias("all_tests"))
    ranked = bins.withColumn("rank", F.sum("in_bin").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    edge = (F.col("bin") + 1) * BIN
    cut = ranked.filter(edge <= F.log(F.lit(rate) * F.col("rank") / F.col("all_tests"))).agg(F.max("bin").alias("cut"))
    kept = tested.crossJoin(F.broadcast(cut)).filter(F.col("bin") <= F.col("cut"))  # cut is one row
    return kept.select(*KEYS, "n", "expected", "ratio", "log_p")


def repeated_occurrences(records: DataFrame, min_records: int = MIN_RECORDS, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(ord, seg_no, line_no) of every occurrence of a line its source repeats in excess."""
    excess = excess_lines(records, min_records, rate).select(*KEYS)
    return occurrences(records).join(excess, list(KEYS), "left_semi").select("ord", "seg_no", "line_no")


def strip_repeated_lines(records: DataFrame, min_records: int = MIN_RECORDS, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(ord, source, review_text, removed_lines): each record's segments without the excess lines.

    The lines left keep their text and order. A segment with no line left is empty, so segment numbers hold.
    """
    gone = repeated_occurrences(records, min_records, rate).distinct().groupBy("ord").agg(F.collect_list(F.struct("seg_no", "line_no")).alias("gone"))
    base = records.select("ord", "source", "review_text").join(gone, "ord", "left").withColumn("gone", F.coalesce("gone", F.expr("array()").cast("array<struct<seg_no:int,line_no:int>>")))

    def rest(segment: Column, seg_no: Column) -> Column:
        hit = F.transform(F.filter("gone", lambda g: g["seg_no"] == seg_no), lambda g: g["line_no"])
        lines = F.filter(F.split(segment, "\n", -1), lambda _, line_no: ~F.array_contains(hit, line_no))
        return F.when(F.size(hit) == 0, segment).otherwise(F.array_join(lines, "\n"))

    return base.select("ord", "source", F.transform("review_text", rest).alias("review_text"), F.size("gone").alias("removed_lines"))
