"""The queries of the training-data operators, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtmill.llm import boilerplate, canonical, leakage, listings, mixture, neighbours, pii, sitelines, splitting, survivorship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over the limit: those the splitter cuts into a second piece."""
    items = splitting.items_of(_table(spark, sf_dir, "chunk"), _table(spark, sf_dir, "source_record"))
    pieces = splitting.split_oversized(items, ["item_kind", "item_id", "seg_no"], "item_text")
    return pieces.filter("piece_no = 1").select("item_kind", "item_id", "seg_no")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every item."""
    items = splitting.items_of(_table(spark, sf_dir, "chunk"), _table(spark, sf_dir, "source_record"))
    return splitting.split_oversized(items, ["item_kind", "item_id", "seg_no"], "item_text")


def p1_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item whether its pieces keep the limit, overlap as they should and cover it from end to end."""
    pieces = p1_pieces(spark, sf_dir).withColumn("following", F.lead("start_pos").over(Window.partitionBy("item_kind", "item_id", "seg_no").orderBy("piece_no")))
    overlap = F.col("end_pos") - F.col("following")
    fine = (F.length("piece") == F.col("end_pos") - F.col("start_pos")) & (F.length("piece") <= splitting.LIMIT) & (F.col("following").isNull() | overlap.between(0, splitting.OVERLAP + splitting.SLACK))
    each = pieces.groupBy("item_kind", "item_id", "seg_no").agg(F.max("end_pos").alias("letters"), ((F.min("start_pos") == 0) & F.min(fine)).alias("covered"))
    return each.select("item_kind", "item_id", "seg_no", F.col("letters").cast("bigint").alias("letters"), "covered")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each page's main body."""
    return boilerplate.body_lines(_table(spark, sf_dir, "fetch_result"), with_text=False).select("page_id", "line_no")


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page reduced to its main body."""
    return boilerplate.main_text(_table(spark, sf_dir, "fetch_result"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings of the same shoe."""
    return listings.matching_pairs(p3_groups(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each listing."""
    return listings.groups(_table(spark, sf_dir, "listing_record"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_values(_table(spark, sf_dir, "source_record"), _table(spark, sf_dir, "ref_value"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry each free-entered value means, or 0."""
    return _mapped(spark, sf_dir).select("ord", "field_name", "ref_id")


def p4_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean no entry, with their numbers of rows."""
    return canonical.misses(_mapped(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similarity 0.9 or more of which one is among the other's five nearest."""
    return neighbours.close_pairs(_table(spark, sf_dir, "chunk_embedding"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every usable vector."""
    return neighbours.neighbours(_table(spark, sf_dir, "chunk_embedding"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a line its source repeats in excess."""
    return sitelines.repeated_occurrences(_table(spark, sf_dir, "source_record"))


def p6_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments without those lines."""
    return sitelines.strip_repeated_lines(_table(spark, sf_dir, "source_record"))


def p6_lines_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments without those lines as one text a record."""
    rows = p6_stripped(spark, sf_dir)
    return rows.select("ord", "removed_lines", F.array_join(F.transform("review_text", lambda s: F.coalesce(s, F.lit("-"))), "\u0001").alias("left"))


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.survivors(*[_table(spark, sf_dir, t) for t in ("canonical_shoe", "source_record", "source_registry")])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row each field's surviving value comes from."""
    return survivorship.winning_rows(_survivors(spark, sf_dir))


def p7_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt fields with their provenance."""
    return survivorship.rebuilt(_survivors(spark, sf_dir))


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt fields of shoes with a record, each with the url it came from."""
    made = F.col("provenance")
    rows = p7_rebuilt(spark, sf_dir)
    values = [F.col(f).cast("double").alias(f) for f in survivorship.BOUNDS]
    return rows.select("canonical_id", "n_records", *values, *[F.try_element_at(made, F.lit(f))["url"].alias(f"{f}_url") for f in survivorship.BOUNDS])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with twelve or more consecutive words of an evaluation item."""
    return leakage.exact_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_item"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with window counts, re-parameterised items included."""
    return leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_item"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's copies in shuffled order."""
    return mixture.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_target"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    return mixture.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_target"))


def p9_report_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached when the mixture is to be as large as the stock: small sources fall short at their caps."""
    return mixture.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_target"), total_tokens="stock")


def _public(spark: SparkSession, sf_dir: str) -> frozenset[str] | DataFrame:
    return pii.public_names(_table(spark, sf_dir, "source_record").select("signature_player"), _table(spark, sf_dir, "ref_value").select("canonical_value"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of personal information."""
    return pii.mentions(_table(spark, sf_dir, "documents"), _public(spark, sf_dir)).select("doc_id", "pii_type", "start_pos")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    return pii.redacted(_table(spark, sf_dir, "documents"), _public(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p1_covered, p2_found, p2_text, p3_found, p3_groups, p4_found, p4_misses, p5_found, p5_neighbours, p6_found, p6_stripped, p6_lines_left, p7_found, p7_rebuilt, p7_values, p8_found, p8_leaks, p9_mixture, p9_report, p9_report_stock, p10_found, p10_redacted)
}

_STRIPPED = "length(trim({}, ' ' || chr(9) || chr(10) || chr(13))) > 1500"

_LINES = """WITH seg AS (SELECT ord, source, generate_subscripts(review_text, 1) - 1 AS seg_no, unnest(review_text) AS s FROM source_record),
        parts AS (SELECT ord, source, seg_no, coalesce(string_split(s, chr(10)), [NULL]) AS l FROM seg),
        lines AS (SELECT ord, source, seg_no, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS raw FROM parts),
        normal AS (SELECT ord, source, seg_no, line_no, raw, lower(trim(regexp_replace(raw, '[ \\t\\r]+', ' ', 'g'))) AS line FROM lines),
        often AS (SELECT source, line FROM normal WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT ord) >= 15)"""
_LINKED = """WITH link AS (SELECT DISTINCT canonical_id, s.source AS source, s.url AS url, s.fetched_at AS fetched_at
                      FROM (SELECT canonical_id, unnest(sources) AS s FROM canonical_shoe)),
        linked AS (SELECT l.canonical_id, r.ord, r.url, r.msrp_usd_cents, r.weight_oz, g.trust_rank,
                   CASE WHEN r.fetched_at = '' OR r.fetched_at IS NULL THEN -9e18
                        ELSE epoch_us(CAST(CASE WHEN regexp_matches(r.fetched_at, '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN r.fetched_at ELSE r.fetched_at || '+00:00' END AS TIMESTAMPTZ)) END AS stamp
                   FROM link l JOIN source_record r ON l.source = r.source AND l.url = r.url AND l.fetched_at IS NOT DISTINCT FROM r.fetched_at
                   LEFT JOIN source_registry g ON g.source = r.source)"""

ORACLE: dict[str, str] = {
    "p1_covered": """
        SELECT * FROM (SELECT 'chunk' AS item_kind, chunk_id AS item_id, CAST(0 AS INTEGER) AS seg_no, length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) AS letters, TRUE AS covered FROM chunk
        UNION ALL SELECT 'review_text', ord, CAST(pos - 1 AS INTEGER), length(trim(seg, ' ' || chr(9) || chr(10) || chr(13))), TRUE FROM (
            SELECT ord, unnest(review_text) AS seg, generate_subscripts(review_text, 1) AS pos FROM source_record)) WHERE letters > 0""",
    "p1_found": f"""
        SELECT 'chunk' AS item_kind, chunk_id AS item_id, CAST(0 AS INTEGER) AS seg_no FROM chunk WHERE {_STRIPPED.format("content")}
        UNION ALL
        SELECT 'review_text', ord, CAST(pos - 1 AS INTEGER) FROM (
            SELECT ord, unnest(review_text) AS seg, generate_subscripts(review_text, 1) AS pos FROM source_record)
        WHERE {_STRIPPED.format("seg")}""",
    "p5_found": """
        WITH e AS (SELECT id, model_id, CAST(vector AS DOUBLE[]) AS v FROM chunk_embedding
                   WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
        pairs AS (SELECT a.id AS ia, b.id AS ib, round(list_cosine_similarity(a.v, b.v), 9) AS s
                  FROM e a JOIN e b ON a.model_id IS NOT DISTINCT FROM b.model_id AND len(a.v) = len(b.v) AND a.id <> b.id),
        ranked AS (SELECT ia, ib, s, row_number() OVER (PARTITION BY ia ORDER BY s DESC, ib) AS rn FROM pairs)
        SELECT DISTINCT least(ia, ib) AS id_a, greatest(ia, ib) AS id_b FROM ranked WHERE rn <= 5 AND s >= 0.9""",
    "p6_found": f"""{_LINES}
        SELECT ord, CAST(seg_no AS INTEGER) AS seg_no, CAST(line_no AS INTEGER) AS line_no FROM normal JOIN often USING (source, line)""",
    "p6_lines_left": f"""{_LINES},
        told AS (SELECT n.*, o.line IS NOT NULL AS gone FROM normal n LEFT JOIN often o ON n.source = o.source AND n.line = o.line),
        segs AS (SELECT ord, seg_no, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), CASE WHEN count(*) FILTER (WHERE raw IS NOT NULL) > 0 THEN '' ELSE '-' END) AS t, count(*) FILTER (WHERE gone) AS n FROM told GROUP BY 1, 2),
        every AS (SELECT ord, string_agg(t, chr(1) ORDER BY seg_no) AS t, sum(n) AS n FROM segs GROUP BY 1)
        SELECT r.ord, CAST(coalesce(n, 0) AS INTEGER) AS removed_lines, CASE WHEN r.review_text IS NULL THEN NULL ELSE coalesce(t, '') END AS "left" FROM source_record r LEFT JOIN every ON every.ord = r.ord""",
    "p7_found": f"""{_LINKED},
        many AS (SELECT canonical_id FROM linked GROUP BY 1 HAVING count(*) >= 2),
        long AS (SELECT canonical_id, 'msrp_usd_cents' AS field_name, ord, trust_rank, stamp FROM linked WHERE msrp_usd_cents BETWEEN 2000 AND 60000
                 UNION ALL SELECT canonical_id, 'weight_oz', ord, trust_rank, stamp FROM linked WHERE weight_oz BETWEEN 5 AND 30)
        SELECT canonical_id, field_name, ord FROM long SEMI JOIN many USING (canonical_id)
        QUALIFY row_number() OVER (PARTITION BY canonical_id, field_name ORDER BY trust_rank, stamp DESC, ord) = 1""",
    "p7_values": f"""{_LINKED},
        p AS (SELECT canonical_id, msrp_usd_cents AS v, url FROM linked WHERE msrp_usd_cents BETWEEN 2000 AND 60000 QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY trust_rank, stamp DESC, ord) = 1),
        w AS (SELECT canonical_id, weight_oz AS v, url FROM linked WHERE weight_oz BETWEEN 5 AND 30 QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY trust_rank, stamp DESC, ord) = 1),
        n AS (SELECT canonical_id, count(*) AS n_records FROM linked GROUP BY 1)
        SELECT n.canonical_id, n_records, CAST(p.v AS DOUBLE) AS msrp_usd_cents, CAST(w.v AS DOUBLE) AS weight_oz, p.url AS msrp_usd_cents_url, w.url AS weight_oz_url
        FROM n LEFT JOIN p ON p.canonical_id = n.canonical_id LEFT JOIN w ON w.canonical_id = n.canonical_id""",
    "p8_found": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN\\pM]+') AS w FROM documents),
        dw AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\pL\\pN\\pM]+') AS w FROM eval_item),
        ew AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (win)""",
}
