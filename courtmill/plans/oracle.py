"""The SQL of the core queries, for an engine of the other kind to check them by."""

from __future__ import annotations

from courtmill.functions import naming, text, vocab
from courtmill.operators import report
from courtmill.plans import queries as q
from courtmill.schemas import MERGEABLE, MERGEABLE_NAMES, METADATA_FIELDS, SPEC_FIELDS, TAGS

#: White space as Unicode has it; the other engine's \s is ASCII only.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _lit(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _in_order(words: dict[str, list[str]]) -> list[tuple[str, str]]:
    return sorted(((a, b) for b, aliases in words.items() for a in aliases), key=lambda p: -len(p[0]))


def _brand(x: str, brands: dict[str, list[str]]) -> str:
    low = f"lower({_strip(x)})"
    return "CASE " + " ".join(f"WHEN {low} = {_lit(a.strip())} OR starts_with({low}, {_lit(a)}) THEN {_lit(b)}" for a, b in _in_order(brands)) + " END"


def _split(x: str, brands: dict[str, list[str]]) -> tuple[str, str]:
    whole = _strip(x)
    low = f"lower({whole})"
    first = "CASE " + " ".join(f"WHEN starts_with({low}, {_lit(a.strip() + ' ')}) THEN {_lit(b)}" for a, b in _in_order(brands)) + " END"
    rest = "CASE " + " ".join(f"WHEN starts_with({low}, {_lit(a.strip() + ' ')}) THEN {whole if a.strip() in naming.KEPT_LINES else _strip(f'substr({whole}, {len(a.strip()) + 1})')}" for a, _ in _in_order(brands)) + f" ELSE {whole} END"
    return first, rest


def _map(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_lit(k)}: {_lit(v)}" for k, v in d.items()) + "}"


def _key(brand: str, model: str, brands: dict[str, list[str]]) -> str:
    s = f"replace(lower({model}), '&', ' and ')"
    for old, new in naming.REWRITTEN:
        s = f"replace({s}, {_lit(old)}, {_lit(new)})"
    for _ in range(2):
        s = rf"regexp_replace({s}, '([a-z0-9])\.(\d)', '\1 \2', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '[.''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')"
    own = "CASE " + " ".join(f"WHEN {brand} = {_lit(b)} THEN [{', '.join(_lit(w) for a in aliases for w in a.split())}]" for b, aliases in brands.items()) + " ELSE [] END"
    kept = f"list_filter(string_split(trim({s}), ' '), lambda t: t <> '' AND NOT list_contains({own}, t) AND t NOT IN ({', '.join(_lit(w) for w in naming.DROPPED)}))"
    plain = r"regexp_replace(t, '^v(\d+)$', '\1')"
    roman = f"coalesce({_map(naming.ROMAN)}[{plain}], {plain})"
    return f"array_to_string(list_transform({kept}, lambda t: coalesce({_map(naming.RESPELT)}[{roman}], {roman})), ' ')"


def _version(model: str) -> str:
    return rf"nullif(regexp_extract({_key('NULL', model, {'': []})}, '(\d+(?:\.\d+)?)\s*$', 1), '')"


def _signature(key: str) -> str:
    return rf"array_to_string(list_filter(string_split({key}, ' '), lambda t: regexp_matches(t, '^\d+(\.\d+)?$')), ' ')"


def _slug(*parts: str) -> str:
    return f"regexp_replace(regexp_replace(lower(concat_ws(' ', {', '.join(f'nullif({p}, {_lit("")})' for p in parts)})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


_NUM = r"(\d+(?:\.\d+)?)"


def _num(x: str, pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '{pattern}', 1), '') AS DOUBLE)"


_OZ, _G = _num("t", rf"(?i){_NUM}\s*oz"), _num("t", rf"(?i){_NUM}\s*g(?:rams)?\b")
_GRAMS = f"CASE WHEN {_OZ} IS NOT NULL THEN round_even({_OZ} / 0.03527396, 1) ELSE {_G} END"


def _contains(x: str, *rules: tuple[tuple[str, ...], str]) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({x}), {_lit(w)})' for w in words)} THEN {_lit(r)}" for words, r in rules) + " END"


_CUT = _contains("t", (("low",), "low"), (("mid",), "mid"), (("high",), "high"))
_WIDTH = _contains("t", (("narrow",), "narrow"), (("wide",), "wide"), (("standard", "medium", "normal", "true"), "standard"))
_OUTDOOR = _contains("t", (("good", "great", "excellent"), "good"), (("fair", "average", "decent", "ok"), "fair"), (("bad", "poor", "avoid"), "bad"))
_SOFT = "regexp_matches(lower(t), 'slight|half|bit')"
_LENGTH = f"""CASE WHEN contains(lower(t), 'true to size') OR lower(t) IN ('tts', 'true') THEN 'true_to_size'
    WHEN regexp_matches(lower(t), 'small|short|size up') THEN CASE WHEN {_SOFT} THEN 'slightly_small' ELSE 'runs_small' END
    WHEN regexp_matches(lower(t), 'large|big|long|size down') THEN CASE WHEN {_SOFT} THEN 'slightly_large' ELSE 'runs_large' END END"""
_SURFACE = """CASE WHEN contains(lower(t), 'outdoor') AND NOT contains(lower(t), 'indoor') THEN 'good' WHEN contains(lower(t), 'outdoor') THEN 'fair'
    WHEN contains(lower(t), 'indoor') THEN 'bad' END"""


def _tags(mapping: dict[str, str]) -> str:
    parts = "regexp_split_to_array(lower(t), '[/,;+&]| and ')"
    found = f"list_filter(list_transform({parts}, lambda p: {_map(mapping)}[{_strip('p')}]), lambda x: x IS NOT NULL)"
    once = f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"
    return f"array_to_string({once}, ',')"


def _tags_in(x: str) -> str:
    by_tag: dict[str, list[str]] = {}
    for word, tag in [*vocab.POSITIONS.items(), *vocab.PLAYSTYLES.items()]:
        if len(word) > 1:
            by_tag.setdefault(tag, []).append(word)
    edge = r"[^\pL\pN\pM_]"
    hits = ", ".join(f"CASE WHEN regexp_matches(lower({x}), '(^|{edge})({'|'.join(ws)})($|{edge})') THEN {_lit(tag)} END" for tag, ws in sorted(by_tag.items()))
    return f"list_filter([{hits}], lambda v: v IS NOT NULL)"


def _advertising(x: str) -> str:
    for p in text.ADVERTISING:
        x = f"regexp_replace({x}, {_lit(p)}, '', 'g')"
    return _strip(rf"regexp_replace({x}, '{WS}{{2,}}', ' ', 'g')")


_ONE_LINE = _strip(f"regexp_replace(text, '{WS}+', ' ', 'g')")
_F = "lower(brand) = 'veltrix' AND price <= 170.00"
_PRICE = "CAST(price AS DOUBLE) AS price"
_COS = "1 - list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u)))"
_REQUESTS = f"""(SELECT request_id, playstyle, aesthetic, budget, nullif(brand, '') AS brand, nullif(outdoor, '') AS outdoor, nullif(playstyle_tag, '') AS playstyle_tag, nullif(cut, '') AS cut, nullif(width, '') AS width,
    nullif(position, '') AS position FROM (VALUES {', '.join(f"(CAST({r[0]} AS BIGINT), CAST({_lit(r[1])} AS VARCHAR), CAST({_lit(r[2])} AS VARCHAR), CAST({_lit(r[3])} AS DOUBLE), {', '.join(f'CAST({_lit(x)} AS VARCHAR)' for x in r[4:])})" for r in q.REQUESTS)})
    AS v(request_id, playstyle, aesthetic, budget, brand, outdoor, playstyle_tag, cut, width, position)) AS r"""
_MEETS = """(r.budget IS NULL OR CAST(s.price AS DOUBLE) <= r.budget) AND (r.brand IS NULL OR lower(s.brand) = lower(r.brand)) AND (r.outdoor IS NULL OR s.specs.outdoor_suitability = r.outdoor)
    AND (r.playstyle_tag IS NULL OR list_contains(s.specs.playstyle_tags, r.playstyle_tag)) AND (r.cut IS NULL OR s.specs.cut_height = r.cut) AND (r.width IS NULL OR s.specs.width_fit = r.width)
    AND (r.position IS NULL OR list_contains(s.specs.position_tags, r.position))"""


def _by_tags(limit: int) -> str:
    return f"""SELECT request_id, shoe_id, CAST(overlap AS INTEGER) AS overlap, CAST(rn AS INTEGER) AS rn FROM (
        SELECT request_id, id AS shoe_id, overlap, row_number() OVER (PARTITION BY request_id ORDER BY overlap DESC, id) AS rn FROM (
            SELECT r.request_id, s.id, len(list_intersect(list_distinct(list_concat(coalesce(s.specs.playstyle_tags, []), coalesce(s.specs.position_tags, []))), {_tags_in("coalesce(r.playstyle, '')")})) AS overlap
            FROM {_REQUESTS} JOIN shoes s ON {_MEETS})) WHERE rn <= {limit}"""


_SEARCH = f"""WITH one AS (SELECT CAST(vector AS DOUBLE[]) AS u FROM chunk_embedding WHERE model_id = '{q.MODEL}' AND len(list_filter(vector, lambda x: x <> 0)) > 0 ORDER BY id LIMIT 1),
    scored AS (SELECT e.shoe_id, e.id, e.source, CAST(e.vector AS DOUBLE[]) AS v, u FROM chunk_embedding e JOIN shoes s ON s.id = e.shoe_id, one
        WHERE e.model_id = '{q.MODEL}' AND s.price <= 200.00 AND len(list_filter(e.vector, lambda x: x <> 0)) > 0 AND len(e.vector) = len(u)),
    cut AS (SELECT shoe_id, id, source, round({_COS}, 6) AS distance FROM scored ORDER BY distance, id LIMIT 120),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY shoe_id ORDER BY distance, id) AS rn FROM cut)"""

_RETRIEVED = f"""WITH r AS (SELECT id AS request_id, CAST(vector AS DOUBLE[]) AS u, CASE WHEN id % 100 = 0 THEN 150.0 END AS budget, CASE WHEN id % 150 = 0 THEN 'low' END AS cut, CASE WHEN id % 250 = 0 THEN 'Kordane' END AS brand,
        CASE WHEN id % 350 = 0 THEN 'guard' END AS position, NULL AS outdoor, NULL AS playstyle_tag, NULL AS width FROM chunk_embedding WHERE model_id = '{q.MODEL}' AND id % 50 = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
    e AS (SELECT id, shoe_id, source, CAST(vector AS DOUBLE[]) AS v FROM chunk_embedding WHERE model_id = '{q.MODEL}' AND len(list_filter(vector, lambda x: x <> 0)) > 0),
    scored AS (SELECT r.request_id, e.shoe_id, e.id, e.source, round(1 - list_cosine_similarity(e.v, r.u), 6) AS distance FROM r JOIN e ON len(e.v) = len(r.u) JOIN shoes s ON s.id = e.shoe_id AND {_MEETS}),
    cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY distance, id) <= 120),
    hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id, shoe_id ORDER BY distance, id) AS INTEGER) AS rn FROM cut QUALIFY row_number() OVER (PARTITION BY request_id, shoe_id ORDER BY distance, id) <= 3)"""

_SPACED = "replace(CAST({} AS VARCHAR), '_', ' ')"


def _summary() -> str:
    filled = [f"{_lit(t.split('%s')[0])} || {_SPACED.format('specs.' + f)} || {_lit(t.split('%s')[1])}" for f, t in text.SUMMARY]
    return f"""concat_ws('. ', concat_ws(' ', brand, name), 'signature shoe of ' || nullif(specs.signature_player, ''), 'released ' || CAST(nullif(specs.release_year, 0) AS VARCHAR),
        {', '.join(filled)}, CASE WHEN len(specs.position_tags) > 0 THEN 'positions: ' || array_to_string(specs.position_tags, ', ') END,
        CASE WHEN len(specs.playstyle_tags) > 0 THEN 'playstyles: ' || array_to_string(specs.playstyle_tags, ', ') END,
        'price: $' || CAST(CAST(round_even(price, 0) AS BIGINT) AS VARCHAR)) || '.'"""


def _chips() -> str:
    single = ", ".join(f"{_lit(t.split('%s')[0])} || {_SPACED.format(f'nullif(specs.{f}, {_lit("")})')} || {_lit(t.split('%s')[1])}" for f, t in text.CHIPS)
    spaced = "list_transform(coalesce(specs.{}, []), lambda t: replace(t, '_', ' '))"
    return f"array_to_string(list_concat({spaced.format('playstyle_tags')}, {spaced.format('position_tags')}, list_filter([{single}], lambda x: x IS NOT NULL))[1:6], '; ')"


def _explanation() -> str:
    note = "extra_metadata.pros[1].text"
    line = _strip(f"regexp_replace({note}, '{WS}+', ' ', 'g')")
    short = f"CASE WHEN length({line}) > 180 THEN regexp_replace(substr({line}, 1, 179), '{WS}+$', '') || '…' ELSE {line} END"
    details = "concat_ws(', ', replace(nullif(specs.cut_height, ''), '_', ' ') || ' cut', nullif(specs.cushioning_tech, '') || ' cushioning', 'outdoor suitability rated ' || nullif(specs.outdoor_suitability, ''))"
    return f"""'The ' || concat_ws(' ', brand, name) || ' fits a slasher player' || CASE WHEN {details} <> '' THEN ' with ' || {details} ELSE '' END || '.'
        || coalesce(' ' || coalesce(nullif(extra_metadata.pros[1].source, '') || ' notes: ', 'From the specs: ') || '"' || ({short}) || '"', '')"""


_PARTS = _split("model_raw", q.OWN_BRANDS)
_FOUND = f"coalesce(nullif(brand, ''), {_PARTS[0]})"
_READY = f"""keyed0 AS (SELECT r.*, coalesce({_brand(_FOUND, q.OWN_BRANDS)}, {_FOUND}) AS b, coalesce(nullif(model, ''), {_PARTS[1]}) AS m FROM source_record r),
    ready AS (SELECT k.*, {_key('b', 'm', q.OWN_BRANDS)} AS model_key, coalesce(g.trust_rank, 2147483647) AS priority FROM keyed0 k LEFT JOIN source_registry g ON g.source = k.source)"""
_FIRST = "arg_min({0}, priority * 100000000000::HUGEINT + ord) FILTER (WHERE {1} IS NOT NULL)"

_LEN = "CASE WHEN {0} IS NULL THEN 0 ELSE {1}({0}) END > 0"


def _filled(f: str) -> str:
    return _LEN.format(f, "cardinality") if f == "metrics" else _LEN.format(f, "len") if f in (*TAGS, *report.CONTAINERS) else f"{f} IS NOT NULL"


_FILL = " UNION ALL ".join(
    f"SELECT {_lit(f)} AS field, count(*) FILTER (WHERE {_filled(f)}) AS filled, {'CAST(NULL AS DOUBLE)' if f in report.CONTAINERS else f'CASE WHEN count(*) > 0 THEN round_even(100.0 * count(*) FILTER (WHERE {_filled(f)}) / count(*), 1) ELSE 0.0 END'} AS percent FROM canonical_shoe"
    for f in (*MERGEABLE_NAMES, *TAGS, *report.CONTAINERS)
)

_SORTED = "CAST(list_sort(map_entries({})) AS VARCHAR)"
_NESTED = "CAST(list_sort(list_transform(map_entries({}), lambda e: (e.key, list_sort(map_entries(e.value))))) AS VARCHAR)"


def _printed(specs: str, meta: str) -> str:
    """All nested values of a catalogue row as one text, entries of maps in order."""
    flat = [f"CAST({meta.format(f)} AS VARCHAR)" for f in METADATA_FIELDS if f not in ("metrics", "provenance")]
    return f"[CAST({specs} AS VARCHAR), {_NESTED.format(meta.format('metrics'))}, {_SORTED.format(meta.format('provenance'))}, {', '.join(flat)}]"


_OWN_SPECS = "struct_pack(" + ", ".join(f"{f} := {f}" for f in SPEC_FIELDS) + ")"
_UPSERT = f"""old AS (SELECT id, canonical_id AS old_id, [brand, name, CAST(price AS VARCHAR), currency, image_url, affiliate_url, source_url] || {_printed("specs", "extra_metadata.{}")} AS o FROM shoes),
    new AS (SELECT canonical_id AS new_id, brand, model AS name, CAST(msrp_usd_cents / 100.0 AS DECIMAL(10,2)) AS price, 'USD' AS currency, image_urls[1] AS image_url, affiliate_url, sources[1].url AS source_url, {_OWN_SPECS} AS specs,
        pros, cons, review_text, image_urls, sources, provenance, metrics FROM canonical_shoe),
    told AS (SELECT *, [brand, name, CAST(price AS VARCHAR), currency, image_url, affiliate_url, source_url] || {_printed("specs", "{}")} AS n FROM new),
    acted AS (SELECT coalesce(new_id, old_id) AS canonical_id, id, CASE WHEN new_id IS NULL THEN 'delete' WHEN id IS NULL THEN 'insert' WHEN o IS NOT DISTINCT FROM n THEN 'unchanged' ELSE 'update' END AS action
        FROM old FULL OUTER JOIN told ON old_id = new_id)"""

_SYNC = f"""o AS (SELECT id, shoe_id, content, source, model_id, row_number() OVER (PARTITION BY shoe_id, content, source, model_id ORDER BY id) AS rn FROM chunk_embedding),
    d AS (SELECT DISTINCT shoe_id, content, source FROM chunk),
    kept AS (SELECT o.id, d.shoe_id FROM o JOIN d ON o.shoe_id = d.shoe_id AND o.content IS NOT DISTINCT FROM d.content AND o.source IS NOT DISTINCT FROM d.source
        WHERE o.model_id = '{q.MODEL}' AND o.rn = 1),
    missing AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.shoe_id = d.shoe_id AND o.content IS NOT DISTINCT FROM d.content AND o.source IS NOT DISTINCT FROM d.source
        AND o.model_id = '{q.MODEL}' AND o.rn = 1)),
    acts AS (SELECT id, shoe_id, 'keep' AS action FROM kept UNION ALL SELECT NULL, shoe_id, 'embed' FROM missing
        UNION ALL SELECT id, shoe_id, 'delete' FROM o WHERE id NOT IN (SELECT id FROM kept))"""


def _opinions(field: str) -> str:
    return f"""SELECT id AS shoe_id, brand || ' ' || name AS title, '{field}' AS kind, n.source AS s, {_strip("n.text")} AS note, pos FROM
        (SELECT id, brand, name, unnest(extra_metadata.{field}) AS n, generate_subscripts(extra_metadata.{field}, 1) AS pos FROM shoes)"""


ORACLE: dict[str, str] = {
    "browse_page": f"SELECT id, brand, name, {_PRICE} FROM (SELECT * FROM shoes WHERE {_F} ORDER BY price NULLS LAST, name, id LIMIT 20 OFFSET 5)",
    "browse_total": f"SELECT count(*) AS total FROM shoes WHERE {_F}",
    "browse_filters": """SELECT id, brand, name FROM shoes WHERE specs.outdoor_suitability = 'good' AND specs.cut_height = 'low' AND specs.width_fit = 'standard'
        AND list_contains(specs.playstyle_tags, 'slasher') AND list_contains(specs.position_tags, 'guard') AND price >= 80.00""",
    "enum_filter": "SELECT id, name FROM shoes WHERE specs.cut_height = 'mid' AND specs.width_fit = 'wide'",
    "tag_contains": "SELECT id FROM shoes WHERE list_contains(specs.playstyle_tags, 'shooter')",
    "json_scalar_filter": "SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') = '7'",
    "point_lookup": "SELECT id, canonical_id, name FROM shoes WHERE id = 7",
    "shoes_of_ids": "SELECT id, name FROM shoes WHERE id IN (SELECT shoe_id FROM chunk_embedding WHERE model_id = 'hoopvec-s0')",
    "dearest_first": f"SELECT id, {_PRICE} FROM shoes WHERE lower(brand) = 'kordane'",
    "catalog_summary": f"""SELECT id, canonical_id, brand, name, {_PRICE}, currency, image_url, affiliate_url, specs.version AS version, CAST(specs.release_year AS DOUBLE) AS release_year,
        specs.cut_height AS cut_height, specs.width_fit AS width_fit, specs.cushioning_tech AS cushioning_tech, specs.outdoor_suitability AS outdoor_suitability, specs.weight_oz AS weight_oz,
        array_to_string(coalesce(specs.position_tags, []), ',') AS positions, array_to_string(coalesce(specs.playstyle_tags, []), ',') AS playstyles FROM shoes""",
    "catalog_detail": "SELECT id, name, source_url, specs.traction_pattern AS traction, CAST(len(extra_metadata.sources) AS INTEGER) AS n_sources, CAST(updated_at AS VARCHAR) AS updated_at FROM shoes",
    "catalog_columns": """SELECT canonical_id, brand, model AS name, CAST(CAST(msrp_usd_cents / 100.0 AS DECIMAL(10,2)) AS DOUBLE) AS price, image_urls[1] AS image_url, sources[1].url AS source_url,
        version, CAST(len(pros) AS INTEGER) AS n_pros FROM canonical_shoe""",
    "vector_topk": f"""WITH one AS (SELECT CAST(embedding AS DOUBLE[]) AS u FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1),
        s AS (SELECT vec_id, round({_COS}, 6) AS distance FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, u FROM embeddings, one) ORDER BY distance, vec_id LIMIT 25)
        SELECT vec_id, distance + 0.0 AS distance, round(greatest(0.0, 1 - distance), 6) AS similarity FROM s""",
    "vector_entity_search": f"{_SEARCH} SELECT shoe_id, id, source, distance + 0.0 AS distance, CAST(rn AS INTEGER) AS rn FROM ranked WHERE rn <= 3",
    "vector_candidates": f"""{_SEARCH}, best AS (SELECT shoe_id, min(distance) AS distance, CAST(count(*) AS INTEGER) AS n_snippets, arg_min(coalesce(source, chr(1)), rn) AS fs FROM ranked WHERE rn <= 3 GROUP BY 1 ORDER BY 2, 1 LIMIT 10)
        SELECT b.shoe_id, s.brand, s.name, b.distance + 0.0 AS distance, round(greatest(0.0, 1 - b.distance), 6) AS similarity, b.n_snippets, nullif(fs, chr(1)) AS first_source FROM best b JOIN shoes s ON s.id = b.shoe_id""",
    "fallback_rank": _by_tags(10),
    "request_validation": "SELECT ord AS request_id FROM source_record WHERE drop_mm IS NOT NULL OR trim(coalesce(cushioning_tech, '')) <> '' OR trim(coalesce(traction_pattern, '')) <> '' OR coalesce(cut_height, '') <> ''",
    "retrieve_hits": f"{_RETRIEVED} SELECT request_id, shoe_id, id, distance + 0.0 AS distance, rn FROM hits",
    "retrieve_candidates": f"""{_RETRIEVED} SELECT request_id, shoe_id, min(distance) + 0.0 AS distance, round(greatest(0.0, 1 - min(distance)), 6) AS similarity, string_agg(coalesce(source, '-'), ',' ORDER BY rn) AS sources
        FROM hits GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY min(distance), shoe_id) <= 10""",
    "request_seed": """SELECT event_id AS request_id, CAST(CAST('0x' || substr(sha256('{"aesthetic":' || coalesce(CAST(to_json(props) AS VARCHAR), 'null') || ',"brand":null,"budget":' || coalesce(CAST(value AS VARCHAR), 'null')
        || ',"cut":null,"outdoor":null,"playstyle":' || coalesce(CAST(to_json(event_type) AS VARCHAR), 'null') || ',"playstyle_tag":null,"position":null,"width":null}'), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM events""",
    "topn_tie_groups": f"""WITH k AS ({_by_tags(20)}) SELECT request_id, shoe_id, CAST(overlap AS DOUBLE) AS rank_key, CAST(dense_rank() OVER (PARTITION BY request_id ORDER BY overlap DESC) AS INTEGER) AS tie_group,
        count(*) OVER (PARTITION BY request_id, overlap) AS group_size, CAST(rank() OVER (PARTITION BY request_id ORDER BY overlap DESC) - 1 AS INTEGER) AS before FROM k""",
    "template_card": f"SELECT id, {_chips()} AS chips, {_explanation()} AS explanation FROM shoes",
    "query_text": f"""SELECT ord, coalesce(nullif(concat_ws(' ', 'Basketball shoe for a ' || nullif({_strip("cut_height")}, '') || ' player.', 'Style and look: ' || nullif({_strip("cushioning_tech")}, '') || '.'), ''),
        'Basketball shoe recommendation.') AS query_text FROM source_record""",
    "request_words": f"SELECT ord, concat_ws(' — ', nullif(cut_height, ''), nullif(array_to_string(playstyle_tags, ', '), ''), nullif({_strip('cushioning_tech')}, '')) AS playstyle FROM source_record",
    "unit_parse": f"""SELECT ord, coalesce({_OZ}, round_even({_G} * 0.03527396, 2)) AS oz, {_GRAMS} AS g,
        coalesce({_num("t", rf"(?i){_NUM}\s*mm")}, {_num("t", rf"^\s*{_NUM}\s*$")}) AS mm, round_even({_num("t", _NUM)} * 100, 0) AS cents,
        CASE WHEN t LIKE '%+' THEN NULL ELSE TRY_CAST(nullif(regexp_replace(t, '\\D', '', 'g'), '') AS DOUBLE) END AS budget FROM (SELECT ord, model_raw AS t FROM listing_record)""",
    "weights_of_records": f"SELECT ord, {_GRAMS} AS g, CAST(CAST(msrp_usd_cents / 100.0 AS DECIMAL(10,2)) AS DOUBLE) AS price FROM (SELECT *, CAST(weight_oz AS VARCHAR) || ' oz' AS t FROM source_record)",
    "enum_map": f"SELECT ord, field, {_CUT} AS cut, {_WIDTH} AS width, {_LENGTH} AS length, {_OUTDOOR} AS outdoor, {_SURFACE} AS surface FROM ({' UNION ALL '.join(f"SELECT ord, '{f}' AS field, {f} AS t FROM source_record" for f in ('cut_height', 'width_fit', 'length_fit', 'outdoor_suitability', 'cushioning_tech', 'traction_pattern'))})",
    "tag_map": f"SELECT ord, {_tags(vocab.POSITIONS)} AS positions, {_tags(vocab.PLAYSTYLES)} AS playstyles FROM (SELECT ord, array_to_string(list_concat(coalesce(position_tags, []), coalesce(playstyle_tags, [])), ' and ') AS t FROM source_record)",
    "tags_in_documents": f"SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE array_to_string({_tags_in('text')}, ',') END AS tags FROM documents",
    "score_thresholds": """WITH s AS (SELECT ord, unnest(map_entries(scores)) AS e FROM source_record), v AS (SELECT ord, e.key AS key, e.value AS value, TRY_CAST(replace(e.value, '%', '') AS DOUBLE) AS x FROM s)
        SELECT ord, key, CASE WHEN x IS NULL OR x = 0 THEN NULL WHEN x >= 75 THEN 'good' WHEN x >= 55 THEN 'fair' ELSE 'bad' END AS by_score,
        CASE WHEN value NOT LIKE '%\\%' ESCAPE '\\' THEN NULL WHEN x >= 80 THEN 'good' WHEN x >= 55 THEN 'fair' WHEN x IS NOT NULL THEN 'bad' END AS by_percent FROM v""",
    "brand_split": f"SELECT ord, {_PARTS[0]} AS brand, {_PARTS[1]} AS model FROM source_record",
    "brand_normalized": f"SELECT ord, {_brand('brand', q.OWN_BRANDS)} AS brand FROM source_record",
    "model_key": f"""WITH p AS (SELECT ord, model_raw AS t, {_split("model_raw", naming.BRANDS)[0]} AS b, {_split("model_raw", naming.BRANDS)[1]} AS m FROM source_record)
        SELECT ord, {_key("b", "m", naming.BRANDS)} AS model_key, {_version("t")} AS version, {_signature(_key("NULL", "t", {"": []}))} AS signature, {_slug("b", "m")} AS slug FROM p""",
    "version_signature": f"WITH {_READY} SELECT ord, model_key, {_version('m')} AS version, {_signature('model_key')} AS signature FROM ready",
    "boilerplate_strip": f"SELECT doc_id, {_advertising('text')} AS text FROM documents",
    "text_shorten": f"SELECT doc_id, CASE WHEN length({_ONE_LINE}) > 180 THEN regexp_replace(substr({_ONE_LINE}, 1, 179), '{WS}+$', '') || '…' ELSE {_ONE_LINE} END AS short FROM documents",
    "union_sources": """SELECT source, ord, model_raw, brand, weight_oz, CAST(len(review_text) AS DOUBLE) AS n_segments FROM source_record
        UNION ALL SELECT source, ord, model_raw, brand, weight_oz, NULL FROM listing_record""",
    "unmatched_records": f"WITH {_READY} SELECT ord, source, url, model_raw, 'no recognizable brand' AS reason FROM ready WHERE b IS NULL",
    "entity_merge": f"""WITH {_READY}, merged AS (SELECT b AS brand, model_key, count(*) AS n_records, count(DISTINCT source) AS n_sources,
            {", ".join((f"CAST({_FIRST.format(f, f)} AS DOUBLE)" if k in ("int", "double") else _FIRST.format(f, f)) + f" AS {f}" for f, k in MERGEABLE)},
            {", ".join(_FIRST.format("url", f) + f" AS {f}_url" for f, _ in MERGEABLE)} FROM ready WHERE b IS NOT NULL GROUP BY ALL)
        SELECT *, {_slug("brand", "model_key")} AS canonical_id FROM merged""",
    "entity_lists": f"""WITH {_READY}, own AS (SELECT *, row_number() OVER (PARTITION BY b, model_key ORDER BY priority, ord) AS rn FROM ready WHERE b IS NOT NULL),
        p AS (SELECT b, model_key, string_agg(coalesce(source, '') || ':' || t, '|' ORDER BY rn, i) AS pros FROM (SELECT b, model_key, source, rn, unnest(pros) AS t, generate_subscripts(pros, 1) AS i FROM own) GROUP BY 1, 2),
        pos AS (SELECT b, model_key, string_agg(t, ',' ORDER BY place) AS positions FROM (SELECT b, model_key, t, min(rn * 1000 + i) AS place FROM
            (SELECT b, model_key, rn, unnest(position_tags) AS t, generate_subscripts(position_tags, 1) AS i FROM own) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        im AS (SELECT b, model_key, count(DISTINCT t) AS n_images FROM (SELECT b, model_key, unnest(image_urls) AS t FROM own) GROUP BY 1, 2)
        SELECT o.b AS brand, o.model_key, CAST(o.n AS INTEGER) AS n, coalesce(p.pros, '') AS pros, coalesce(pos.positions, '') AS positions, CAST(coalesce(im.n_images, 0) AS INTEGER) AS n_images, CAST(o.r AS INTEGER) AS n_reviews
        FROM (SELECT b, model_key, count(*) AS n, sum(coalesce(len(review_text), 0)) AS r FROM own GROUP BY 1, 2) o LEFT JOIN p USING (b, model_key) LEFT JOIN pos USING (b, model_key) LEFT JOIN im USING (b, model_key)""",
    "canonical_values": f"""WITH {_READY}, own AS (SELECT *, row_number() OVER (PARTITION BY b, model_key ORDER BY priority, ord) AS rn FROM ready WHERE b IS NOT NULL),
        im AS (SELECT b, model_key, string_agg(t, '|' ORDER BY place) AS images FROM (SELECT b, model_key, t, min(rn * 1000 + i) AS place FROM
            (SELECT b, model_key, rn, unnest(image_urls) AS t, generate_subscripts(image_urls, 1) AS i FROM own) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        g AS (SELECT b, model_key, arg_min(coalesce(m, model_raw), rn) AS model, count(*) AS n_records, string_agg(url, '|' ORDER BY rn) AS urls,
            array_to_string(list_sort(coalesce(list_distinct(list(source) FILTER (WHERE cardinality(scores) > 0)), [])), ',') AS measured,
            array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN count({f}) > 0 THEN '{f}' END" for f in MERGEABLE_NAMES)}], lambda x: x IS NOT NULL)), ',') AS proven FROM own GROUP BY 1, 2)
        SELECT {_slug("g.b", "g.model_key")} AS canonical_id, g.b AS brand, g.model_key, model, n_records, urls, measured, proven, coalesce(images, '') AS images FROM g LEFT JOIN im ON im.b = g.b AND im.model_key = g.model_key""",
    "latest_requests": "SELECT user_id, event_id, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "fetch_schedule": "SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(DISTINCT url) AS fetches, TRUE AS spaced FROM fetch_result GROUP BY 1",
    "entity_metrics": f"""WITH {_READY} SELECT b AS brand, model_key, source, CAST(cardinality(arg_max(scores, ord)) AS INTEGER) AS n_scores FROM ready
        WHERE b IS NOT NULL AND cardinality(scores) > 0 GROUP BY ALL""",
    "seed_follow": f"WITH {_READY} SELECT ord, model_key FROM ready WHERE source = 'tractvale' AND model_key IN (SELECT model_key FROM ready WHERE source = 'rimvale')",
    "records_by_source": "SELECT source, count(*) AS records FROM source_record GROUP BY 1",
    "source_histogram": "SELECT CAST(len(list_distinct(list_transform(sources, lambda s: s.source))) AS INTEGER) AS n_sources, count(*) AS shoes FROM canonical_shoe GROUP BY 1",
    "multi_source": "SELECT count(*) FILTER (WHERE len(list_distinct(list_transform(sources, lambda s: s.source))) >= 2) AS multi_source, count(*) AS shoes FROM canonical_shoe",
    "coverage_report": _FILL,
    "report_counts": f"""WITH {_READY} SELECT 'records' AS what, count(*) AS n FROM ready UNION ALL SELECT 'unmatched', count(*) FROM ready WHERE b IS NULL
        UNION ALL SELECT 'canonical', count(*) FROM canonical_shoe""",
    "pilot_shoes": f"""SELECT canonical_id, CAST(len(list_distinct(list_transform(sources, lambda s: s.source))) AS INTEGER) AS n_sources, CAST({" + ".join(f"({f} IS NOT NULL)::INTEGER" for f in MERGEABLE_NAMES)} AS INTEGER) AS filled
        FROM canonical_shoe ORDER BY 2 DESC, 3 DESC, 1 LIMIT 30""",
    "upsert_actions": f"WITH {_UPSERT} SELECT canonical_id, CAST(id AS DOUBLE) AS id, action FROM acted",
    "upsert_counters": f"WITH {_UPSERT} SELECT {', '.join(f'count(*) FILTER (WHERE action = {_lit(a)}) AS {n}' for a, n in (('insert', 'inserted'), ('update', 'updated'), ('delete', 'deleted'), ('unchanged', 'unchanged')))} FROM acted",
    "upsert_snapshot": f"""WITH {_UPSERT} SELECT CAST(a.id AS DOUBLE) AS id, a.canonical_id AS canonical_id, new.brand, new.name, CAST(new.price AS DOUBLE) AS price, new.currency, new.image_url, new.affiliate_url, new.source_url,
        {", ".join((f"CAST(new.specs.{f} AS DOUBLE)" if f in ("release_year", "weight_oz", "weight_g", "drop_mm", "stack_heel_mm", "stack_forefoot_mm") else f"new.specs.{f}") + f" AS {f}" for f in SPEC_FIELDS if f not in TAGS)},
        {", ".join(f"array_to_string(new.specs.{t}, ',') AS {t}" for t in TAGS)},
        {", ".join(f"array_to_string(list_transform(new.{f}, lambda n: concat_ws(':', n.source, n.text)), '|') AS {f}" for f in ("pros", "cons", "review_text"))},
        array_to_string(new.image_urls, '|') AS image_urls, array_to_string(list_transform(new.sources, lambda x: x.url), '|') AS urls, array_to_string(list_sort(map_keys(new.provenance)), ',') AS proven,
        array_to_string(list_sort(map_keys(new.metrics)), ',') AS measured, CAST(coalesce(s.created_at, TIMESTAMP '2027-01-01 00:00:00') AS VARCHAR) AS created_at,
        CAST(CASE WHEN action = 'unchanged' THEN s.updated_at ELSE TIMESTAMP '2027-01-01 00:00:00' END AS VARCHAR) AS updated_at
        FROM acted a JOIN new ON a.canonical_id = new.new_id LEFT JOIN shoes s ON s.id = a.id WHERE action <> 'delete'""",
    "upsert_new_ids": f"""WITH {_UPSERT} SELECT count(*) AS shoes, count(*) AS ids, (SELECT max(id) FROM acted) + count(*) FILTER (WHERE action = 'insert') AS top_id FROM acted WHERE action <> 'delete'""",
    "orphan_cleanup": "SELECT id, shoe_id FROM chunk_embedding WHERE shoe_id IN (SELECT id FROM shoes WHERE canonical_id IS NOT NULL)",
    "spec_summary": f"SELECT id AS shoe_id, {_summary()} AS content FROM shoes",
    "chunk_opinions": f"""WITH notes AS ({_opinions("pros")} UNION ALL {_opinions("cons")}), n AS (SELECT shoe_id, title, coalesce(nullif(s, ''), 'unknown') AS source,
            string_agg(note, '; ' ORDER BY pos) FILTER (WHERE kind = 'pros') AS pros, string_agg(note, '; ' ORDER BY pos) FILTER (WHERE kind = 'cons') AS cons FROM notes WHERE coalesce(note, '') <> '' GROUP BY ALL)
        SELECT shoe_id, concat_ws(chr(10), title, 'Pros: ' || pros, 'Cons: ' || cons) AS content, source FROM n""",
    "chunk_windows": "SELECT doc_id, CAST(a AS INTEGER) AS \"at\", substr(text, CAST(a + 1 AS BIGINT), 1500) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 1500)) AS a FROM documents WHERE length(text) > 0)",
    "chunk_sync": f"WITH {_SYNC} SELECT action, count(*) AS n FROM acts GROUP BY 1",
    "chunk_sync_rows": f"WITH {_SYNC} SELECT id, action FROM acts WHERE action <> 'embed'",
    "chunk_sync_counters": f"WITH {_SYNC} SELECT count(DISTINCT shoe_id) FILTER (WHERE action <> 'delete') AS shoes, count(*) FILTER (WHERE action = 'keep') AS kept, count(*) FILTER (WHERE action = 'embed') AS embedded, count(*) FILTER (WHERE action = 'delete') AS deleted FROM acts",
    "doc_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY source, text",
    "page_cache": """WITH refs AS (SELECT DISTINCT source, url FROM fetch_result), good AS (SELECT source, url, fetched_at FROM fetch_result WHERE status = 200 AND text IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY fetched_at DESC NULLS LAST, page_id DESC) = 1)
        SELECT source, url, substr(sha256(url), 1, 24) AS key, fetched_at, g.url IS NOT NULL AS from_cache FROM refs LEFT JOIN (SELECT source, url, fetched_at FROM good) g USING (source, url)""".replace("g.url IS NOT NULL AS from_cache", "(source, url) IN (SELECT (source, url) FROM good) AS from_cache"),
    "url_parts": r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, substr(sha256(url), 1, 24) AS key, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/brands/' AS brands_url,
        status IN (429, 500, 502, 503, 504) AS retry FROM fetch_result""",
    "first_seen_urls": "SELECT ord, source, url, model_raw FROM source_record QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1",
    "robots_allowed": """SELECT r.ord FROM source_record r JOIN (SELECT DISTINCT regexp_extract(base_url, '^[a-z]+://([^/?#]+)', 1) AS host, trust_rank FROM source_registry) g
        ON regexp_extract(r.url, '^[a-z]+://([^/?#]+)', 1) = g.host WHERE g.trust_rank % 4 = 1 OR (g.trust_rank % 4 > 1 AND NOT contains(r.url, g.host || '/private/'))""",
    "review_titles": "SELECT ord, " + _strip(r"regexp_replace(model_raw || ' Performance Review', '(?i)\s*performance review\s*$', '')") + " AS title, regexp_replace(regexp_replace(lower(model_raw), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM source_record",
    "price_labels": "SELECT id, coalesce('$' || CAST(CAST(round(price, 0) AS BIGINT) AS VARCHAR), '—') AS label FROM shoes",
    "feedback_last_vote": """SELECT user_id, CAST(item AS INTEGER) AS item, event_type, event_id FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS item FROM events) WHERE item IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) = 1""",
    "feedback_windows": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
