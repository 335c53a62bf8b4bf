"""The declared schemas of the catalogue's tables, as DDL."""

from __future__ import annotations

MERGEABLE = (
    ("release_year", "int"),
    ("signature_player", "string"),
    ("msrp_usd_cents", "int"),
    ("weight_oz", "double"),
    ("weight_g", "double"),
    ("drop_mm", "double"),
    ("stack_heel_mm", "double"),
    ("stack_forefoot_mm", "double"),
    ("cut_height", "string"),
    ("width_fit", "string"),
    ("length_fit", "string"),
    ("cushioning_tech", "string"),
    ("traction_pattern", "string"),
    ("outdoor_suitability", "string"),
)
MERGEABLE_NAMES = tuple(n for n, _ in MERGEABLE)
TAGS = ("position_tags", "playstyle_tags")
_FIELDS = ", ".join(f"{n} {t}" for n, t in MERGEABLE)
_ORIGIN = "struct<source:string,url:string,fetched_at:string>"
_NOTE = "array<struct<source:string,text:string>>"

SOURCE_RECORD = (
    f"ord bigint, source string, url string, fetched_at string, model_raw string, brand string, model string, version string, {_FIELDS}, "
    "position_tags array<string>, playstyle_tags array<string>, scores map<string,string>, pros array<string>, cons array<string>, "
    "review_text array<string>, image_urls array<string>, extras map<string,string>"
)
CANONICAL = (
    f"canonical_id string, brand string, model string, version string, {_FIELDS}, position_tags array<string>, playstyle_tags array<string>, "
    f"metrics map<string,map<string,string>>, pros {_NOTE}, cons {_NOTE}, review_text {_NOTE}, image_urls array<string>, affiliate_url string, "
    f"provenance map<string,{_ORIGIN}>, sources array<{_ORIGIN}>"
)
SPEC_FIELDS = ("version", *[n for n in MERGEABLE_NAMES if n != "msrp_usd_cents"], *TAGS)
METADATA_FIELDS = ("metrics", "pros", "cons", "review_text", "provenance", "sources", "image_urls")
CHUNK_INDEX = ("id bigint, shoe_id bigint, content string, source string, model_id string, vector array<float>, created_at timestamp")
#: The generic structure of a page.
EXTRACT = (
    "struct<h1:string,title:string,og_image:string,text:string,json_ld:array<string>,links:array<struct<href:string,text:string,path:string>>,"
    "headings:array<struct<level:int,text:string,body:array<string>,items:array<string>,prose:array<string>,section:array<string>>>,"
    "tables:array<array<array<string>>>,table_heads:array<string>,labelled:array<struct<label:string,mark:string,values:array<string>,lasts:array<string>>>,"
    "facts:map<string,string>,images:array<string>,listed:array<struct<href:string,text:string,classes:array<string>>>>"
)
