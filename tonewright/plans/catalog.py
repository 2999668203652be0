"""The queries of the core, named after their operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.functions import paths as P
from tonewright.functions import scores as S
from tonewright.functions import text as T
from tonewright.operators import enrich as E
from tonewright.operators import pipeline as L
from tonewright.operators import reports as R
from tonewright.plans import duck as D
from tonewright.plans.registry import QUERIES, SQL, Query, add, over
from tonewright.sources.checkpoints import cut
from tonewright.sources.library import latest_files, library, one_metadata
from tonewright.sources.tables import table

def rule(name: str, field: str, fn: Callable[[Column], Column], sql: str) -> None:
    """A scalar rule over the different values of a tag."""

    def make(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "metadata", field).select(F.coalesce(field, F.lit("")).alias("value")).distinct().select("value", fn(F.col("value")).alias("result"))

    add(name, make, f"select value, {sql} as result from (select distinct coalesce({field}, '') as value from metadata)")


v = "value"
rule("f1_normalize_artist", "tag_artist", T.artist_key, D.artist_key(v))
rule("f3_normalize_title", "tag_title", T.title_key, D.title_key(v))
rule("f4_normalize_album", "tag_album", T.album_key, D.one_space(D.folded(v)))
rule("f4_clean_string", "tag_title", T.tidy, D.one_space(D.trimmed(f"nfc_normalize({v})")))
rule("f5_punctuation", "tag_title", T.without_punctuation, D.without_punctuation(v))
rule("f6_whitespace", "tag_artist", T.one_space, D.one_space(v))
rule("f7_version_suffix", "tag_title", T.without_version, D.without_version(v))
rule("f8_version_type", "tag_title", T.version_kind, D.version_kind(v))
rule("f9_safe_filename", "tag_title", T.safe_filename, D.safe_filename(v))
rule("f11_canonical_artist", "tag_artist", T.canonical_artist, D.canonical_artist(v))
rule("f12_title_case", "tag_title", T.title_case, D.title_case(v))
rule("f13_clean_album_plan", "tag_album", T.planned_album, D.planned_album(v))
rule("f14_clean_album_ingest", "tag_album", lambda c: T.let(T.ingested_album(c), lambda x: F.when((x == "") | T.is_address(x), c).otherwise(x)), f"case when {D.ingested_album(v)} = '' or {D.is_address(D.ingested_album(v))} then value else {D.ingested_album(v)} end")
rule("f15_clean_artist", "tag_artist", T.cleaned_artist, f"case when lower(value) = 'unknown artist' then '' else {D.trimmed(v)} end")
rule("f16_featured_artist", "tag_title", T.featured_artist, D.trimmed(D.ext(v, r"\s*[\(\[]\s*(?:feat\.?|ft\.?|featuring)\s+([^)\]]+)[\)\]]", 1)))
rule("f18_catalog", "tag_album", T.catalogue_number, D.ext(v, r"[\(\[]([A-Z]{2,5}\d{3,5})[\)\]]", 1))
rule("f19_url_based", "tag_album", T.is_address, D.is_address(v))
rule("f32_normalize_for_clustering", "tag_title", T.cluster_text, D.cluster_text(v))
rule("f40_sanitize_path", "tag_artist", P.path_component, D.path_component(v))
rule("f41_year", "tag_date", P.year_of, D.year_of(v))

c = F.col
over("f10_path_names", library, f"{D.LIB} select file_id, case when tag_albumartist <> '' then tag_albumartist when tag_artist <> '' then tag_artist else 'Unknown Artist' end as artist, case when tag_album <> '' then tag_album else 'Unknown Album' end as album, case when tag_title <> '' then tag_title else {D.stem('src_path')} end as title from lib",
     lambda: dict(file_id=c("file_id"), artist=F.coalesce(F.nullif("tag_albumartist", F.lit("")), F.nullif("tag_artist", F.lit("")), F.lit("Unknown Artist")), album=F.coalesce(F.nullif("tag_album", F.lit("")), F.lit("Unknown Album")), title=F.coalesce(F.nullif("tag_title", F.lit("")), P.stem(c("src_path")))))
over("f17_detect_compilation", library, f"{D.LIB} select file_id, {D.has('lower(src_path)', ('various artists', 'variousartists', 'various_artists', 'compilation', 'mixed by', 'compiled by', 'compiled & mixed', '_singles'))} or {D.has('lower(tag_album)', ('various', 'compilation', 'mixed by'))} as result from lib", lambda: dict(file_id=c("file_id"), result=T.is_compilation(c("src_path"), c("tag_album"))))


def pattern_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    m = one_metadata(spark, folder).select("file_id", "tag_album", "tag_artist", "tag_title", T.ingested_album(c("tag_album")).alias("x"), T.catalogue_number(c("tag_album")).alias("number"), T.cleaned_artist(c("tag_artist")).alias("artist"), T.trimmed(c("tag_title")).alias("title"), T.featured_artist(c("tag_title")).alias("guest"))
    odd = (c("tag_album") != "") & ((c("x") == "") | T.is_address(c("x")))
    m = m.withColumn("album", F.when(odd, c("tag_album")).otherwise(c("x")))
    fields = F.concat_ws(",", *(F.when(c(f"tag_{f}") != c(f), F.lit(f)) for f in ("album", "artist", "title")))
    warnings = F.concat_ws(",", F.when(c("number") != "", F.concat(F.lit("catalog_number:"), "number")), F.when(odd, F.concat(F.lit("suspicious_album_name:"), "tag_album")), F.when(F.lower("tag_artist") == "unknown artist", F.lit("unknown_artist")), F.when(c("guest") != "", F.concat(F.lit("featured_artist:"), "guest")))
    return m.select("file_id", "album", "artist", "title", fields.alias("fields"), warnings.alias("warnings"))


add("f20_pattern_cleaning", pattern_cleaning, f"""with {D.META1}, x as (select *, {D.ingested_album('tag_album')} x, {D.ext('tag_album', r'[\(\[]([A-Z]{2,5}\d{3,5})[\)\]]', 1)} number,
 case when lower(tag_artist) = 'unknown artist' then '' else {D.trimmed('tag_artist')} end artist, {D.trimmed('tag_title')} title, {D.trimmed(D.ext('tag_title', r'\s*[\(\[]\s*(?:feat\.?|ft\.?|featuring)\s+([^)\]]+)[\)\]]', 1))} guest from meta1),
 y as (select *, tag_album <> '' and (x = '' or {D.is_address('x')}) odd from x), z as (select *, case when odd then tag_album else x end album from y)
 select file_id, album, artist, title, concat_ws(',', case when tag_album <> album then 'album' end, case when tag_artist <> artist then 'artist' end, case when tag_title <> title then 'title' end) fields,
 concat_ws(',', case when number <> '' then 'catalog_number:' || number end, case when odd then 'suspicious_album_name:' || tag_album end, case when lower(tag_artist) = 'unknown artist' then 'unknown_artist' end, case when guest <> '' then 'featured_artist:' || guest end) warnings from z""")

_S = D.stem("src_path")
_FULL, _SHORT, _PAIR = r"^(\d+)\s*[-_.]\s*(.+?)\s*[-_.]\s*(.+)$", r"^(\d+)\s*[-_.]\s*(.+)$", r"^(.+?)\s*[-_.]\s*(.+)$"
_int = lambda x: f"coalesce(try_cast({x} as int), 0)"
_PARSED = f"""parsed0 as (select *, {_S} n_, regexp_matches({_S}, {D.q(_FULL)}) f_, regexp_matches({_S}, {D.q(_SHORT)}) s_, regexp_matches({_S}, {D.q(_PAIR)}) p_ from lib),
 parsed1 as (select *, case when f_ then {_int(D.ext('n_', _FULL, 1))} when s_ then {_int(D.ext('n_', _SHORT, 1))} else 0 end n_track, case when f_ then {D.trimmed(D.ext('n_', _FULL, 2))} when s_ then '' when p_ then {D.trimmed(D.ext('n_', _PAIR, 1))} else '' end n_artist,
 case when f_ then {D.trimmed(D.ext('n_', _FULL, 3))} when s_ then {D.trimmed(D.ext('n_', _SHORT, 2))} when p_ then {D.trimmed(D.ext('n_', _PAIR, 2))} else n_ end t0_ from parsed0),
 parsed as (select *, case when t0_ = '' then n_ else t0_ end n_title, round(least(1.0, least(1.0, (case when f_ then 0.8 when s_ then 0.7 when p_ then 0.5 else 0.2 end)::double + (case when n_track > 0 then 0.15 else 0 end)::double) + (case when contains(n_, ' - ') or contains(n_, ' _ ') then 0.05 else 0 end)::double), 2)::double n_confidence from parsed1)"""
add("f21_parse_filename", lambda s, f: library(s, f).select("file_id", *(x.alias(k) for k, x in E.parsed_filename(c("src_path")).items())), f"{D.LIB}, {_PARSED} select file_id, n_track track, n_artist artist, n_title title, n_confidence confidence from parsed")
_ONE, _TWO, _THREE = (D.folder("src_path", i) for i in range(3))
_BEFORE, _BEHIND = r"^(\d{4})\s*[-_.]\s*(.+)$", r"^(.+?)\s*\((\d{4})\)$"


def _inferred(source: str) -> str:
    return f"""inf0 as (select *, regexp_matches({_ONE}, '(?i)^(disc|cd|disk)\\s*\\d+$') d_, {_ONE} one_, {_TWO} two_, {_THREE} three_ from {source}), inf1 as (select *, case when d_ then two_ else one_ end r_, case when d_ then three_ else two_ end p_artist,
 {_int(D.ext('one_', r'(?i)(disc|cd|disk)\s*(\d+)', 2))} p_disc from inf0), inferred as (select *, case when regexp_matches(r_, {D.q(_BEFORE)}) then {D.trimmed(D.ext('r_', _BEFORE, 2))} when regexp_matches(r_, {D.q(_BEHIND)}) then {D.trimmed(D.ext('r_', _BEHIND, 1))} else r_ end p_album,
 case when regexp_matches(r_, {D.q(_BEFORE)}) then {D.ext('r_', _BEFORE, 1)} when regexp_matches(r_, {D.q(_BEHIND)}) then {D.ext('r_', _BEHIND, 2)} else '' end p_year from inf1)"""


add("f22_infer_path", lambda s, f: library(s, f).select("file_id", *(x.alias(k) for k, x in E.inferred_from_path(c("src_path")).items())), f"{D.LIB}, {_inferred('lib')} select file_id, p_album album, p_artist artist, p_year as \"year\", p_disc disc from inferred")
_FILL = {"tag_artist": ("tag_artist = '' and n_confidence >= 0.5 and a_ <> ''", "a_"), "tag_title": ("tag_title = '' and n_confidence >= 0.3 and n_title <> ''", "n_title"), "tag_album": ("tag_album = '' and p_album <> ''", "p_album"), "tag_date": ("tag_date = '' and p_year <> ''", "p_year"), "tag_track": ("tag_track = 0 and n_track > 0", "n_track"), "tag_disc": ("tag_disc = 0 and p_disc > 0", "p_disc")}
add("f23_enrich", lambda s, f: E.enriched(library(s, f)).select("file_id", *E_FIELDS, "filled"), f"{D.LIB}, {_PARSED}, {_inferred('parsed')}, e as (select *, case when n_artist <> '' then n_artist else p_artist end a_ from inferred) select file_id, " + ", ".join(f"case when {hit} then {val} else {k} end {k}" for k, (hit, val) in _FILL.items()) + ", concat_ws(',', " + ", ".join(f"case when {hit} then '{k}' end" for k, (hit, _) in _FILL.items()) + ") filled from e")
E_FIELDS = tuple(_FILL)
_SPECIAL = "('_Singles', 'Various Artists', 'Unknown Artist', 'Unknown Album', '.', '..')"


def _from_folders() -> str:
    year, names = r"^(\d{4})\s*-\s*(.+)$", (r"^(\d{1,3})\s*-\s*(.+)$", r"^(\d{1,3})\s+(.+)$", r"(?i)track\s+(\d{1,3})\s*-\s*(.+)$", r"-\s*(\d{1,3})\s*-\s*(.+)$")
    track = "case " + " ".join(f"when regexp_matches(base_, {D.q(p)}) then try_cast({D.ext('base_', p, 1)} as int)" for p in names) + " else 0 end"
    title = "case " + " ".join(f"when regexp_matches(base_, {D.q(p)}) then {D.trimmed(D.ext('base_', p, 2))}" for p in names) + " else '' end"
    disc = "coalesce(" + ", ".join(f"try_cast({D.ext('al_', rf'(?i){w}\s*(\d+)', 1)} as int)" for w in ("cd", "disc", "disk")) + ", 0)"
    x = f"x as (select *, {_ONE} al_, {_TWO} ar_, {D.stem('src_path')} base_ from lib), y as (select *, {D.trimmed(D.ext('al_', year, 2))} named_, {D.ext('al_', year, 1)} year_, {track} track_, {title} title_, {disc} disc_ from x)"
    z = f"""z as (select *, tag_artist = '' and ar_ <> '' and not regexp_matches(ar_, '^\\d+$') and ar_ not in {_SPECIAL} h1, tag_album = '' and (named_ <> '' or (not regexp_matches(al_, '^\\d+$') and al_ not in {_SPECIAL} and al_ <> '')) h2,
 tag_album = '' and named_ <> '' and tag_date = '' h3, tag_disc = 0 and disc_ > 0 h4, tag_track = 0 and track_ > 0 h5, tag_title = '' and title_ <> '' h6 from y)"""
    return f"""{D.LIB}, {x}, {z} select file_id, case when h1 then ar_ else tag_artist end tag_artist, case when h2 then (case when named_ <> '' then named_ else al_ end) else tag_album end tag_album, case when h3 then year_ else tag_date end tag_date,
 case when h4 then disc_ else tag_disc end tag_disc, case when h5 then track_ else tag_track end tag_track, case when h6 then title_ else tag_title end tag_title,
 concat_ws(',', case when h1 then 'artist_from_path' end, case when h2 then 'album_from_path' end, case when h3 then 'year_from_path' end, case when h4 then 'disc_from_path' end, case when h5 then 'track_from_filename' end, case when h6 then 'title_from_filename' end) filled from z"""


add("f24_enrich_from_path", lambda s, f: E.enriched_from_folders(library(s, f)).select("file_id", "tag_artist", "tag_album", "tag_date", "tag_disc", "tag_track", "tag_title", "filled"), _from_folders())
_YA = r"^(\d{4})\s*-\s*(.+)$"
add("f25_year_album", lambda s, f: table(s, f, "metadata", "tag_album").distinct().select(F.coalesce("tag_album", F.lit("")).alias("value")).distinct().select("value", *(x.alias(k) for k, x in E.year_album(c("value")).items())), f"select value, {D.trimmed(D.ext(v, _YA, 2))} album, {D.ext(v, _YA, 1)} as \"year\" from (select distinct coalesce(tag_album, '') as value from metadata)")
rule("f26_disc_number", "tag_album", E.disc_number, "coalesce(" + ", ".join(f"try_cast({D.ext(v, rf'(?i){w}\s*(\d+)', 1)} as int)" for w in ("cd", "disc", "disk")) + ", 0)")
over("f28_folder_kinds", library, f"{D.LIB} select file_id, regexp_matches({_ONE}, '^\\d+$') as \"numeric\", {_TWO} in ('_Singles', 'Various Artists', 'Unknown Artist', 'Unknown Album', '.', '..') special from lib", lambda: dict(file_id=c("file_id"), numeric=E.is_numeric_folder(P.folder(c("src_path"))), special=E.is_special_folder(P.folder(c("src_path"), 1))))
over("f29_duration_bucket", one_metadata, f"with {D.META1} select file_id, {D.BUCKET} bucket from meta1", lambda: dict(file_id=c("file_id"), bucket=S.duration_bucket(c("duration_ms"))))
add("f30_cluster_key", lambda s, f: L.with_cluster_key(library(s, f)).select("file_id", c("key").alias("cluster_key")), f"{D.KEYED} select file_id, \"key\" cluster_key from keyed")
over("f33_codec_score", library, f"{D.LIB} select file_id, {D.codec_score()} score from lib", lambda: dict(file_id=c("file_id"), score=S.codec_score(c("codec"), c("lossless"), c("bitrate_kbps"))))
over("f34_bit_depth_score", library, f"{D.LIB} select file_id, {D.DEPTH} score from lib", lambda: dict(file_id=c("file_id"), score=S.bit_depth_score(c("bit_depth"))))
over("f35_sample_rate_score", library, f"{D.LIB} select file_id, {D.RATE} score from lib", lambda: dict(file_id=c("file_id"), score=S.sample_rate_score(c("sample_rate"))))
over("f36_tag_score", library, f"{D.LIB} select file_id, {D.TAGS} score from lib", lambda: dict(file_id=c("file_id"), score=S.tag_score(c("tag_artist"), c("tag_album"), c("tag_title"), c("tag_track"))))
add("f37_quality_score", lambda s, f: L.with_score(library(s, f)).select("file_id", "score"), f"{D.LIB} select file_id, {D.QUALITY} score from lib")
over("s10_lossless_codec", one_metadata, f"with {D.META1} select file_id, lower(codec) in ('flac', 'alac', 'ape', 'wavpack', 'wv', 'tta', 'pcm', 'wav', 'aiff') or starts_with(lower(codec), 'pcm_') result from meta1", lambda: dict(file_id=c("file_id"), result=S.is_lossless(c("codec"))))


def proximity(spark: SparkSession, folder: str) -> DataFrame:
    """Gap of each member to the longest of its cluster, one aggregation instead of all pairs."""
    m = L.with_cluster_key(library(spark, folder)).select("file_id", "key", "duration_ms")
    most = m.groupBy("key").agg(F.max("duration_ms").alias("most"))
    gap = c("most") - c("duration_ms")
    return m.join(most, "key").select("file_id", gap.cast("bigint").alias("gap_ms"), S.proximity_score(gap).alias("score"))


add("f38_duration_proximity", proximity, f"{D.KEYED}, m as (select file_id, (max(duration_ms) over (partition by \"key\") - duration_ms)::bigint gap_ms from keyed) select file_id, gap_ms, (case when gap_ms <= 1500 then 6 when gap_ms <= 3000 then 3 when gap_ms <= 5000 then 1 else -2 end)::double score from m")
over("f39_extension", latest_files, f"with {D.FILES1} select file_id, {D.extension('src_path')} result from files1", lambda: dict(file_id=c("file_id"), result=P.extension(c("src_path"))))
add("f42_dest_path", lambda s, f: L.with_destination(library(s, f)).select("file_id", "compilation", "dest_path"), f"{D.LIB}, {D.destination('lib')} select file_id, compilation, dest_path from dest")
_UNITS = " ".join(f"when size_bytes >= {1024**p} then printf('%.1f', round_even(size_bytes / {float(1024**p)}, 1)) || ' {u}B'" for p, u in reversed(list(enumerate("KMGTPE", 1))))
over("f43_format_bytes", latest_files, f"with {D.FILES1} select file_id, case {_UNITS} else size_bytes::varchar || ' B' end result from files1", lambda: dict(file_id=c("file_id"), result=P.byte_size(c("size_bytes"))))
over("f44_format_duration", one_metadata, f"with {D.META1} select file_id, (duration_ms // 1000 // 60)::varchar || ':' || {D.two('duration_ms // 1000 % 60')} result from meta1", lambda: dict(file_id=c("file_id"), result=P.minutes(c("duration_ms"))))
add("f48_retryable_error", lambda s, f: latest_files(s, f).where("error <> ''").select("file_id", "error", T.is_transient(c("error")).alias("result")),
    f"with {D.FILES1} select file_id, error, {D.has('lower(error)', ('timeout', 'timed out', 'connection reset', 'connection refused', 'connection aborted', 'broken pipe', 'no route to host', 'network is unreachable', 'network is down', 'host is down', 'temporary failure', 'resource temporarily unavailable', 'i/o error', 'too many open files'))} result from files1 where error <> ''")
_TRACK = r'"track":\s*"?([^",}]*)'
over("f47_int_or_text", one_metadata, f"with {D.META1} select file_id, case when regexp_matches({D.ext('raw_tags_json', _TRACK, 1)}, '^[+-]?\\d+$') then {D.ext('raw_tags_json', _TRACK, 1)}::bigint else 0 end result from meta1", lambda: dict(file_id=c("file_id"), result=T.int_or_text(F.regexp_extract("raw_tags_json", _TRACK, 1))))


def cache(spark: SparkSession, folder: str) -> DataFrame:
    """The latest answer per folded search name."""
    m = table(spark, folder, "musicbrainz_cache", "search_name", "canonical_name", "aliases", "cached_at").where("trim(search_name) <> '' and canonical_name <> ''").withColumn("folded", F.lower(F.trim("search_name")))
    order = Window.partitionBy("folded").orderBy(c("cached_at").desc_nulls_last(), c("canonical_name"), c("search_name"))
    return m.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


_CACHE = "cache as (select *, lower(trim(search_name, ' ')) folded from musicbrainz_cache where trim(search_name, ' ') <> '' and canonical_name <> '' qualify row_number() over (partition by lower(trim(search_name, ' ')) order by cached_at desc nulls last, canonical_name, search_name) = 1)"
add("f50_alias_lookup", lambda s, f: cache(s, f).select("search_name", F.coalesce((F.lower("canonical_name") == c("folded")) | F.exists("aliases", lambda a: F.lower(a) == c("folded")), F.lit(False)).alias("is_alias")), f"with {_CACHE} select search_name, coalesce(lower(canonical_name) = folded or list_contains(list_transform(aliases, lambda a: lower(a)), folded), false) is_alias from cache")


def canonical_join(spark: SparkSession, folder: str) -> DataFrame:
    artists = table(spark, folder, "metadata", "tag_artist").select(F.coalesce("tag_artist", F.lit("")).alias("value")).distinct()
    names = cache(spark, folder).select("folded", "canonical_name")
    return artists.join(names, F.lower(F.trim("value")) == c("folded"), "left").select("value", T.artist_key(F.coalesce("canonical_name", "value")).alias("result"))


add("f2_canonical_join", canonical_join, f"with {_CACHE} select value, {D.artist_key('coalesce(canonical_name, value)')} result from (select distinct coalesce(tag_artist, '') as value from metadata) left join cache on lower(trim(value, ' ')) = folded")
add("a12_cache_stats", lambda s, f: table(s, f, "musicbrainz_cache", "hit_count").agg(F.count("*").alias("entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).cast("bigint").alias("hits")), "select count(*) entries, coalesce(sum(hit_count), 0)::bigint hits from musicbrainz_cache")
add("x15_uncached_artists", lambda s, f: table(s, f, "metadata", "tag_artist").where("trim(tag_artist) <> ''").select(F.lower(F.trim("tag_artist")).alias("folded")).distinct().join(cache(s, f).select("folded"), "folded", "left_anti"), f"with {_CACHE} select distinct lower(trim(tag_artist, ' ')) folded from metadata where trim(tag_artist, ' ') <> '' and lower(trim(tag_artist, ' ')) not in (select folded from cache)")

# ad-hoc queries, one per filter
_SHOWN = ("file_id", "src_path", "tag_artist", "tag_album", "tag_title")
for _name, _args, _where in (
    ("artist", {"artist": "The Bromipegas Sound System"}, "tag_artist = 'The Bromipegas Sound System' or tag_albumartist = 'The Bromipegas Sound System'"),
    ("album", {"album": "Engine EP"}, "tag_album = 'Engine EP'"), ("title", {"title": "ROAD TO"}, "tag_title ilike '%ROAD TO%'"), ("path", {"path": "/ripbox/"}, "src_path ilike '%/ripbox/%'"), ("format", {"file_format": "mp3"}, "format = 'mp3'"), ("codec", {"codec": "flac"}, "codec = 'flac'"),
    ("lossless", {"lossless": True}, "lossless"), ("lossy", {"lossy": True}, "not lossless"), ("lossless_and_lossy", {"lossless": True, "lossy": True}, "false"), ("empty_artist", {"empty_artist": True}, "tag_artist = ''"), ("empty_album", {"empty_album": True}, "tag_album = ''"), ("empty_title", {"empty_title": True}, "tag_title = ''"), ("errors", {"errors": True}, "status = 'error'"),
):
    add(f"query_{_name}", lambda s, f, a=_args: R.query_library(s, f, **a).select(*_SHOWN), f"{D.LIB} select {', '.join(_SHOWN)} from lib where {_where}")
for _name, _order in (("artist", "tag_artist, tag_album, tag_track"), ("album", "tag_album, tag_track"), ("title", "tag_title"), ("duration", "duration_ms desc"), ("bitrate", "bitrate_kbps desc"), ("path", "src_path")):
    add(f"o1_sort_{_name}", lambda s, f, n=_name: R.query(library(s, f), sort=n, limit=100).select(*_SHOWN), f"{D.LIB} select {', '.join(_SHOWN)} from lib order by {_order}, file_id limit 100")
    # the whole library; the row's place shows the order
    add(f"o1_order_{_name}", lambda s, f, n=_name: R.placed(R.query(library(s, f), sort=n).select(*_SHOWN)).select("place", *_SHOWN), f"{D.LIB} select row_number() over (order by {_order}, file_id) place, {', '.join(_SHOWN)} from lib")

# joins, set operations, counts
add("j1_files_metadata", lambda s, f: L.meta_ok(s, f).select("file_id", "file_key", "codec", "tag_title"), f"{D.LIB} select file_id, file_key, codec, tag_title from lib where status = 'meta_ok'")
add("j3_members_files", lambda s, f: table(s, f, "cluster_members", "cluster_key", "file_id").distinct().join(library(s, f).select("file_id", "src_path", "tag_title"), "file_id").select("cluster_key", "file_id", "src_path", "tag_title"), f"{D.LIB} select distinct cluster_key, file_id, src_path, tag_title from cluster_members join lib using (file_id)")
add("j7_files_without_cluster", lambda s, f: latest_files(s, f).join(table(s, f, "cluster_members", "file_id"), "file_id", "left_anti").select("file_id", "status"), f"with {D.FILES1} select file_id, status from files1 where file_id not in (select file_id from cluster_members where file_id is not null)")
add("a1_clusters", lambda s, f: L.with_cluster_key(L.meta_ok(s, f)).groupBy(c("key").alias("cluster_key")).agg(F.count("*").alias("members")), f"{D.KEYED} select \"key\" cluster_key, count(*) members from keyed where status = 'meta_ok' group by 1")
add("a2_hint", lambda s, f: L.with_cluster_key(L.meta_ok(s, f)).groupBy(c("key").alias("cluster_key")).agg(F.min_by(F.concat("tag_artist", F.lit(" - "), "tag_title"), "file_id").alias("hint")), f"{D.KEYED} select \"key\" cluster_key, arg_min(tag_artist || ' - ' || tag_title, file_id) hint from keyed where status = 'meta_ok' group by 1")
add("a3_cluster_counts", lambda s, f: L.with_cluster_key(L.meta_ok(s, f)).groupBy("key").count().agg(F.count("*").alias("clusters"), F.count_if(c("count") == 1).alias("singletons"), F.count_if(c("count") > 1).alias("duplicates"), F.sum("count").alias("files")), f"{D.KEYED}, n as (select count(*) n from keyed where status = 'meta_ok' group by \"key\") select count(*) clusters, count(*) filter (n = 1) singletons, count(*) filter (n > 1) duplicates, sum(n)::bigint files from n")
add("a4_status_counts", lambda s, f: latest_files(s, f).groupBy("status").agg(F.count("*").alias("n")), f"with {D.FILES1} select status, count(*) n from files1 group by 1")
add("a5_duplicate_clusters", lambda s, f: table(s, f, "cluster_members", "cluster_key", "file_id").distinct().groupBy("cluster_key").count().where("count > 1").agg(F.count("*").alias("n")), "select count(*) n from (select cluster_key from (select distinct cluster_key, file_id from cluster_members) group by 1 having count(*) > 1)")
add("a7_staleness", lambda s, f: latest_files(s, f).where("status = 'meta_ok'").join(table(s, f, "cluster_members", "file_id").distinct().withColumn("member", F.lit(True)), "file_id", "left").agg(F.max("last_update_at").alias("newest"), F.min(F.when(c("member"), c("last_update_at"))).alias("oldest")).select(((c("newest") > c("oldest") + F.expr("interval 1 second"))).alias("stale"), F.expr("timestampdiff(hour, oldest, newest)").alias("hours")), f"with {D.FILES1}, x as (select max(last_update_at) newest, min(last_update_at) filter (file_id in (select file_id from cluster_members)) oldest from files1 where status = 'meta_ok') select newest > oldest + interval 1 second stale, datesub('hour', oldest, newest) as \"hours\" from x")
add("a8_compilation", lambda s, f: L.compilations(library(s, f)), f"{D.LIB}, {D.MANY} select m_album tag_album from many")
add("a9_majority_vote", lambda s, f: E.majority(library(s, f), "tag_album"), f"{D.LIB}, x as (select {D.parent('src_path')} folder, tag_album, count(*) n from lib where tag_album <> '' group by 1, 2), y as (select *, (sum(n) over (partition by folder))::bigint total from x) select folder, tag_album, n, total from y where n * 2 > total")
add("a10_top_errors", lambda s, f: R.top_errors(latest_files(s, f)), f"with {D.FILES1} select error, count(*) n from files1 where error <> '' group by 1 order by 2 desc, 1 limit 10")
add("a14_total_size", lambda s, f: latest_files(s, f).groupBy(P.extension(c("src_path")).alias("extension")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size")), f"with {D.FILES1} select {D.extension('src_path')} extension, count(*) n, sum(size_bytes)::bigint size from files1 group by 1")

# windows and plans
_scored = lambda s, f: L.with_score(L.with_cluster_key(L.meta_ok(s, f)))
_SCORED_OK = D.SCORED.replace("join meta1 using (file_id))", "join meta1 using (file_id) where status = 'meta_ok')", 1)
_PLANNED_OK = D.PLANNED.replace("join meta1 using (file_id))", "join meta1 using (file_id) where status = 'meta_ok')", 1)
add("w1_cluster_winner", lambda s, f: L.winners(_scored(s, f)).select(c("key").alias("cluster_key"), "file_id", "score"), f"{_SCORED_OK} select \"key\" cluster_key, file_id, score from placed where place = 1")
add("w4_member_order", lambda s, f: table(s, f, "cluster_members", "cluster_key", "file_id", "quality_score").distinct().withColumn("place", F.row_number().over(Window.partitionBy("cluster_key").orderBy(c("quality_score").desc_nulls_last(), "file_id"))), "select *, row_number() over (partition by cluster_key order by quality_score desc nulls last, file_id)::int place from (select distinct cluster_key, file_id, quality_score from cluster_members)")
add("w5_planning_order", lambda s, f: table(s, f, "cluster_members", "cluster_key", "file_id", "quality_score", "preferred").groupBy("cluster_key", "file_id").agg(F.max("quality_score").alias("q"), F.max(F.coalesce("preferred", F.lit(False))).alias("p")).withColumn("place", F.row_number().over(Window.partitionBy("cluster_key").orderBy(c("p").desc(), c("q").desc_nulls_last(), "file_id"))).where("place = 1").select("cluster_key", "file_id"), "select cluster_key, file_id from (select cluster_key, file_id, max(quality_score) q, bool_or(coalesce(preferred, false)) p from cluster_members group by 1, 2) qualify row_number() over (partition by cluster_key order by p desc, q desc nulls last, file_id) = 1")
add("w6_cluster_size", lambda s, f: table(s, f, "cluster_members", "cluster_key", "file_id").distinct().withColumn("size", F.count("*").over(Window.partitionBy("cluster_key"))), "select cluster_key, file_id, count(*) over (partition by cluster_key) size from (select distinct cluster_key, file_id from cluster_members)")
add("w2_collision", lambda s, f: L.plans(L.meta_ok(s, f)).where("collided").select("file_id", "key", "score"), f"{_PLANNED_OK} select file_id, \"key\", score from planned where collided")
add("q_dedup_pipeline", lambda s, f: L.plans(L.meta_ok(s, f)).select("file_id", c("key").alias("cluster_key"), "score", "action", "dest_path", "reason"), f"{_PLANNED_OK} select file_id, \"key\" cluster_key, score, action, dest_path, reason from planned")
add("a4_action_counts", lambda s, f: L.plans(L.meta_ok(s, f)).groupBy("action", "reason").agg(F.count("*").alias("n")), f"{_PLANNED_OK} select action, reason, count(*) n from planned group by 1, 2")


def display_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The path shown for each collision: that of the lowest file among the winners that share it."""
    scored = cut(_scored(spark, folder))
    won = L.with_destination(scored.join(L.winners(scored).select("file_id"), "file_id", "left_semi"))
    return won.groupBy(F.lower("dest_path").alias("path")).agg(F.count("*").alias("n"), F.min_by("dest_path", "file_id").alias("shown")).where("n > 1")


_DISPLAY = f"{_SCORED_OK}, won as (select * from placed where place = 1), {D.destination('won').replace('from lib where tag_album', 'from won where tag_album')} select lower(dest_path) path, count(*) n, arg_min(dest_path, file_id) shown from dest group by 1 having count(*) > 1"
add("w3_display_path", display_paths, _DISPLAY)
add("o3_top_duplicate_sets", lambda s, f: R.duplicate_sets(L.with_cluster_key(L.meta_ok(s, f))), f"{D.KEYED} select \"key\", count(*) - 1 losers from keyed where status = 'meta_ok' group by 1 having count(*) > 1 order by 2 desc, 1 limit 20")
_TREE = "parts as (select list_filter(string_split(dest_path, '/'), lambda p: p not in ('', '.')) parts from planned where dest_path <> ''), levels as (select parts, unnest(range(1, len(parts) + 1)) as lvl from parts), tree as (select array_to_string(parts[1:lvl], '/') prefix, lvl::int as \"level\", bool_and(lvl = len(parts)) is_file, count(*) files from levels group by 1, 2)"
add("t1_dest_tree", lambda s, f: R.prefixes(L.plans(L.meta_ok(s, f))), f"{_PLANNED_OK}, {_TREE} select * from tree")
add("t2_tree_stats", lambda s, f: R.prefixes(L.plans(L.meta_ok(s, f))).groupBy("level").agg(F.count_if(~c("is_file")).alias("dirs"), F.count_if(c("is_file")).alias("files")), f"{_PLANNED_OK}, {_TREE} select \"level\", count(*) filter (not is_file) dirs, count(*) filter (is_file) files from tree group by 1")
_EXEC = "ex as (select p.file_id, action, p.dest_path, case when status <> 'error' then size_bytes else 0 end bytes_written, status <> 'error' verify_ok, case when status <> 'error' then '' else error end error from planned p join files1 using (file_id) where action <> 'skip')"
add("x6_simulated_execution", lambda s, f: R.executed(L.plans(library(s, f)), latest_files(s, f)), f"{D.PLANNED}, {_EXEC} select * from ex")
add("a6_bytes_verified", lambda s, f: R.executed(L.plans(library(s, f)), latest_files(s, f)).agg(F.coalesce(F.sum(F.when(c("verify_ok"), c("bytes_written"))), F.lit(0)).alias("size"), F.count_if("verify_ok").alias("verified")), f"{D.PLANNED}, {_EXEC} select coalesce(sum(bytes_written) filter (verify_ok), 0)::bigint size, count(*) filter (verify_ok) verified from ex")




def summary(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics row of the report, each part one aggregation."""
    f = latest_files(spark, folder).agg(F.lit(1).alias("one"), F.count("*").alias("files"), F.count_if(c("status").isin("meta_ok", "executed")).alias("valid"), F.count_if(c("status") == "error").alias("errors"))
    p = L.plans(library(spark, folder)).agg(F.lit(1).alias("one"), F.countDistinct("key").alias("clusters"), F.count_if(c("action") != "skip").alias("winners"), F.count_if(c("action") == "skip").alias("skipped"))
    return f.join(p, "one").drop("one")


add("a11_summary", summary, f"{D.PLANNED}, f as (select count(*) files, count(*) filter (status in ('meta_ok', 'executed')) valid, count(*) filter (status = 'error') errors from files1), p as (select count(distinct \"key\") clusters, count(*) filter (action <> 'skip') winners, count(*) filter (action = 'skip') skipped from planned) select * from f, p")


def queries() -> dict[str, Query]:
    import_module("tonewright.plans.upkeep")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import_module("tonewright.plans.upkeep")
    return dict(SQL)
