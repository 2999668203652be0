"""Queries on rescans, exports, events, listings and checks, with SQL that has its own constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewright.functions import paths as P
from tonewright.functions import scores as S
from tonewright.operators import enrich as E
from tonewright.operators import pipeline as L
from tonewright.operators import reports as R
from tonewright.operators import upkeep as U
from tonewright.plans import duck as D
from tonewright.plans.registry import add, over
from tonewright.sources import events as V
from tonewright.sources import scan, sinks
from tonewright.sources.checkpoints import cut
from tonewright.sources.library import latest_files, library, one_metadata
from tonewright.sources.tables import table

c = F.col
_TIES = "coalesce(status, ''), coalesce(error, ''), coalesce(src_path, ''), coalesce(file_key, ''), coalesce(sha1, '')"
_FIRST = f"first1 as (select * from files where file_id is not null qualify row_number() over (partition by file_id order by last_update_at nulls last, {_TIES}) = 1)"


def first_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: of several scans the earliest."""
    f = table(spark, folder, "files").where("file_id is not null")
    order = Window.partitionBy("file_id").orderBy(c("last_update_at").asc_nulls_last(), *(F.coalesce(x, F.lit("")) for x in ("status", "error", "src_path", "file_key", "sha1")))
    return f.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


# --- paths and names -------------------------------------------------------------------------------

over(
    "f45_truncate_path",
    latest_files,
    f"with {D.FILES1} select file_id, case when strlen(src_path) <= 40 then src_path else {D.first_bytes('src_path', 18)} || '...' || {D.last_bytes('src_path', 18)} end result from files1",
    lambda: dict(file_id=c("file_id"), result=P.shortened(c("src_path"), 40)),
)
_CLEAN = """case when starts_with({0}, '/') then '/' else '' end || trim(list_reduce(list_prepend('', list_filter(string_split({0}, '/'), lambda p: p not in ('', '.'))),
 lambda a, p: case when p = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || p end), '/')"""
for _name, _sensitive in (("f46_normalize_path", False), ("f46_normalize_path_case", True)):
    _sql = _CLEAN.format("(src_path || '/./../x/' || file_id)")
    over(
        _name,
        latest_files,
        f"with {D.FILES1} select file_id, {_sql if _sensitive else f'lower({_sql})'} result from files1",
        lambda s=_sensitive: dict(file_id=c("file_id"), result=P.normal_path(F.concat("src_path", F.lit("/./../x/"), c("file_id").cast("string")), s)),
    )
add(
    "f46_paths_equal",
    lambda s, f: latest_files(s, f).select("file_id", "src_path").join(first_files(s, f).select("file_id", c("src_path").alias("before")), "file_id").select("file_id", P.same_path(c("src_path"), F.concat(F.lit("/."), F.coalesce("before", F.lit("")))).alias("same")),
    f"with {D.FILES1}, {_FIRST} select file_id, {_CLEAN.format('lower(a.src_path)')} = {_CLEAN.format("lower('/.' || coalesce(b.src_path, ''))")} same from files1 a join first1 b using (file_id)",
)
_NAMES = (r"^(\d{1,3})\s*-\s*(.+)$", r"^(\d{1,3})\s+(.+)$", r"(?i)track\s+(\d{1,3})\s*-\s*(.+)$", r"-\s*(\d{1,3})\s*-\s*(.+)$")
add(
    "f27_track_filename",
    lambda s, f: latest_files(s, f).select(P.base_name(c("src_path")).alias("value")).distinct().select("value", *(x.alias(k) for k, x in E.track_filename(c("value")).items())),
    f"""with {D.FILES1}, v as (select distinct regexp_extract(src_path, '([^/]*)$', 1) as value from files1), n as (select value, regexp_replace(value, '\\.[^.]*$', '') n_ from v)
 select value, case {' '.join(f"when regexp_matches(n_, {D.q(p)}) then try_cast({D.ext('n_', p, 1)} as int)" for p in _NAMES)} else 0 end track,
 case {' '.join(f"when regexp_matches(n_, {D.q(p)}) then {D.trimmed(D.ext('n_', p, 2))}" for p in _NAMES)} else '' end title from n""",
)
over(
    "f51_can_write_tags",
    latest_files,
    f"with {D.FILES1} select file_id, {D.extension('src_path')} in ('.mp3', '.m4a', '.flac', '.ogg', '.opus', '.wma', '.wav', '.aiff', '.ape', '.wv', '.tta', '.mpc') result from files1",
    lambda: dict(file_id=c("file_id"), result=sinks.can_write_tags(c("src_path"))),
)
_ARGS = ", ".join(f"case when {f} <> '' then ['-metadata', '{k}=' || {f}] end" for k, f in (("artist", "tag_artist"), ("album", "tag_album"), ("title", "tag_title"), ("album_artist", "tag_albumartist"), ("date", "tag_date")))
_ARGS += ", " + ", ".join(f"case when {f} > 0 then ['-metadata', '{k}=' || {f}] end" for k, f in (("track", "tag_track"), ("disc", "tag_disc")))
over(
    "f51_writer_arguments",
    one_metadata,
    f"with {D.META1} select file_id, array_to_string(flatten(list_filter([{_ARGS}], lambda x: x is not null)), chr(31)) result from meta1",
    lambda: dict(file_id=c("file_id"), result=F.array_join(sinks.writer_arguments({x: c(x) for x in ("tag_artist", "tag_album", "tag_title", "tag_albumartist", "tag_date", "tag_track", "tag_disc")}), "\x1f")),
)


def first_of_names(spark: SparkSession, folder: str) -> DataFrame:
    """Search names once each, without case and blanks around, in the spelling that was cached first."""
    a = table(spark, folder, "musicbrainz_cache", "search_name", "cached_at").where("trim(search_name) <> ''")
    return a.groupBy(F.lower(F.trim("search_name")).alias("folded")).agg(F.min_by("search_name", F.struct(c("cached_at").isNull(), "cached_at", "search_name")).alias("name"))


add(
    "f49_dedupe_names",
    first_of_names,
    "select lower(trim(search_name, ' ')) folded, search_name as \"name\" from musicbrainz_cache where trim(search_name, ' ') <> '' qualify row_number() over (partition by lower(trim(search_name, ' ')) order by cached_at nulls last, search_name) = 1",
)
add("u1_unique_artists", lambda s, f: R.placed(one_metadata(s, f).select(c("tag_artist").alias("name")).union(one_metadata(s, f).select("tag_albumartist")).where("name <> ''").distinct().orderBy("name")).select("place", "name"),
    "select row_number() over (order by \"name\") place, \"name\" from (select tag_artist as \"name\" from metadata where tag_artist <> '' union select tag_albumartist from metadata where tag_albumartist <> '')")


# --- scans, probes, upserts, exports ---------------------------------------------------------------


def upserted_files(spark: SparkSession, folder: str) -> DataFrame:
    """The latest scan over the first by file key; a known file keeps its status."""
    columns = ("file_key", "src_path", "size_bytes", "mtime_unix", "status")
    old, new = (x.where("file_key is not null").select(*columns) for x in (first_files(spark, folder).where("status is not null"), latest_files(spark, folder).where("file_key <> ''")))
    return sinks.upserted(old, new, "file_key", keep=("status",))


add(
    "k1_upsert_files",
    upserted_files,
    f"""with {D.FILES1}, {_FIRST} select file_key, a.src_path, a.size_bytes, a.mtime_unix, coalesce(b.status, a.status) status from files1 a left join (select file_key, status from first1 where status is not null) b using (file_key)
 where a.file_key <> ''""",
)


def probe_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, probe): the tags and audio values as probe output."""
    text = lambda x: c(x).cast("string")
    stream = F.struct(c("codec").alias("codec_name"), F.lit("audio").alias("codec_type"), text("sample_rate").alias("sample_rate"), c("channels").alias("channels"), F.lit("0").alias("bits_per_sample"), text("bit_depth").alias("bits_per_raw_sample"))
    cover = F.struct(F.lit("mjpeg").alias("codec_name"), F.lit("video").alias("codec_type"), F.lit("").alias("sample_rate"), F.lit(0).alias("channels"), F.lit("8").alias("bits_per_sample"), F.lit("").alias("bits_per_raw_sample"))
    tags = F.create_map(F.lit("ARTIST"), c("tag_artist"), F.lit("album"), c("tag_album"), F.lit("TITLE"), c("tag_title"), F.lit("albumartist"), c("tag_albumartist"), F.lit("YEAR"), c("tag_date"), F.lit("track"), F.concat(text("tag_track"), F.lit("/"), text("tag_track_total")), F.lit("DISC"), text("tag_disc"), F.lit("compilation"), F.when(c("tag_compilation"), "1").otherwise("0"))
    whole = F.struct(c("container").alias("format_name"), F.format_string("%.3f", c("duration_ms") / F.lit(1000.0)).alias("duration"), (c("bitrate_kbps") * 1000).cast("string").alias("bit_rate"), tags.alias("tags"))
    return one_metadata(spark, folder).select("file_id", F.to_json(F.struct(F.array(cover, stream).alias("streams"), whole.alias("format"))).alias("probe"))


add(
    "s8_probe",
    lambda s, f: scan.probed(probe_lines(s, f)),
    f"""with {D.META1} select file_id, container, codec, trunc(printf('%.3f', duration_ms / 1000.0::double)::double * 1000)::int duration_ms, sample_rate, greatest(bit_depth, 0) bit_depth, channels, bitrate_kbps,
 lower(codec) in ('flac', 'alac', 'ape', 'wavpack', 'wv', 'tta', 'pcm', 'wav', 'aiff') or starts_with(lower(codec), 'pcm_') lossless, tag_artist, tag_album, tag_title, tag_albumartist, tag_date, tag_disc, tag_track, tag_compilation from meta1""",
)
add(
    "s9_reread",
    lambda s, f: U.reread(one_metadata(s, f).where("tag_title <> ''").select("file_id", "tag_artist", "tag_title"), scan.probed(probe_lines(s, f)).select("file_id", *U.AUDIO, "tag_artist", "tag_title")).select("file_id", "codec", "sample_rate", "tag_artist", "tag_title"),
    f"with {D.META1} select file_id, codec, sample_rate, tag_artist, tag_title from meta1",
)
for _name, _only in (("x12_rescan", False), ("x12_rescan_errors", True)):
    add(
        _name,
        lambda s, f, o=_only: U.rescan_candidates(latest_files(s, f), o).select("file_id", "status", "error"),
        f"with {D.FILES1} select file_id, status, error from files1 where status = 'error'" + ("" if _only else " or status = 'meta_ok'"),
    )


def one_folder(spark: SparkSession, folder: str) -> DataFrame:
    files = latest_files(spark, folder)
    first = files.agg(F.min_by(P.parent(c("src_path")), "file_id").alias("p")).first()
    return U.in_folder(files, first.p or "").select("file_id", "src_path", "status")


add(
    "same_directory",
    one_folder,
    f"with {D.FILES1}, d as (select arg_min({D.parent('src_path')}, file_id) d from files1) select file_id, src_path, status from files1, d where starts_with(src_path, d || '/') and not contains(substr(src_path, length(d) + 2), '/') and status in ('meta_ok', 'discovered')",
)
_KEYS = "album: tag_album, artist: tag_artist, bitrate_kbps: bitrate_kbps, codec: codec, disc: tag_disc, duration_ms: duration_ms, file_id: file_id, format: format, lossless: lossless, path: src_path, size_bytes: size_bytes, title: tag_title, track: tag_track"
add("k9_jsonl_export", lambda s, f: sinks.json_rows(library(s, f)).select("file_id", F.to_json(F.struct("*")).alias("line")), f"{D.LIB} select file_id, to_json({{{_KEYS}}})::varchar line from lib")
add(
    "k8_csv_export",
    lambda s, f: sinks.csv_rows(library(s, f)),
    f"{D.LIB} select src_path as path, tag_artist artist, tag_album album, tag_title title, tag_track track, tag_disc disc, format, codec, bitrate_kbps, duration_ms, lossless, size_bytes from lib",
)
for _mode, _column in (("size", "size_bytes"), ("hash", "sha1")):
    add(
        f"x4_verify_{_mode}",
        lambda s, f, m=_mode: R.verified(first_files(s, f), latest_files(s, f).where("status <> 'error'"), m),
        f"with {D.FILES1}, {_FIRST} select file_id, coalesce(a.{_column} = b.{_column}, false) verify_ok from first1 a left join (select * from files1 where status <> 'error') b using (file_id)",
    )


# --- plans, listings, reports ----------------------------------------------------------------------

_OK = "join meta1 using (file_id) where status = 'meta_ok')"
_PLANNED_OK = D.PLANNED.replace("join meta1 using (file_id))", _OK, 1)


def deltas(spark: SparkSession, folder: str) -> DataFrame:
    """How far each member's duration is from that of its key's winner."""
    scored = cut(L.with_score(L.with_cluster_key(L.meta_ok(spark, folder))).select("file_id", "key", "score", "size_bytes", "mtime_unix", "src_path", "duration_ms"))
    won = L.winners(scored).select("file_id").join(scored.select("file_id", "key", c("duration_ms").alias("won")), "file_id").select("key", "won")
    return scored.join(won, "key").select("file_id", S.duration_delta(c("duration_ms"), c("won")).alias("delta_ms"))


add("f31_duration_delta", deltas, f"{D.SCORED.replace('join meta1 using (file_id))', _OK, 1)}, w as (select \"key\", duration_ms won from placed where place = 1) select file_id, abs(duration_ms - won) delta_ms from placed join w using (\"key\")")


def shown(**options: bool):
    def make(spark: SparkSession, folder: str) -> DataFrame:
        members = table(spark, folder, "cluster_members", "cluster_key", "file_id", "quality_score", "preferred").where("cluster_key is not null and file_id is not null")
        out = U.listing(members, latest_files(spark, folder), one_metadata(spark, folder), L.plans(library(spark, folder)), **options)
        return out.select("cluster_key", "file_id", "preferred", "size", "src_path", "codec", "action", "dest_path")

    return make


_LISTED = f"""{D.PLANNED}, m0 as (select cluster_key, file_id, bool_or(coalesce(preferred, false)) preferred from cluster_members where cluster_key is not null and file_id is not null group by all),
 m as (select *, count(*) over (partition by cluster_key) as "size", min(case when preferred then file_id end) over (partition by cluster_key) won from m0), shown as (select cluster_key, m.file_id, preferred, "size", won, f.src_path, codec, action, p.dest_path
 from m join files1 f on f.file_id = m.file_id join planned p on p.file_id = m.file_id left join meta1 t on t.file_id = m.file_id) select cluster_key, file_id, preferred, "size", src_path, codec, action, dest_path from shown"""
add("j8_show", shown(), _LISTED)
add("j8_show_duplicates", shown(duplicates_only=True), f'{_LISTED} where "size" > 1')
add("j8_show_winners", shown(winners_only=True), f'{_LISTED} where "size" = 1 or won is null or won = file_id')


def ran(spark: SparkSession, folder: str) -> DataFrame:
    """A simulated run over the whole library; each file is done when it was last updated."""
    files = latest_files(spark, folder)
    return R.executed(L.plans(library(spark, folder)), files).join(files.select("file_id", c("last_update_at").alias("completed_at")), "file_id")


_RAN = f"""{D.PLANNED}, ex as (select p.file_id, action, p.dest_path, case when status <> 'error' then size_bytes else 0 end bytes_written, status <> 'error' verify_ok, case when status <> 'error' then '' else error end error,
 last_update_at completed_at from planned p join files1 using (file_id) where action <> 'skip')"""
add("o6_executions", lambda s, f: R.placed(U.by_completion(ran(s, f))).select("place", "file_id", "completed_at"), f"{_RAN} select row_number() over (order by completed_at desc nulls last, file_id) place, file_id, completed_at from ex")
add("o5_first_errors", lambda s, f: U.first_errors(ran(s, f)), f"{_RAN} select file_id, error, greatest((select count(*) from ex where error <> '') - 10, 0) more from ex where error <> '' order by file_id limit 10")
_TREE = "parts as (select list_filter(string_split(dest_path, '/'), lambda p: p not in ('', '.')) parts from planned where dest_path <> ''), levels as (select parts, unnest(range(1, len(parts) + 1)) as lvl from parts), tree as (select array_to_string(parts[1:lvl], '/') prefix, lvl::int as \"level\", bool_and(lvl = len(parts)) is_file, count(*) files from levels group by 1, 2)"
add(
    "o7_tree_children",
    lambda s, f: U.children(R.prefixes(L.plans(L.meta_ok(s, f)))),
    f"""{_PLANNED_OK}, {_TREE}, k as (select case when contains(prefix, '/') then regexp_replace(prefix, '/[^/]*$', '') else '' end parent, regexp_extract(prefix, '([^/]*)$', 1) as "name", is_file from tree)
 select *, (row_number() over (partition by parent order by is_file, lower("name"), "name"))::int place from k""",
)
add("t1_dest_tree_depth", lambda s, f: R.prefixes(L.plans(L.meta_ok(s, f)), depth=2), f"{_PLANNED_OK}, {_TREE} select * from tree where \"level\" <= 2")
add(
    "a11_summary_report",
    lambda s, f: U.summary(latest_files(s, f), *(lambda p: (p, R.executed(p, latest_files(s, f))))(cut(L.plans(library(s, f))))),
    f"""{_RAN}, k as (select "key", count(*) n, count(*) filter (action <> 'skip') kept from planned group by 1) select (select count(*) from files1 where status in ('discovered', 'meta_ok', 'error', 'executed')) files_scanned,
 (select count(*) from files1 where status in ('meta_ok', 'executed')) files_valid, (select count(*) from files1 where status = 'error') files_with_errors, count(*) clusters, count(*) filter (n = 1) singletons, count(*) filter (n > 1) duplicates,
 coalesce(sum(kept), 0)::bigint winners_planned, coalesce(sum(n - kept), 0)::bigint skipped, (select count(*) from ex where verify_ok) files_executed, (select count(*) from ex where not verify_ok and error <> '') files_failed,
 (select coalesce(sum(bytes_written), 0)::bigint from ex where verify_ok) bytes_written from k""",
)
add(
    "x11_doctor",
    lambda s, f: U.checks(latest_files(s, f), one_metadata(s, f), table(s, f, "cluster_members", "cluster_key", "file_id", "preferred")),
    f"""with {D.FILES1}, r as (select 'files without a path' as "check", count(*) n, 'error' as l from files1 where src_path = '' union all select 'files with errors', count(*), 'warning' from files1 where status = 'error'
 union all select 'read files without tags', count(*), 'error' from files1 where status = 'meta_ok' and not exists (select 1 from metadata m where m.file_id = files1.file_id)
 union all select 'tags without a file', count(distinct file_id), 'error' from metadata m where file_id is not null and not exists (select 1 from files1 f where f.file_id = m.file_id)
 union all select 'members without a file', count(*), 'error' from (select distinct file_id from cluster_members) m where not exists (select 1 from files1 f where f.file_id = m.file_id)
 union all select 'keys without a preferred member', count(*), 'warning' from (select cluster_key from cluster_members group by 1 having not bool_or(coalesce(preferred, false)))) select "check", case when n > 0 then l else 'ok' end as "level", n from r""",
)


# --- events ----------------------------------------------------------------------------------------


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events a run over the read files would log."""
    lib = library(spark, folder).where("status in ('meta_ok', 'error')")
    plans = cut(L.plans(lib).join(latest_files(spark, folder).select("file_id", "file_key", "src_path"), "file_id"))
    sizes = plans.groupBy("key").agg(F.count("*").alias("size"), F.max("score").alias("best"), F.max(F.when(c("reason") != "duplicate", c("src_path"))).alias("winner_path"))
    members = plans.join(sizes, "key").withColumn("preferred", c("reason") != "duplicate")
    several = sizes.where("size > 1").select("key", "winner_path", (c("size") - 1).alias("losers"), c("best").alias("score"))
    parts = (V.scans(latest_files(spark, folder)), V.readings(lib), V.clusterings(members), V.scorings(members), V.plannings(plans), V.duplicates(several), V.conflicts(plans.where("collided")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


add(
    "f52_events",
    lambda s, f: V.at_least(run_events(s, f), "info").groupBy("event", "level", "src_path", "action", "reason", "cluster_key").agg(F.count("*").alias("n"), F.max(F.element_at("extra", F.lit("loser_count"))).alias("losers")),
    f"""{D.PLANNED.replace("join meta1 using (file_id))", "join meta1 using (file_id) where status in ('meta_ok', 'error'))", 1)}, p as (select planned.*, src_path from planned join files1 using (file_id)),
 e as (select 'scan' as "event", 'info' as "level", src_path, null as action, null as reason, null as cluster_key, null as losers from files1
 union all select 'meta', case when error <> '' then 'error' else 'info' end, src_path, null, null, null, null from lib
 union all select 'cluster', 'info', src_path, null, null, "key", null from p union all select 'score', 'info', src_path, null, null, "key", null from p where reason <> 'duplicate'
 union all select case when action = 'skip' then 'skip' else 'plan' end, 'info', src_path, action, reason, null, null from p
 union all select 'duplicate', 'warning', max(case when reason <> 'duplicate' then src_path end), null, null, "key", (count(*) - 1)::varchar from p group by "key" having count(*) > 1
 union all select 'conflict', 'warning', src_path, null, reason, null, null from p where collided) select "event", "level", src_path, action, reason, cluster_key, count(*) n, max(losers) losers from e group by 1, 2, 3, 4, 5, 6""",
)
add("e7_event_levels", lambda s, f: V.at_least(run_events(s, f), "warning").groupBy("event", "level").agg(F.count("*").alias("n")),
    f"""{D.PLANNED.replace("join meta1 using (file_id))", "join meta1 using (file_id) where status in ('meta_ok', 'error'))", 1)}, e as (select 'meta' as "event", 'error' as "level" from lib where error <> ''
 union all select 'duplicate', 'warning' from (select 1 from planned group by "key" having count(*) > 1) union all select 'conflict', 'warning' from planned where collided) select "event", "level", count(*) n from e group by 1, 2""")  # fmt: skip


def file_key(size: Column, mtime: Column) -> Column:
    return scan.file_key(F.lit(None).cast("string"), size, mtime)


over("s4_portable_file_key", latest_files, f"with {D.FILES1} select file_id, sha1(size_bytes::varchar || ':' || mtime_unix::varchar) result from files1", lambda: dict(file_id=c("file_id"), result=file_key(c("size_bytes"), c("mtime_unix"))))
