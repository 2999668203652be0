"""Small tables written as Parquet, with columns that no operator knows."""

SCHEMAS = {
    "metadata": "file_id bigint, format string, codec string, container string, duration_ms int, sample_rate int, bit_depth int, channels int, bitrate_kbps int, lossless boolean, tag_artist string, tag_album string, tag_title string, tag_albumartist string, tag_date string, tag_disc int, tag_disc_total int, tag_track int, tag_track_total int, tag_compilation boolean, musicbrainz_recording_id string, musicbrainz_release_id string, raw_tags_json string",
    "files": "file_id bigint, file_key string, src_path string, size_bytes bigint, mtime_unix bigint, sha1 string, status string, error string, first_seen_at timestamp, last_update_at timestamp",
    "clusters": "cluster_key string, hint string",
    "cluster_members": "cluster_key string, file_id bigint, quality_score double, preferred boolean",
    "musicbrainz_cache": "search_name string, canonical_name string, mbid string, aliases array<string>, score int, cached_at timestamp, hit_count int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, doc_kind string, about_artist string, created_at timestamp",
    "eval_items": "item_id bigint, lang string, task string, text string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}
# names that the operators use themselves
EXTRA = "record string, id bigint, key string, form string, word string, source string, unit string, n int, part int, open boolean, place int, title string, value string"


def write(spark, folder, **rows):
    """All tables under the folder, those named with the given rows (dicts), the others empty; every table has extra columns."""
    for name, schema in SCHEMAS.items():
        known = [c.split()[0] for c in schema.split(", ")]
        more = ", ".join(c for c in EXTRA.split(", ") if c.split()[0] not in known)
        columns = known + [c.split()[0] for c in more.split(", ")]
        data = [tuple(r.get(c) for c in columns) for r in rows.get(name, [])]
        spark.createDataFrame(data, f"{schema}, {more}").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
