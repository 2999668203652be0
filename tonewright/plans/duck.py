"""The text and path rules once more as SQL expressions, for comparison with the columns."""

from __future__ import annotations

from tonewright.functions import scores as S
from tonewright.functions import text as T
from tonewright.sources.library import FILE_TEXTS, FLAGS, NUMBERS, TEXTS

W = r"[\s\x0B\x{85}\p{Z}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def ext(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def has(x: str, parts) -> str:
    return "(" + " or ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def trimmed(x: str) -> str:
    return sub(x, rf"^{W}+|{W}+$")


def one_space(x: str) -> str:
    return trimmed(sub(x, r"[\s\x0B]+", " "))


def without_punctuation(x: str) -> str:
    return f"replace(translate({x}, {q(chr(45) + '_.,!?' + chr(39) + chr(34) + ':;/')}, '  '), '&', 'and')"


def folded(x: str) -> str:
    return trimmed(f"lower(nfc_normalize({x}))")


def artist_key(x: str) -> str:
    return one_space(without_punctuation(f"regexp_replace({folded(x)}, '(?s)^(.*), the$', 'the \\1')"))


def without_version(x: str) -> str:
    for p in (rf"\s*\([^)]*?({T.VERSION_WORDS}).*?\)", rf"\s*\[[^\]]*?({T.VERSION_WORDS}).*?\]", rf"\s+({T.TRAILING_WORDS})$"):
        x = sub(x, "(?i)" + p)
    return trimmed(x)


def title_key(x: str) -> str:
    return one_space(without_punctuation(without_version(folded(x))))


def version_kind(x: str) -> str:
    cases = []
    for kind, words in T.VERSION_KINDS.items():
        more = f" and not {has(f'lower({x})', ('remaster', 'edition'))}" if kind == "remix" else ""
        cases.append(f"when {has(f'lower({x})', words)}{more} then {q(kind)}")
    return f"(case {' '.join(cases)} else 'studio' end)"


def cluster_text(x: str) -> str:
    y = f"replace(replace(translate({trimmed(f'lower({x})')}, '()[]{{}}', '      '), '&', 'and'), '+', 'and')"
    return trimmed(sub(y, " {2,}", " "))


def safe_filename(x: str) -> str:
    y = f"translate(nfc_normalize({x}), {q('/' + chr(92) + ':|' + chr(34) + '*?!<>')}, {q('----' + chr(39))})"
    return sub(one_space(sub(y, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]")), r"^[ .]+|[ .]+$")


def capitalized(w: str) -> str:
    a, b = f"regexp_matches({w}, '\\p{{Ll}}')", f"regexp_matches({w}, '\\p{{Lu}}')"
    return f"upper(substr({w}, 1, 1)) || case when {a} = {b} then substr({w}, 2) else lower(substr({w}, 2)) end"


def title_case(x: str) -> str:
    small = ", ".join(map(q, T.SMALL_WORDS))
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, {q(W + '+')}), lambda w: w <> ''), lambda w, i: case when i > 1 and lower(w) in ({small}) then lower(w) else {capitalized('w')} end), ' ')"


def canonical_artist(x: str) -> str:
    t = trimmed(f"nfc_normalize({x})")
    known = " ".join(f"when {q(k)} then {q(v)}" for k, v in T.CAPITAL_ARTISTS.items())
    bare = f"regexp_replace({t}, '^_?&?', '')"
    return f"(case lower({t}) {known} else case when regexp_matches({t}, '^_?&') then '&' || case when strlen({bare}) <= 3 then upper({bare}) else {title_case(bare)} end else {title_case(t)} end end)"


def marked(x: str, marks, keep_blanks: bool) -> str:
    for m in marks:
        m = "".join("\\" + c if c in "()[]-" else c for c in m)
        x = f"regexp_replace({x}, {q(m + '$')}, '')" if keep_blanks else f"regexp_replace({x}, {q(f'(?s)^{W}*(.*?){W}*{m}$')}, '\\1')"
    return x


def _separators(x: str) -> str:
    return sub(f"replace(replace({x}, '--', '-'), '__', '_')", r"^[ \-_]+|[ \-_]+$")


def planned_album(x: str) -> str:
    t = trimmed(x)
    year = trimmed(ext(t, r"^(\d{4}\s*-\s*)", 1))
    name = trimmed(f"regexp_replace({t}, '^\\d{{4}}\\s*-\\s*', '')")
    y = marked(sub(name, r"[-\s]*[\(\[]?[A-Z0-9]{3,15}[\)\]]?[-\s]*", " "), T.PLAN_MARKERS, True)
    y = _separators(one_space(sub(y, r"\[(?:www\.|by\s)[^\]]+\]")))
    y = f"(case when starts_with({name}, 'http') or {has(name, ('_soundcloud_', '_facebook_', 'www_'))} then '' else {y} end)"
    return f"(case when {y} = '' then '' when {year} = '' then {y} else {year} || ' ' || {y} end)"


def ingested_album(x: str) -> str:
    y = sub(marked(x, T.INGEST_MARKERS, False), r"[-\s]*[\(\[]([A-Z0-9]{3,15})[\)\]][-\s]*", " ")
    y = sub(sub(y, r"\[(?:www\.|by\s|http)[^\]]+\]"), r"(?i)\s*[-_\(]\s*(bootleg|promo|promotion)\s*[-_\)]?\s*", " ")
    return _separators(one_space(sub(y, r"(?i)only\s+for\s+promotion")))


def is_address(x: str) -> str:
    return f"(starts_with(lower({x}), 'http') or {has(f'lower({x})', T.URL_MARKS)})"


def stem(x: str) -> str:
    return f"regexp_replace(regexp_extract({x}, '([^/]*)$', 1), '\\.[^.]*$', '')"


def extension(x: str) -> str:
    return f"lower(regexp_extract({x}, '(\\.[^./]*)$', 1))"


def parent(x: str) -> str:
    return f"regexp_replace({x}, '/[^/]*$', '')"


def folder(x: str, above: int = 0) -> str:
    return f"coalesce(list_reverse(string_split({x}, '/'))[{2 + above}], '')"


def first_bytes(x: str, n: int) -> str:
    return "coalesce(" + ", ".join(f"try(decode(encode({x})[1:{n - k}]))" for k in range(4)) + ")"


def last_bytes(x: str, n: int) -> str:
    return "coalesce(" + ", ".join(f"try(decode(encode({x})[strlen({x}) - {n - k - 1}:strlen({x})]))" for k in range(4)) + ")"


def path_component(x: str) -> str:
    bad = '/\\:*?"<>|!#@'
    y = sub(f"translate({x}, {q(bad)}, '{'_' * 12}')", "_{2,}", "_")
    y = sub(sub(trimmed(f"regexp_replace({y}, '^_+', '')"), r"^[.]+|[.]+$"), "_+$")
    cut = f"case when strlen({y}) > 200 then regexp_replace({first_bytes(y, 200)}, '[ _.]+$', '') else {y} end"
    return f"(case when {x} in ('', '_Singles') then {x} when {y} = '' then 'Unknown' else {cut} end)"


def year_of(x: str) -> str:
    return ext(x, r"(19\d\d|20\d\d)", 1)


def two(x: str) -> str:
    return f"(case when {x} < 10 then '0' || ({x})::varchar else ({x})::varchar end)"


def codec_score() -> str:
    def ladder(steps):
        return "(case " + " ".join(f"when bitrate_kbps >= {a} then {b}" for a, b in steps[:-1]) + f" else {steps[-1][1]} end)"

    loss = " ".join(f"when {q(k)} then {v}" for k, v in S.LOSSLESS.items())
    lossy = " ".join(f"when {q(k)} then {ladder(v)}" for k, v in S.LOSSY.items())
    return f"(case when lossless then case lower(codec) {loss} else case when starts_with(lower(codec), 'pcm_') then 42 else 35 end end else case lower(codec) {lossy} else {ladder(S.OTHER_LOSSY)} end end)::double"


DEPTH = "(case when bit_depth >= 24 then 5 when bit_depth >= 20 then 3 when bit_depth >= 16 then 0 else -2 end)::double"
RATE = "(case when sample_rate >= 96000 then 5 when sample_rate >= 48000 then 2 when sample_rate >= 44100 then 0 when sample_rate >= 32000 then -1 else -3 end)::double"
_N = "((tag_artist <> '')::int + (tag_album <> '')::int + (tag_title <> '')::int + (tag_track > 0)::int)"
TAGS = f"({_N} + ({_N} >= 4)::int)::double"
SIZE = "(case when lossless and size_bytes > 52428800 then 2 when lossless and size_bytes > 20971520 then 1 else 0 end)::double"
QUALITY = f"({codec_score()} + {DEPTH} + {RATE} + (case when lossless then 10 else 0 end) + {TAGS} + {SIZE})::double"
BUCKET = "(case when duration_ms <= 0 then 0 else (round(duration_ms / 3000.0::double) * 3)::int end)"

_META = ", ".join([f"coalesce({c}, '') {c}" for c in TEXTS] + [f"coalesce({c}, 0) {c}" for c in NUMBERS] + [f"coalesce({c}, false) {c}" for c in FLAGS])
_FILES = ", ".join(["file_id", "first_seen_at", "last_update_at"] + [f"coalesce({c}, '') {c}" for c in FILE_TEXTS] + ["coalesce(size_bytes, 0) size_bytes", "coalesce(mtime_unix, 0) mtime_unix"])
FILES1 = f"files1 as (select {_FILES} from files where file_id is not null qualify row_number() over (partition by file_id order by last_update_at desc nulls last, coalesce(status, ''), coalesce(error, ''), coalesce(src_path, ''), coalesce(file_key, ''), coalesce(sha1, '')) = 1)"
META1 = f"meta1 as (select distinct file_id, {_META} from metadata where file_id is not null)"
LIB = f"with {FILES1}, {META1}, lib as (select * from files1 join meta1 using (file_id))"


def cluster_key() -> str:
    a, t, s = artist_key("tag_artist"), title_key("tag_title"), stem("src_path")
    return (
        f"keyed0 as (select *, {a} a_, {t} t_, {title_key(s)} n_, {s} s_ from lib), keyed as (select *, "
        f"concat_ws('|', case when a_ = '' and t_ = '' then 'unknown' else a_ end, case when a_ <> '' or t_ <> '' then t_ when n_ <> '' then n_ else 'file_' || {folder('src_path')} end, "
        f"case when a_ = '' and t_ = '' then {version_kind('s_')} else {version_kind('tag_title')} end, {BUCKET}::varchar, 'disc' || tag_disc::varchar, 'track' || tag_track::varchar) as \"key\" from keyed0)"
    )


KEYED = f"{LIB}, {cluster_key()}"
SCORED = f"{KEYED}, scored as (select *, {QUALITY} score from keyed), placed as (select *, row_number() over (partition by \"key\" order by score desc, size_bytes desc, mtime_unix, src_path, file_id) place from scored)"
MANY = "many as (select tag_album as m_album from lib where tag_album <> '' and tag_artist <> '' group by tag_album having count(distinct lower(tag_artist)) >= 3)"


def destination(source: str) -> str:
    """A CTE chain with dest_path for the rows of a source."""
    return (
        f"{MANY}, flagged as (select x.*, m_album is not null as compilation, {canonical_artist(chr(40) + 'case when tag_albumartist <> ' + q('') + ' then tag_albumartist when tag_artist <> ' + q('') + ' then tag_artist else ' + q('Unknown Artist') + ' end)')} owner_, "
        f"{canonical_artist(chr(40) + 'case when tag_artist <> ' + q('') + ' then tag_artist else ' + q('Unknown Artist') + ' end)')} credit_, {planned_album('tag_album')} album0_, {year_of('tag_date')} year_ from {source} x left join many on tag_album = m_album), "
        "named as (select *, case when compilation then 'Various Artists' else owner_ end artist_, case when album0_ = '' then '_Singles' else album0_ end album1_, case when tag_title = '' then "
        f"{stem('src_path')} else tag_title end title_ from flagged), albums as (select *, case when year_ = '' then album1_ else year_ || ' - ' || album1_ end album_ from named), "
        f"dest as (select *, '/dest/' || {path_component('artist_')} || '/' || {path_component('album_')} || '/' || (case when tag_disc_total > 1 and tag_disc > 0 then 'Disc ' || {two('tag_disc')} || '/' else '' end) || "
        f"(case when tag_track > 0 then (case when tag_track_total >= 100 and tag_track < 100 then '0' else '' end) || {two('tag_track')} || ' - ' else '' end) || (case when compilation then {path_component('credit_')} || ' - ' else '' end) || {path_component('title_')} || {extension('src_path')} dest_path from albums)"
    )


PLANNED = (
    f"{SCORED}, {destination('placed')}, ranked as (select *, place = 1 won, row_number() over (partition by place = 1, case when place = 1 then lower(dest_path) else \"key\" end order by score desc, file_id) rank_ from dest), "
    "planned as (select file_id, \"key\", score, dest_path full_path, case when won and rank_ = 1 then 'copy' else 'skip' end as action, case when won and rank_ = 1 then dest_path else '' end dest_path, "
    "case when won and rank_ = 1 then 'best quality' when won then 'path collision' else 'duplicate' end reason, won and rank_ > 1 collided from ranked)"
)
