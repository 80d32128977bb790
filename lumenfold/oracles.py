"""DuckDB SQL that gives the same rows as the core's queries."""

from __future__ import annotations

# Fixed values, written out here so that the SQL can disagree with the code: extensions, words and patterns of names, screens, apps, limits.
PHOTO_EXTS = ("jpg", "jpeg", "png", "heic", "heif", "webp", "gif")
VIDEO_EXTS = ("mp4", "mov", "3gp", "m4v", "mkv", "avi", "webm", "mts", "m2ts", "wmv", "mpg", "mpeg", "mp")
RAW_EXTS = ("dng", "cr2", "cr3", "nef", "arw", "rw2", "orf", "raf", "srw", "pef")
OTHER_IMAGE_EXTS = ("bmp", "tif", "tiff", "avif", "jxl")
NON_SIDECAR_JSON = ("metadata.json", "print-subscriptions.json", "shared_album_comments.json", "user-generated-memory-titles.json")
TRASH_FOLDERS = ("trash", "bin")
EDITED_WORDS = ("edited", "bearbeitet", "modifié", "editado", "modificato", "bewerkt", "redigerad")
EDITED_CUT = ("-edi", "-edit", "-edite")
MESSAGING = (
    ("whatsapp", r"(?i)^(?:IMG|VID)-[0-9]{8}-WA[0-9]{4}"),
    ("whatsapp", r"(?i)^WhatsApp (?:Image|Video) [0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("messenger", r"(?i)^received_[0-9]{6}"),
    ("facebook", r"(?i)^FB_IMG_[0-9]{6}"),
    ("signal", r"(?i)^signal-[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("telegram", r"(?i)^photo_[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}-[0-9]{2}-[0-9]{2}"),
    ("snapchat", r"(?i)^Snapchat-[0-9]{4}"),
    ("reddit", r"(?i)^RDT_[0-9]{8}_"),
)
SCREENSHOT = r"(?i)^(?:screenshot[ _(-]|screen shot |screencapture)"
BURST = r"(?i)^(.+?)_BURST([0-9]{3,})(_COVER)?([.][A-Za-z0-9]+)?$"
RAW_BURST = r"(?i)^(PXL_[0-9]{8}_[0-9]{6,9})[.]RAW-[0-9]{2}[.].+$"
UNSAFE = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}\x{e0000}-\x{e007f}]"
PHONE_SHORT = (720, 750, 828, 1080, 1125, 1170, 1179, 1242, 1284, 1290, 1320, 1440)
TABLET_SHORT = (1536, 1620, 1640, 1668, 2048)
APP_FOLDERS = (("whatsapp", "WhatsApp"), ("telegram", "Telegram"), ("messenger", "Messenger"), ("signal", "Signal"), ("instagram", "Instagram"), ("snapchat", "Snapchat"), ("facebook", "Facebook"), ("reddit", "Reddit"), ("discord", "Discord"), ("download", "Downloads"))
CATEGORIES = ("screenshot", "messaging", "tiny", "pocket", "blur", "dark", "overexposed", "burst_extra", "dup_extra")

ORACLES: dict[str, str] = {}


def quoted(*values: object) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def latest(table: str, key: str, *fields: str) -> str:
    cols = ", ".join(f"arg_max({f}, scanned_at) filter (where {f} is not null) as {f}" for f in fields)
    return f"(select {key}, {cols} from {table} where {key} is not null group by {key})"


def photos(*fields: str) -> str:
    return latest("items_raw", "item_id", *fields)


def sidecars(*fields: str) -> str:
    return latest("sidecars_raw", "sidecar_id", *fields)


def ext_parts(n: str) -> tuple[str, str]:
    has = f"regexp_matches({n}, '^.+\\.[A-Za-z0-9]{{1,10}}$')"
    return f"(case when {has} then regexp_extract({n}, '^(.+)(\\.[A-Za-z0-9]{{1,10}})$', 1) else {n} end)", f"(case when {has} then regexp_extract({n}, '^(.+)(\\.[A-Za-z0-9]{{1,10}})$', 2) else '' end)"


def name_sql(n: str) -> dict[str, str]:
    stem, dot = ext_parts(n)
    copied = f"regexp_matches({stem}, '^.*\\S\\(\\d{{1,6}}\\)$')"
    base = f"(case when {copied} then regexp_extract({stem}, '^(.*\\S)\\((\\d{{1,6}})\\)$', 1) else {stem} end)"
    plain = f"({base} || {dot})"
    words, cut = "|".join(EDITED_WORDS), "|".join(EDITED_CUT)
    num = f"regexp_extract({plain}, '{BURST}', 2)"
    return {
        "stem": stem,
        "base": base,
        "copy_no": f"(case when {copied} then cast(regexp_extract({stem}, '^(.*\\S)\\((\\d{{1,6}})\\)$', 2) as bigint) end)",
        "ext": f"lower(substr({dot}, 2))",
        "edited": f"(regexp_matches(lower({base}), '-(?:{words})$') or (octet_length(encode({plain})) between 47 and 56 and regexp_matches(lower({base}), '(?:{cut})$')))",
        "app": "(case " + " ".join(f"when regexp_matches({n}, '{p}') then '{a}'" for a, p in MESSAGING) + " end)",
        "screenshot": f"regexp_matches({n}, '{SCREENSHOT}')",
        "burst_key": f"(case when regexp_matches({plain}, '{RAW_BURST}') then regexp_extract({plain}, '{RAW_BURST}', 1) when not regexp_matches({plain}, '{BURST}') then null when length({num}) >= 14 then 'BURST' || {num} else regexp_extract({plain}, '{BURST}', 1) end)",
    }


N = name_sql("filename")
YEAR = "(case when regexp_matches(folder, '^Photos from \\d{4}$') then cast(regexp_extract(folder, '^Photos from (\\d{4})$', 1) as bigint) end)"
ORACLES["media_names"] = f"select item_id, {N['base']} as base, {N['copy_no']} as copy_no, {N['ext']} as ext, {N['edited']} as edited, {YEAR} as folder_year, {N['app']} as app, {N['screenshot']} as screenshot, {N['burst_key']} as burst_key from {photos('filename', 'folder')} where filename is not null"
ORACLES["export_ids"] = "select zip_id, case when regexp_matches(name, '(?i)^.+?-\\d{3,}\\.zip$') then regexp_extract(name, '(?i)^(.+?)-\\d{3,}\\.zip$', 1) else coalesce(nullif(regexp_replace(name, '(?i)\\.zip$', ''), ''), 'default') end as export from zips"

MEMBERS = f"(select item_id as id, member, file_size from {photos('member', 'file_size')} where member is not null union all select -sidecar_id as id, member, 0 as file_size from {sidecars('member')} where member is not null)"
_n = name_sql("filename")
_f = name_sql("p3")
CLASSIFY = f"""with m as (select id, file_size, replace(member, '\\', '/') as path from {MEMBERS}),
s as (select *, string_split(path, '/') as parts from m), t as (select *, parts[3] as folder, parts[4] as filename, parts[3] as p3, regexp_matches(parts[3], '^Photos from \\d{{4}}$') as is_year from s),
u as (select *, {_n['ext']} as ext, {_n['edited']} as edited, {_f['ext']} as ext3 from t),
c as (select *, case when path like '%/' then 'directory' when parts[1] <> 'Takeout' or coalesce(parts[2] <> 'Google Photos', true) then 'outside_photos'
 when len(parts) = 3 and ext3 = 'json' then 'root_json' when len(parts) = 3 then 'root_other' when len(parts) <> 4 or folder = '' or filename = '' then 'deep'
 when lower(folder) in ({quoted(*TRASH_FOLDERS)}) then 'trash' when ext = 'json' and lower(filename) in ({quoted(*NON_SIDECAR_JSON)}) then 'non_sidecar_json' when ext = 'json' then 'SIDECAR'
 when ext in ({quoted(*PHOTO_EXTS, *VIDEO_EXTS, *OTHER_IMAGE_EXTS)}) and edited then 'edited' when ext in ({quoted(*RAW_EXTS)}) then 'raw' when ext in ({quoted(*OTHER_IMAGE_EXTS)}) then 'other_image'
 when ext in ({quoted(*PHOTO_EXTS)}) and not is_year then 'album_media' when ext in ({quoted(*PHOTO_EXTS)}) and file_size > 209715200 then 'too_large' when ext in ({quoted(*PHOTO_EXTS)}) then 'IMAGE'
 when ext in ({quoted(*VIDEO_EXTS)}) and not is_year then 'album_video' when ext in ({quoted(*VIDEO_EXTS)}) then 'VIDEO' else 'other' end as r from u)
select id, case when r in ('SIDECAR', 'IMAGE', 'VIDEO') then lower(r) else 'skip' end as kind,
 case when r in ('directory', 'outside_photos', 'root_json', 'root_other', 'deep') then null else folder end as folder,
 case when r in ('directory', 'outside_photos', 'root_json', 'root_other', 'deep', 'trash') then null when is_year then 'year' else 'album' end as folder_kind,
 case when r in ('directory', 'outside_photos', 'deep') then null when r like 'root%' then p3 else filename end as filename,
 case when r in ('SIDECAR', 'IMAGE', 'VIDEO') then null when r = 'root_json' then 'non_sidecar_json' when r in ('root_other', 'deep') then 'other' else r end as reason from c"""
ORACLES["classify_members"] = CLASSIFY
ORACLES["member_reasons"] = f"select kind, coalesce(reason, '') as reason, count(*) as n from ({CLASSIFY}) group by 1, 2"
ORACLES["plan_shards"] = f"""with m as (select item_id, zipkey, member_idx, case when lower(ext) in ({quoted(*PHOTO_EXTS)}) then 1 else 0 end as photo from {photos('zipkey', 'member_idx', 'ext')} where zipkey is not null and member_idx is not null),
c as (select *, sum(photo) over (partition by zipkey order by member_idx, item_id rows unbounded preceding) as nth, sum(photo) over (partition by zipkey) as total from m)
select item_id, zipkey, cast(least(greatest(floor((nth - 1) / 50), 0), greatest(floor(total / 50), 1) - 1) as bigint) as shard from c"""
ORACLES["pending_shards"] = f"select zip_id as shard_id, zipkey from zips where zipkey not in (select zipkey from {photos('zipkey', 'err')} where err is not null and zipkey is not null)"
ORACLES["unique_names"] = f"select item_id, filename from (select *, count(*) over (partition by filename) as n from {photos('filename')} where filename is not null) where n = 1"
ORACLES["worker_split"] = "select zip_id % 4 as worker, count(*) as n from zips group by 1"

SAFE = f"trim(regexp_replace(regexp_replace(text, '{UNSAFE}', '', 'g'), '\\s+', ' ', 'g'), ' ')"
ORACLES["text_clean"] = f"""with s as (select doc_id, text, {SAFE} as safe from documents where text is not null), p as (select *, replace(safe, '|', '/') as line from s)
select doc_id, case when length(line) > 60 then rtrim(left(line, 59)) || '…' else line end as clean, case when substr(text, 1, 1) in ('=', '+', '-', '@', chr(9), chr(13), chr(10)) then '''' || text else text end as cell, length(safe) as n_safe from p"""
ORACLES["url_ids"] = f"select sidecar_id, case when length(url) <= 2048 and regexp_full_match(url, 'https://photos[.]example/photo/[A-Za-z0-9_-]{{10,200}}/?(?:[?#][!-~]*)?') then 'https://photos.example/photo/' || regexp_extract(url, 'photo/([A-Za-z0-9_-]{{10,200}})', 1) end as canonical, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) as url_id from {sidecars('url')} where url is not null"


def unix_sql(c: str) -> str:
    return f"(case when regexp_full_match(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '-?[0-9]{{1,12}}') then nullif(cast(trim({c}, ' ' || chr(9) || chr(10) || chr(13)) as bigint), 0) end)"


ORACLES["sidecar_times"] = f"select sidecar_id, {unix_sql('taken_ts')} as taken, case when lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0) then true else false end as located from {sidecars('taken_ts', 'lat', 'lon')}"
ORACLES["json_props"] = "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events"
_url = f"(select item_id, min(url) as url from {sidecars('item_id', 'url')} where item_id is not null group by 1)"
ORACLES["search_links"] = f"select p.item_id, case when u.url is not null then 'high' when {N['stem']} <> '' then 'low' else 'none' end as conf, case when u.url is not null then u.url when {N['stem']} <> '' then 'https://photos.example/search/' || url_encode({N['stem']}) end as link from {photos('filename')} p left join {_url} u on u.item_id = p.item_id"
ORACLES["image_tokens"] = f"select item_id, cast(ceil(width / 28.0) * ceil(height / 28.0) as bigint) as tokens from {photos('width', 'height')} where width > 0 and height > 0"

EXIF = "^\\s*(\\d{4})[:\\-/](\\d{2})[:\\-/](\\d{2})[ T](\\d{2}):(\\d{2}):(\\d{2})"


def wall_sql(c: str) -> str:
    g = lambda i: f"regexp_extract({c}, '{EXIF}', {i})"
    ts = f"try_cast({g(1)} || '-' || {g(2)} || '-' || {g(3)} || ' ' || {g(4)} || ':' || {g(5)} || ':' || {g(6)} as timestamp)"
    return f"(case when regexp_matches({c}, '{EXIF}') and {g(4)} < '24' and year({ts}) between 1990 and 2027 then {ts} end)"


def offset_sql(c: str) -> str:
    p = "^\\s*([+-])(\\d{2}):?(\\d{2})\\s*$"
    g = lambda i: f"cast(regexp_extract({c}, '{p}', {i}) as bigint)"
    return f"(case when not regexp_matches({c}, '{p}') then null when {g(3)} >= 60 or {g(2)} * 60 + {g(3)} > 840 then null else (case when regexp_extract({c}, '{p}', 1) = '-' then -1 else 1 end) * ({g(2)} * 3600 + {g(3)} * 60) end)"


LOCAL = f"""with s as (select item_id, arg_min(row(taken_ts, 1), sidecar_id)[1] as sc0 from {sidecars('item_id', 'taken_ts')} where item_id is not null group by 1),
p as (select p.*, e.home_tz, {wall_sql('exif_dt')} as dto, {wall_sql('exif_dt_any')} as other, {offset_sql('exif_offset')} as off, {unix_sql('s.sc0')} as sc from {photos('exif_dt', 'exif_offset', 'exif_dt_any', 'folder', 'export_id')} p left join s on s.item_id = p.item_id left join exports e on e.export_id = p.export_id),
w as (select *, case when dto is not null then dto when sc is not null and off is not null then epoch_ms((sc + off) * 1000) when sc is not null then timezone(home_tz, timezone('UTC', epoch_ms(sc * 1000))) else other end as wall from p),
r as (select item_id, folder, case when sc is not null then 'sidecar' when dto is not null and off is not null then 'exif_offset' when dto is not null then 'exif_local' when other is not null then 'exif_any' else 'none' end as taken_src,
 strftime(wall, '%Y-%m-%d') as local_date, strftime(wall, '%H:%M:%S') as local_time, case when dto is not null or (sc is not null and off is not null) then 0 else 1 end as day_uncertain, coalesce(year(wall), {YEAR}) as year from w)"""
ORACLES["local_day"] = f"{LOCAL} select item_id, taken_src, local_date, local_time, day_uncertain, year from r"
ORACLES["day_counts"] = f"{LOCAL} select local_date, count(*) as n, cast(sum(day_uncertain) as bigint) as n_uncertain from r where local_date is not null group by 1"
ORACLES["undated_by_year"] = f"{LOCAL} select coalesce(year, {YEAR}) as year, count(*) as n from r where local_date is null group by 1"
ORACLES["dense_ids"] = f"{LOCAL} select item_id as photo, row_number() over (order by local_date is null, local_date, local_time, 'x:' || item_id) as new_id from r"

MEASURED = f"""with o as (select item_id, arg_min(row(origin_folder, 1), sidecar_id)[1] as origin_folder from {sidecars('item_id', 'origin_folder')} where item_id is not null group by 1),
m as (select p.*, lower(o.origin_folder) as origin, coalesce(width, 0) as w, coalesce(height, 0) as h, coalesce(has_camera_exif, 0) as cam from {photos('filename', 'format', 'width', 'height', 'has_camera_exif', 'lap_var', 'luma_mean', 'luma_std', 'frac_dark', 'frac_bright', 'flat_frac')} p left join o on o.item_id = p.item_id),
g as (select *, least(w, h) as short, greatest(w, h) as long_, greatest(w, h) / nullif(cast(least(w, h) as double), 0) as ratio, {N['app']} as app from m),
z as (select *, case when short > 0 and ((short in ({', '.join(map(str, PHONE_SHORT))}) and ratio between 1.6 and 2.4) or (short in ({', '.join(map(str, TABLET_SHORT))}) and ratio between 1.3 and 1.45)) then true else false end as screen from g),
c as (select item_id, 'screenshot' as category, case when {N['screenshot']} then 0.95 when origin like '%screenshot%' or origin like '%screen shot%' then 0.95 when cam = 0 and screen and (upper(format) = 'PNG' or coalesce(flat_frac, 0) >= 0.35) then 0.8 when cam = 0 and screen then 0.65 end as score,
 case when {N['screenshot']} then 'screenshot file name' when origin like '%screenshot%' or origin like '%screen shot%' then 'from a Screenshots folder' when cam = 0 and screen and (upper(format) = 'PNG' or coalesce(flat_frac, 0) >= 0.35) then 'screen-sized ' || w || 'x' || h || ' graphic, no camera data' when cam = 0 and screen then 'screen-sized ' || w || 'x' || h || ', no camera data' end as reason from z
 union all select item_id, 'messaging', case when app is not null or {' or '.join(f"origin like '%{k}%'" for k, _ in APP_FOLDERS)} then 0.9 end, case {' '.join(f"when app = '{k}' then 'saved from {v} (file name)'" for k, v in APP_FOLDERS)} {' '.join(f"when origin like '%{k}%' then 'from a {v} folder'" for k, v in APP_FOLDERS)} end from z
 union all select item_id, 'tiny', case when long_ > 0 and long_ < 480 then 1.0 when long_ > 0 and long_ < 800 then 0.6 end, case when long_ > 0 and long_ < 480 then 'tiny: ' || w || 'x' || h when long_ > 0 and long_ < 800 then 'small: ' || w || 'x' || h end from z
 union all select item_id, 'pocket', case when cam <> 1 then null when luma_mean < 25 and luma_std < 12 then 0.8 when flat_frac > 0.6 then 0.7 when lap_var < 20 then 0.6 end, case when cam <> 1 then null when luma_mean < 25 and luma_std < 12 then 'black frame (pocket or lens cap?)' when flat_frac > 0.6 then cast(round_even(flat_frac * 100, 0) as integer) || '% of the frame is one flat tone' when lap_var < 20 then 'almost no detail' end from z),
rules as (select item_id, category, cast(score as double) as score, reason from c where score is not null)"""
ORACLES["category_scores"] = f"{MEASURED} select item_id, category, score, reason from rules"
ALL = f"""{MEASURED}, shots as (select z.*, coalesce(r.score, 0) as shot from z left join rules r on r.item_id = z.item_id and r.category = 'screenshot'),
k as (select *, shot >= 0.8 or coalesce(flat_frac, 0) >= 0.35 as graphic, case when frac_bright is not null and luma_mean is not null then greatest(frac_bright, luma_mean / 255.0) end as over_ from shots),
n as (select count(*) filter (where cam = 1 and not graphic) as n_cam, count(*) filter (where not graphic) as n_plain from k),
ref as (select k.* from k, n where case when n_cam >= 20 then cam = 1 and not graphic when n_plain > 0 then not graphic else true end),
v as (select item_id, 'blur' as category, lap_var as x, lap_var < 50 as gate from k where shot < 0.8 and lap_var is not null union all select item_id, 'dark', luma_mean, luma_mean < 25 from k where shot < 0.8 and luma_mean is not null union all select item_id, 'overexposed', over_, frac_bright > 0.5 or luma_mean > 215 from k where shot < 0.8 and over_ is not null),
rv as (select 'blur' as category, lap_var as x from ref where lap_var is not null union all select 'dark', luma_mean from ref where luma_mean is not null union all select 'overexposed', over_ from ref where over_ is not null),
tot as (select category, count(*) as t from rv group by 1),
dv as (select distinct category, x from v), sh as (select dv.category, dv.x, (case when dv.category = 'overexposed' then count(*) filter (where rv.x < dv.x) else count(*) filter (where rv.x > dv.x) end) / cast(any_value(t) as double) as pct from dv join rv on rv.category = dv.category join tot on tot.category = dv.category group by 1, 2),
dist as (select v.item_id, v.category, case when gate then greatest(pct, 0.5) else pct * 0.3 end as score,
 case v.category when 'blur' then 'sharpness ' || cast(round_even(lap_var, 0) as bigint) || ': blurrier than ' || cast(round_even(pct * 100, 0) as bigint) || '% of camera photos' when 'dark' then 'brightness ' || cast(round_even(luma_mean, 0) as bigint) || '/255: darker than ' || cast(round_even(pct * 100, 0) as bigint) || '% of camera photos'
 else cast(round_even(frac_bright * 100, 0) as bigint) || '% blown-out pixels, brightness ' || cast(round_even(luma_mean, 0) as bigint) || '/255' end as reason from v join sh on sh.category = v.category and sh.x = v.x join k on k.item_id = v.item_id),
parts as (select item_id, category, reason, cast(least(score, 1.0) * {1 << 57} as hugeint) * 10000 as m from (select item_id, category, score, reason from rules union all select item_id, category, score, reason from dist) where score >= 0.05),
scores as (select item_id, category, (m // {1 << 57} + case when m % {1 << 57} > {1 << 56} or (m % {1 << 57} = {1 << 56} and (m // {1 << 57}) % 2 = 1) then 1 else 0 end) / 10000.0 as score, reason from parts)"""
ORACLES["distribution_scores"] = f"{ALL} select item_id, category, score, reason from scores where category in ('blur', 'dark', 'overexposed')"
ORACLES["combined_score"] = f"{ALL} select item_id, max(score) as score from scores group by 1"
ORACLES["top_flags"] = f"{ALL} select item_id, place, category, score from (select *, row_number() over (partition by item_id order by score desc, category) as place from scores where score > 0) where place <= 5"
ORACLES["junk_counts"] = f"{ALL} select c as category, count(s.item_id) as n from (select unnest([{quoted(*CATEGORIES)}]) as c) left join scores s on s.category = c and s.score >= 0.5 group by 1"
ORACLES["ecdf_values"] = f"with p as (select lap_var as x from {photos('lap_var')} where lap_var is not null), c as (select x, count(*) as n from p group by 1), t as (select *, sum(n) over (order by x) - n as under, sum(n) over () as total from c) select x, round(under / cast(total as double), 9) as below, round((total - under - n) / cast(total as double), 9) as above from t"

ORACLES["exact_dups"] = f"with p as (select *, coalesce(width, 0) * coalesce(height, 0) as px, coalesce(file_size, 0) as fs from {photos('sha256', 'width', 'height', 'file_size')} where sha256 is not null), r as (select *, row_number() over (partition by sha256 order by px desc, fs desc, item_id) as k from p) select max(case when k = 1 then item_id end) as keeper, count(*) as n, sha1(string_agg(cast(item_id as varchar), chr(10) order by cast(item_id as varchar))) as group_key from r group by sha256 having count(*) > 1"
ELIGIBLE = f"(select * from {photos('phash64', 'width', 'height', 'exif_dt', 'exif_subsec', 'sha256')} where phash64 is not null and phash64 <> 0)"


def near_sql(limit: int) -> str:
    e = f"(select phash64, min(item_id) as item_id from {ELIGIBLE} group by phash64)"
    return f"select a.item_id as a, b.item_id as b, cast(bit_count(xor(a.phash64, b.phash64)) as integer) as dist from {e} a join {e} b on a.item_id < b.item_id and bit_count(xor(a.phash64, b.phash64)) <= {limit}"


ORACLES["near_candidates"] = near_sql(3)
ORACLES["near_candidates_5"] = near_sql(5)
ORACLES["hash_classes"] = f"select item_id, min(item_id) over (partition by phash64) as rep from {ELIGIBLE}"
SUB = "(case when regexp_matches(exif_subsec, '^\\s*\\d{1,9}') then cast(regexp_extract(exif_subsec, '^\\s*(\\d{1,9})', 1) as double) / power(10.0, length(regexp_extract(exif_subsec, '^\\s*(\\d{1,9})', 1))) end)"


def blocks_sql() -> str:
    """Whether two hashes differ in two bits of one of 16 blocks of 2 by 2, of 8 by 8: then the derived signatures differ too much."""
    masks = [sum(1 << (r * 8 + c) for r in (2 * i, 2 * i + 1) for c in (2 * j, 2 * j + 1)) for i in range(4) for j in range(4)]
    return " or ".join(f"bit_count(xor(h1, h2) & ({m - (1 << 64) if m >> 63 else m})) > 1" for m in masks)


def checks_sql(source: str) -> str:
    return f"""e as materialized ({source}),
p as (select a.item_id as a, b.item_id as b, a.phash64 as h1, b.phash64 as h2, a.width as w1, a.height as h1_, b.width as w2, b.height as h2_, case when a.cs is null or b.cs is null then null when a.sub is not null and b.sub is not null then abs((a.cs + a.sub) - (b.cs + b.sub)) else abs(a.cs - b.cs) end as delta from e a join e b on a.item_id < b.item_id and bit_count(xor(a.phash64, b.phash64)) <= 3 where a.sha256 is distinct from b.sha256 or a.sha256 is null),
x as (select a, b, case when not coalesce(least(w1, h1_, w2, h2_) > 0 and w1 is not null and h1_ is not null and w2 is not null and h2_ is not null and abs(w1 / cast(h1_ as double) - w2 / cast(h2_ as double)) / greatest(w1 / cast(h1_ as double), w2 / cast(h2_ as double)) <= 0.02, false) then 'aspect' when {blocks_sql()} then 'sig' when not (delta is null or delta < 1e-6 or delta > 60 or (abs(delta / 3600 - round_even(delta / 3600, 0)) < 1e-6 and delta > 1800)) then 'capture' else 'none' end as rejected from p)"""


SEEN = f"select item_id, phash64, width, height, sha256, epoch({wall_sql('exif_dt')}) as cs, {SUB} as sub from {ELIGIBLE}"
CHECKS = checks_sql(f"select min(item_id) as item_id, phash64, width, height, sha256, cs, sub from ({SEEN}) group by all")
ORACLES["edge_checks"] = f"with {CHECKS} select a, b, rejected from x"
ORACLES["reject_tally"] = f"with {CHECKS} select rejected, count(*) as n from x group by 1"
ORACLES["components"] = f"with recursive {CHECKS}, s as (select a, b from x where rejected = 'none' union select b, a from x where rejected = 'none'), r as (select a as v, a as u from s union select r.v, s.b from r join s on s.a = r.u) select v, min(u) as component from r group by v"
CHUNKS = "(select i, item_id, (phash64 >> case i when 0 then 1 when 1 then 17 when 2 then 33 else 49 end) & case when i = 3 then 32767 else 65535 end as value from E, range(4) t(i))"
ORACLES["bucket_skips"] = f"with E as {ELIGIBLE}, c as {CHUNKS}, n as (select i, value, count(*) as n from c group by 1, 2 having count(*) > 5) select count(*) as skipped_buckets, cast(coalesce(sum(n), 0) as bigint) as skipped_bucket_items, cast(coalesce(sum(n * (n - 1) // 2), 0) as bigint) as unexamined_pairs from n"
ORACLES["vector_hashes"] = "with m as (select vec_id, embedding, (cast(list_sort(embedding)[32] as double) + list_sort(embedding)[33]) / 2 as med from embeddings) select vec_id, cast(list_sum(list_transform(range(64), lambda i: case when embedding[i + 1] > med then (case when i = 63 then cast(-9223372036854775808 as hugeint) else cast(power(2, i) as hugeint) end) else cast(0 as hugeint) end)) as bigint) as h from m"
# All photos in the order of keepers, `rk` 1 the best.
KEEPERS = f"""{LOCAL.replace("with s as", "with recursive s as", 1)}, sa as (select * from {sidecars('item_id', 'url', 'favorited', 'folder', 'folder_kind', 'trashed', 'lat', 'lon')}),
alb as (select url, list(distinct folder) as al from sa where url is not null and folder_kind = 'album' and coalesce(trashed, 0) = 0 and folder is not null group by url),
own as (select item_id, arg_min(url, sidecar_id) filter (where url is not null) as url, max(favorited) as fav, bool_or(coalesce(lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0), false)) as at from sa where item_id is not null group by 1),
ks as (select f.item_id, f.sha256, f.phash64, coalesce(width, 0) * coalesce(height, 0) as px, coalesce(has_camera_exif, 0) as cam, case when coalesce(own.at, false) or coalesce(exif_lat between -90 and 90 and exif_lon between -180 and 180 and not (exif_lat = 0 and exif_lon = 0), false) then 1 else 0 end as gps, coalesce(own.fav, 0) as fav,
 len(list_distinct(list_concat(case when folder_kind = 'album' then [f.folder] else [] end, coalesce(alb.al, [])))) as albums_n, coalesce(file_size, 0) as fs, coalesce(w.sc, cast(epoch(w.dto) as bigint) - w.off, cast(epoch(timezone(w.home_tz, w.dto)) as bigint), cast(epoch(timezone(w.home_tz, w.other)) as bigint)) as ts
 from {photos('sha256', 'phash64', 'width', 'height', 'file_size', 'has_camera_exif', 'exif_lat', 'exif_lon', 'folder', 'folder_kind')} f join w on w.item_id = f.item_id left join own on own.item_id = f.item_id left join alb on alb.url = own.url),
kp as (select *, row_number() over (order by px desc, cam desc, gps desc, fav desc, albums_n desc, fs desc, ts is null, ts, cast(item_id as varchar)) as rk from ks)"""
ORACLES["keeper_rank"] = f"{KEEPERS} select item_id, place from (select item_id, row_number() over (partition by sha256 order by rk) - 1 as place from kp where sha256 is not null) where place > 0"
# Units are the photos of one sha256, named by the place of their best; from best to worst each takes what is left of its matches.
ORACLES["seed_groups"] = f"""{KEEPERS}, {checks_sql(SEEN).replace('p as (select a.item_id', 'pp as (select a.item_id').replace('as rejected from p)', 'as rejected from pp)')},
u as materialized (select item_id, phash64, rk, min(rk) over (partition by coalesce(hex(sha256), 'i' || item_id)) as unit from kp),
l as (select distinct a.unit as ua, b.unit as ub from x join u a on a.item_id = x.a join u b on b.item_id = x.b where rejected = 'none' and a.unit <> b.unit),
adj as materialized (select ua, list(distinct ub) as near from (select ua, ub from l union all select ub, ua from l) group by ua),
walk as (select cast(null as bigint) as seed, cast([] as bigint[]) as taken, coalesce((select list(ua order by ua) from adj), []) as rest
 union all select rest[1], list_filter(near, lambda z: list_contains(rest, z)), list_filter(rest[2:], lambda z: not list_contains(near, z)) from walk join adj on ua = rest[1]),
g as (select seed, unnest(taken) as unit from walk where seed is not null),
m as (select coalesce(g.seed, u.unit) as seed, item_id, phash64, rk from u left join g on g.unit = u.unit),
n as (select *, count(*) over (partition by seed) as n, row_number() over (partition by seed order by rk) - 1 as place from m)
select s.item_id as seed_item_id, n.item_id, n.place, cast(bit_count(xor(n.phash64, s.phash64)) as integer) as dist, cast(n.place = 0 as integer) as is_keeper from n join kp s on s.rk = n.seed where n.n > 1"""

RECORDS = f"""s as (select item_id, arg_min(row(url, favorited, archived), sidecar_id) as s from {sidecars('item_id', 'url', 'favorited', 'archived')} where item_id is not null group by 1),
rec as (select p.*, s.s[1] as url, coalesce(s.s[2], 0) as favorited, coalesce(s.s[3], 0) as archived, lower(nfc_normalize(filename)) as nm, coalesce(strftime(coalesce({wall_sql('exif_dt')}, {wall_sql('exif_dt_any')}), '%Y-%m-%d'), '') as day from {photos('zipkey', 'zip_name', 'export_id', 'member_idx', 'member', 'folder', 'folder_kind', 'filename', 'sha256', 'exif_dt', 'exif_dt_any')} p left join s on s.item_id = p.item_id where p.sha256 is not null),
own as (select sha256, nm, day, count(distinct url) as owners, min(url) as owner from rec where url is not null group by 1, 2, 3),
k as (select rec.*, case when url is not null then 'u|' || url when owners = 1 then 'u|' || owner when owners > 1 then 'a|' || zipkey || '|' || member_idx else 'n|' || hex(rec.sha256) || '|' || coalesce(rec.nm, '?') || '|' || rec.day end as item_key from rec left join own on own.sha256 = rec.sha256 and own.nm = rec.nm and own.day = rec.day),
pl as (select *, row_number() over w as place, first_value(export_id) over w as pe from k window w as (partition by item_key order by url is null, case when folder_kind = 'year' then 0 else 1 end, export_id desc, zipkey, member_idx))"""
ORACLES["collapse"] = f"with {RECORDS} select item_id, cast(place = 1 as integer) as is_primary, case when place = 1 then '' when folder_kind = 'album' then 'album_copy' when export_id <> pe then case when url is not null then 'double_export' else 'double_export_nourl' end when url is not null then 'same_url' else 'same_file_nourl' end as reason from pl"
ORACLES["flag_merge"] = f"with {RECORDS} select max(url) as url, cast(max(favorited) as bigint) as favorited, cast(max(archived) as bigint) as archived, count(*) as n_records, count(distinct case when folder_kind = 'album' then folder end) as albums_n from k group by item_key having max(url) is not null"
ORACLES["album_sets"] = f"select url, string_agg(distinct folder, '|' order by folder) as albums from {sidecars('url', 'folder', 'folder_kind', 'trashed')} where url is not null and folder_kind = 'album' and coalesce(trashed, 0) = 0 group by url having count(folder) > 0"
ORACLES["uid_suffixes"] = f"with {RECORDS}, u as (select item_id, url, case when url is not null then 'g:' || regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) else 's:' || lower(hex(sha256)) || ':' || filename end as base, folder, export_id, zip_name, member from rec where filename is not null), n as (select *, case when url is not null then 1 else row_number() over (partition by base order by folder, export_id, zip_name, member) end as n from u) select item_id, case when n = 1 then base else base || ':' || n end as item_uid from n"
ORACLES["unindexed_by_day"] = f"""with s as (select *, {unix_sql('taken_ts')} as ts from {sidecars('item_id', 'url', 'taken_ts', 'title')}),
m as (select url, lower(nfc_normalize(coalesce(title, ''))) as nm, strftime(timezone('America/New_York', timezone('UTC', epoch_ms(ts * 1000))), '%Y-%m-%d') as day from s where item_id is null and (url is null or url not in (select url from s where item_id is not null and url is not null))),
o as (select case when url is not null then 'u|' || url else 'n|' || nm || '|' || coalesce(day, '?') end as same, min(day) as day from m group by 1) select day, count(*) as n from o group by 1"""

SHOTS = f"""dg as (select item_id, case when count(*) over (partition by sha256) > 1 then min(item_id) over (partition by sha256) end as g from {photos('sha256')} where sha256 is not null),
q as (select p.item_id, epoch({wall_sql('exif_dt')}) as ts, epoch({wall_sql('exif_dt')}) + coalesce({SUB}, 0.0) as t, phash64, model, dg.g, coalesce(lap_var, 0.0) as lap, coalesce(width, 0) * coalesce(height, 0) as px, coalesce(frac_dark, 0.0) < 0.5 and coalesce(frac_bright, 0.0) < 0.2 as good from {photos('exif_dt', 'exif_subsec', 'phash64', 'model', 'lap_var', 'width', 'height', 'frac_dark', 'frac_bright')} p left join dg on dg.item_id = p.item_id),
l as (select *, case when coalesce(t - lag(t) over w <= 3 and bit_count(xor(phash64, lag(phash64) over w)) <= 10, false) and coalesce(model = lag(model) over w, true) and not coalesce(g = lag(g) over w, false) then 0 else 1 end as o from q where ts is not null and phash64 is not null window w as (order by t, cast(item_id as varchar), item_id)),
c as (select *, sum(o) over (order by t, cast(item_id as varchar), item_id rows unbounded preceding) as chain from l), b as (select *, min(item_id) over (partition by chain) as burst, count(*) over (partition by chain) as size from c), f as (select * from b where size > 1),
ch as (select *, row_number() over (partition by burst order by good desc, lap desc, px desc, cast(item_id as varchar)) as choice from f), k as (select *, row_number() over (partition by burst order by choice <> 1, lap desc, px desc, cast(item_id as varchar)) - 1 as place from ch)"""
ORACLES["bursts_time"] = f"with {SHOTS} select burst, item_id from f"
ORACLES["burst_ranks"] = f"with {SHOTS} select burst, item_id, place, cast(choice = 1 as bigint) as is_best from k"
ORACLES["burst_summary"] = f"with {SHOTS} select burst, count(*) as size, cast(min(ts) as bigint) as start_ts, cast(max(ts) as bigint) as end_ts, round(max(t) - min(t), 6) as duration_s from f group by 1"
ORACLES["burst_extras"] = f"with {SHOTS}, d as (select burst, max(t) - min(t) as dur from f group by 1) select a.item_id, cast(0.8 as double) as score, 'burst of ' || a.size || ' in ' || printf('%.1f', d.dur) || ' s; #' || b.item_id || ' is ' || case when a.lap > 0 then printf('%.1f', b.lap / a.lap) || 'x sharper' else 'sharper' end as reason from k a join k b on b.burst = a.burst and b.choice = 1 join d on d.burst = a.burst where a.choice > 1"
ORACLES["bursts_by_name"] = f"with p as (select item_id, folder, {N['burst_key']} as k from {photos('folder', 'filename')} where folder is not null), n as (select *, count(*) over (partition by folder, k) as n, min(item_id) over (partition by folder, k) as burst from p where k is not null) select burst, item_id from n where n > 1"

INDEX = LOCAL + f", ix as (select r.item_id, r.local_date, r.local_time, r.day_uncertain, r.year, p.filename, p.exif_lat as lat, p.exif_lon as lon from r join {photos('filename', 'exif_lat', 'exif_lon')} p on p.item_id = r.item_id)"
ORACLES["search_filters"] = f"{INDEX} select item_id, local_date from ix where local_date between '2015-01-01' and '2019-12-31' and contains(lower(filename), 'img_') and lat is not null and lon is not null"
ORACLES["search_semi"] = f"{MEASURED} select item_id from rules where category = 'tiny' and score >= 0.6"
ORACLES["search_anti"] = f"{INDEX} select item_id from ix where year = 2018 and item_id not in (select item_id from {sidecars('item_id', 'favorited')} where favorited = 1 and item_id is not null)"
ORACLES["search_page"] = f"{INDEX}, {MEASURED[5:]} select ix.item_id, local_date, (select max(score) from rules where rules.item_id = ix.item_id) as score from ix order by local_date is null, local_date, local_time, ix.item_id limit 50 offset 50"
ORACLES["vector_topk"] = "select vec_id from (select vec_id, list_sum(list_transform(range(64), lambda i: cast(embedding[i + 1] as double) * (case when i % 2 = 1 then 1.0 else -0.5 end))) as s from embeddings) order by s desc, vec_id limit 20"
ORACLES["items_in_zips"] = "select item_id, zip_id, name as zip_name from items join zips using (zipkey)"
ORACLES["library_counts"] = "select year, count(*) as n, count(emb_row) as n_vectors, count(*) filter (where is_graphic = 1) as n_graphic from items group by 1"
DUP = f"dm as (select *, min(item_id) over (partition by sha256) as group_id, count(*) over (partition by sha256) as n from {photos('sha256', 'width', 'height', 'file_size', 'filename')} where sha256 is not null), d as (select *, cast(item_id = group_id as integer) as is_keeper from dm where n > 1)"
ORACLES["memberships"] = f"with {DUP}, {SHOTS} select i.item_id, d.group_id as dup_group, d.is_keeper, k.burst, case when k.burst is not null then cast(k.choice = 1 as integer) end as is_best from items i left join d on d.item_id = i.item_id left join k on k.item_id = i.item_id"
ORACLES["keeper_diff"] = f"with {DUP} select m.group_id, m.item_id, concat_ws(',', case when m.width is distinct from k.width then 'width' end, case when m.height is distinct from k.height then 'height' end, case when m.file_size is distinct from k.file_size then 'file_size' end, case when m.filename is distinct from k.filename then 'filename' end) as diff from d m join d k on k.item_id = m.group_id where m.is_keeper = 0"
ORACLES["uncertain_members"] = f"with {DUP}, u as {_url} select m.group_id, m.item_id from d m left join u a on a.item_id = m.item_id left join u b on b.item_id = m.group_id where m.is_keeper = 0 and (a.url is null or b.url is null or a.url = b.url)"
ORACLES["relational_division"] = f"with {DUP} select group_id from d group by 1 having bool_and(coalesce(width >= 1000, false))"
ORACLES["group_pages"] = f"with {DUP}, g as (select distinct group_id from d order by group_id limit 20) select group_id, item_id, is_keeper from d where group_id in (select group_id from g)"
ORACLES["ordered_lookup"] = "select item_id, item_uid, emb_row as ordinal from items where emb_row is not null"
TAKEN_DAY = f"(case when {unix_sql('taken_ts')} between -62135510400 and 253402214400 then strftime(epoch_ms({unix_sql('taken_ts')} * 1000), '%Y-%m-%d') end)"
ORACLES["day_blockers"] = f"""{LOCAL}, sd as (select item_id, favorited, {TAKEN_DAY} as day from {sidecars('item_id', 'favorited', 'taken_ts')}),
liked as (select item_id, min(day) as own from sd where favorited = 1 and item_id is not null group by 1),
ch as (select case when r.item_id is not null then r.local_date else own end as d, r.item_id from liked left join r on r.item_id = liked.item_id),
days as (select d as local_date, count(item_id) as n_approved from ch where d is not null group by 1),
st as (select local_date, count(*) as n, sum(day_uncertain) as n_uncertain from r where local_date is not null group by 1), ot as (select day, count(*) as n from sd where item_id is null and day is not null group by 1),
un as (select coalesce(year, {YEAR}) as y, count(*) as n from r where local_date is null group by 1),
c as (select days.local_date, coalesce(st.n, 0) as n, n_approved, coalesce(ot.n, 0) as n_not_indexed, cast(coalesce(n_uncertain, 0) as bigint) as n_uncertain, coalesce(un.n, 0) as n_undated_in_year, coalesce((select n from un where y is null), 0) as n_undated_unknown_year, (select count(*) from sd where item_id is null and day is null) as n_unindexed_undated
 from days left join st using (local_date) left join ot on ot.day = days.local_date left join un on un.y = cast(left(days.local_date, 4) as integer)),
b as (select *, concat_ws(',', case when n = 0 then 'no_indexed_photos' end, case when n > 0 and n_approved <> n then 'not_all_approved' end, case when n_not_indexed > 0 then 'not_indexed_that_day' end, case when n_uncertain > 0 then 'day_uncertain' end, case when n_undated_in_year > 0 then 'undated_in_year' end, case when n_undated_unknown_year > 0 then 'undated_unknown_year' end, case when n_unindexed_undated > 0 then 'unindexed_undated' end) as blockers from c)
select *, cast(blockers = '' as integer) as safe from b"""
ORACLES["queue_fold"] = """with recursive e as (select cast(user_id as varchar) as item_uid, event_id as seq, case event_id % 5 when 0 then 'propose' when 1 then 'approve' when 2 then 'reject' when 3 then 'add' else 'reset' end as action, row_number() over (partition by user_id order by event_id) as i from events),
r as (select item_uid, cast(0 as bigint) as i, cast(null as varchar) as status, cast(null as varchar) as actor, cast(0 as bigint) as seq, cast(0 as bigint) as n_events from (select distinct item_uid from e)
 union all select item_uid, i, status, case when status is null then null else actor end, seq, n_events + cast((status, actor) is distinct from (old, first_) as bigint) from (
  select r.item_uid, e.i, e.seq, r.n_events, r.status as old, r.actor as first_,
   case when action = 'propose' then coalesce(r.status, 'proposed') when action = 'add' then 'approved' when r.status is null then null when action = 'approve' then 'approved' when action = 'reject' then 'rejected' when r.actor = 'user' then null else 'proposed' end as status,
   case when r.actor is not null then r.actor when action = 'propose' then 'a' when action = 'add' then 'user' end as actor
  from r join e on e.item_uid = r.item_uid and e.i = r.i + 1)),
l as (select *, row_number() over (partition by item_uid order by i desc) as k from r) select item_uid, status, actor, seq, n_events from l where k = 1 and status is not null"""
ORACLES["stream_queue_fold"] = ORACLES["queue_fold"]
ORACLES["latest_decisions"] = "with e as (select user_id as group_key, event_id as seq, case when event_id % 3 = 0 then 'clear' else 'keeper' end as action, event_type as keeper_uid from events), l as (select *, row_number() over (partition by group_key order by seq desc) as r from e) select group_key, action, keeper_uid, seq from l where r = 1 and action <> 'clear'"
ORACLES["proposal_batches"] = "select event_type as batch_id, cast(user_id % 3 as varchar) as actor, count(*) as n, min(event_id) as first_ts from events group by 1, 2"
SESSIONS = "with l as (select event_type, ts, case when ts - lag(ts) over (partition by event_type order by ts) <= interval 60 seconds then 0 else 1 end as o from events), c as (select *, sum(o) over (partition by event_type order by ts rows unbounded preceding) as s from l) select event_type, count(*) as n, cast(floor(epoch(min(ts))) as bigint) as start_s, cast(floor(epoch(max(ts))) as bigint) as end_s from c group by event_type, s"
ORACLES["event_sessions"] = SESSIONS
ORACLES["stream_sessions"] = SESSIONS


def clean_sql(c: str, width: int) -> str:
    line = f"replace(trim(regexp_replace(regexp_replace({c}, '{UNSAFE}', '', 'g'), '\\s+', ' ', 'g'), ' '), '|', '/')"
    return f"(case when length({line}) > {width} then rtrim(left({line}, {width - 1})) || '…' else {line} end)"


LIBRARY = f"""ix as ({INDEX} select * from ix), ru as ({MEASURED} select item_id, category, score, reason from rules), {DUP},
sc as (select item_id, arg_min(row(url, title, favorited, from_shared_album, from_partner), sidecar_id) as s from {sidecars('item_id', 'url', 'title', 'favorited', 'from_shared_album', 'from_partner')} where item_id is not null group by 1),
it as (select ix.*, x.folder, x.make, x.model, x.width, x.height, x.file_size, s[1] as url, s[3] as favorited, s[4] as shared, s[5] as partner, case when s[2] = ix.filename then 'high' when sc.item_id is not null then 'low' end as match_conf from ix join {photos('folder', 'make', 'model', 'width', 'height', 'file_size')} x on x.item_id = ix.item_id left join sc on sc.item_id = ix.item_id),
gu as (select d.group_id, count(distinct it.url) >= 2 as deletable from d join it on it.item_id = d.item_id group by 1),
un as (select d.item_id, d.group_id, not deletable as unc, d.is_keeper = 0 and (not deletable or coalesce(it.url, '') = '' or coalesce(kt.url, '') = '' or it.url = kt.url) as same from d join gu on gu.group_id = d.group_id join it on it.item_id = d.item_id left join it kt on kt.item_id = d.group_id),
fl as (select item_id, string_agg(category || ':' || printf('%.2f', score), ' ' order by score desc, category) filter (where n <= 3) as flags, list(json_object('category', category, 'score', printf('%.2f', score), 'reason', {clean_sql('reason', 120)}) order by score desc, category) as scored from (select *, row_number() over (partition by item_id order by score desc, category) as n from ru where score > 0) group by 1)"""
ATTRS = "list_filter([case when coalesce(shared, 0) <> 0 then 'shared' end, case when coalesce(partner, 0) <> 0 then 'partner' end, case when coalesce(favorited, 0) <> 0 then 'fav' end, case when coalesce(url, '') = '' then 'nolink' end], lambda x: x is not null)"
_stem = name_sql("it.filename")["stem"]
CARDS = f"""with {LIBRARY}, bu as (with {SHOTS} select item_id, burst, choice from k),
ca as (select it.item_id, {clean_sql('it.filename', 120)} as filename, case when local_date is null then 'undated' else local_date || ' ' || left(local_time, 5) || case when day_uncertain = 1 then '~' else '' end end as taken,
 case when url is not null then url when {_stem} <> '' then 'https://photos.example/search/' || url_encode({_stem}) end as photos_url, case when url is not null then case when match_conf = 'high' then 'high' else 'low' end when {_stem} <> '' then 'low' else 'none' end as link_conf,
 coalesce(fl.flags, '') as flags, array_to_string({ATTRS}, ',') as attrs,
 case when d.item_id is null and bu.item_id is null then '-' else concat_ws(',', 'dup' || d.group_id || case when un.unc then '?' else '' end || case when d.is_keeper = 1 then ':keeper' else '' end, 'burst' || bu.burst || case when bu.choice = 1 then ':best' else '' end) end as tag,
 cast(coalesce(un.unc, false) as integer) as possible_same, cast(coalesce(un.same, false) as integer) as maybe_same, cast(coalesce(shared, 0) <> 0 or coalesce(partner, 0) <> 0 or coalesce(favorited, 0) <> 0 or coalesce(un.unc, false) as integer) as protected, case when favorited = 1 then 'approved' end as queue_status
 from it left join fl on fl.item_id = it.item_id left join d on d.item_id = it.item_id left join bu on bu.item_id = it.item_id left join un on un.item_id = it.item_id)"""
ORACLES["item_cards"] = f"{CARDS} select * from ca"
ORACLES["sheet_legend"] = f"{CARDS}, pg as (select *, row_number() over (order by item_id) as n from ca order by item_id limit 48) select n, concat_ws(' | ', n, '#' || item_id, taken, filename, case when flags = '' then '-' else flags end, case when attrs = '' then '-' else attrs end, tag) as line from pg"
ORACLES["item_details"] = f"""with {LIBRARY}, gs as (select group_id, count(*) as size from d group by 1)
select it.item_id, cast(json_object('id', it.item_id, 'date', local_date, 'time', local_time, 'day_uncertain', coalesce(day_uncertain, 0) <> 0, 'size', coalesce(it.width, 0) || 'x' || coalesce(it.height, 0), 'file_kb', cast(round_even(coalesce(it.file_size, 0) / 1024.0, 0) as bigint), 'flags', {ATTRS}, 'scores', coalesce(fl.scored, []),
 'duplicate_group', case when d.item_id is not null then json_object('group_id', d.group_id, 'size', gs.size, 'keeper_id', d.group_id, 'uncertain', coalesce(un.unc, false), 'maybe_same_item_as_keeper', coalesce(un.same, false)) end,
 'untrusted_text', json_object('filename', {clean_sql('it.filename', 120)}, 'folder', {clean_sql('it.folder', 120)}, 'camera', case when concat_ws(' ', make, model) <> '' then {clean_sql("concat_ws(' ', make, model)", 120)} end)) as varchar) as details
from it left join fl on fl.item_id = it.item_id left join d on d.item_id = it.item_id left join gs on gs.group_id = d.group_id left join un on un.item_id = it.item_id"""
ORACLES["uncertain_groups"] = f"with {LIBRARY} select item_id, group_id, cast(unc as integer) as uncertain_group, cast(same as integer) as maybe_same from un"
ORACLES["queue_pages"] = f"""with ix as ({INDEX} select * from ix), qu as (select 'x:' || item_id as item_uid, item_id, min(sidecar_id) as proposed_at from {sidecars('item_id', 'favorited')} where item_id is not null and favorited = 1 group by 1, 2), j as (select qu.item_uid, ix.item_id, proposed_at, local_date, local_time from qu left join ix on ix.item_id = qu.item_id)
(select item_uid, 'approved' as status, local_date from j order by local_date is null, local_date, coalesce(local_time, ''), item_id is null, item_id, item_uid limit 40 offset 10) union all (select item_uid, 'proposed', local_date from j order by proposed_at, item_uid limit 20 offset 5)"""
ORACLES["event_log"] = "select event_id as seq, event_type as action from events order by date_trunc('hour', ts) desc, event_id desc limit 100"
ORACLES["burst_pages"] = f"with {SHOTS}, pg as (select distinct burst from k order by burst limit 20) select k.burst, k.item_id, cast(choice = 1 as integer) as is_best, p.filename from k join pg on pg.burst = k.burst join {photos('filename')} p on p.item_id = k.item_id"
ORACLES["library_summary"] = f"""with ix as ({INDEX} select * from ix), ru as ({MEASURED} select * from rules), {DUP}, su as (select {unix_sql('taken_ts')} as ts from {sidecars('item_id', 'taken_ts')} where item_id is null)
select 'items' as key, count(*) as value from ix union all select 'with_vector', count(emb_row) from ix left join items on items.item_id = ix.item_id union all select 'undated', count(*) from ix where local_date is null union all select 'unindexed', count(ts) from su
union all select 'year:' || coalesce(cast(year as varchar), 'unknown'), count(*) from ix group by year union all select 'groups:exact', count(distinct group_id) from d having count(*) > 0 union all select 'category:' || category, count(*) from ru where score >= 0.5 group by category"""
_sc_keys = ("title", "taken_ts", "creation_ts", "lat", "url", "description", "people", "origin_folder", "device_type", "from_shared_album", "from_partner", "favorited", "archived", "trashed")
_there = lambda c: f"count(*) filter (where {c} is not null and cast({c} as varchar) not in ('', '0'))"
ORACLES["scan_survey"] = f"""with sv as (select * from {sidecars(*_sc_keys)}), pv as (select * from {photos('exif_dt', 'exif_offset', 'has_camera_exif', 'exif_lat', 'err')})
select 'sidecars' as key, count(*) as n from sv union all {' union all '.join(f"select 'sc_{c}', {_there(c)} from sv" for c in _sc_keys)}
union all select 'items', count(*) from pv union all {' union all '.join(f"select '{c}', {_there(c)} from pv" for c in ('exif_dt', 'exif_offset'))} union all select 'exif_camera', count(*) filter (where has_camera_exif = 1) from pv union all select 'exif_gps', count(exif_lat) from pv union all select 'item_errors', {_there('err')} from pv
union all select concat_ws(':', 'member', kind, reason), count(*) from ({CLASSIFY}) group by kind, reason"""
ORACLES["quota_hours"] = "select event_id, cast(hour(timezone('UTC', timezone('America/Los_Angeles', date_trunc('day', timezone('America/Los_Angeles', timezone('UTC', ts))) + interval 1 day))) as integer) as hour from events"
FOLD = ORACLES["queue_fold"]
ORACLES["queue_log"] = FOLD[: FOLD.index("r as (select")] + """r as (select item_uid, cast(0 as bigint) as i, cast(null as bigint) as seq, cast(null as varchar) as action, cast(null as varchar) as status, cast(null as varchar) as first_, cast(null as varchar) as was, false as changed, cast(0 as bigint) as rev from (select distinct item_uid from e)
 union all select item_uid, i, seq, action, status, case when status is not null then first_ end, old, (status, case when status is not null then first_ end) is distinct from (old, old_first), rev + cast((status, case when status is not null then first_ end) is distinct from (old, old_first) as bigint) from (
  select r.item_uid, e.i, e.seq, e.action, r.status as old, r.first_ as old_first, r.rev,
   case when e.action = 'propose' then coalesce(r.status, 'proposed') when e.action = 'add' then 'approved' when r.status is null then null when e.action = 'approve' then 'approved' when e.action = 'reject' then 'rejected' when r.first_ = 'user' then null else 'proposed' end as status,
   case when r.first_ is not null then r.first_ when e.action = 'propose' then 'a' when e.action = 'add' then 'user' end as first_
  from r join e on e.item_uid = r.item_uid and e.i = r.i + 1)) select item_uid, seq, action, 'a' as actor, status, was, rev from r where changed"""
ORACLES["batch_decisions"] = """with p as (select event_type as batch_id, cast(user_id as varchar) as item_uid, min(event_id) as proposed from events where event_id % 5 = 0 group by 1, 2)
select cast(user_id as varchar) as item_uid, event_id as seq, 'approve' as action, event_type as batch_id from events where event_id % 997 <> 0 and event_id % 5 = 1
union all select p.item_uid, e.event_id, 'reject', p.batch_id from events e join p on p.batch_id = e.event_type and proposed < e.event_id where e.event_id % 997 = 0"""
_cut100 = "left(text, list_max(list_filter(range(0, 101), lambda i: octet_length(encode(left(text, i))) <= 100)))"
ORACLES["text_forms"] = f"""select doc_id, replace(lower(nfc_normalize(text)), 'ß', 'ss') as folded, case when octet_length(encode(text)) <= 100 then text else {_cut100} end as bytes100, case when length({SAFE}) between 3 and 300 then {SAFE} end as reason,
 coalesce(nullif(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 32), ''), 'client') as slug, strftime(epoch_ms((1700000000 + doc_id * 86400) * 1000) + interval 30 day, '%Y-%m-%d') as until, url_encode(left(text, 50)) as quoted from documents where text is not null"""
_geo = "lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)"
_bare = "nullif(regexp_replace(title, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '')"
ORACLES["sidecar_documents"] = f"""select sidecar_id, {_bare} as title, {unix_sql('taken_ts')} as taken_ts, {unix_sql('creation_ts')} as creation_ts, case when {_geo} then lat end as lat, case when {_geo} then lon end as lon, case when {_geo} then alt end as alt,
 case when trim(description) <> '' then description end as description, case when trim(device_type) <> '' then device_type end as device_type, cast(coalesce(from_partner = 1, false) as integer) as from_partner, cast(coalesce(favorited = 1, false) as integer) as favorited, cast(coalesce(trashed = 1, false) as integer) as trashed, '' as err
 from {sidecars('title', 'taken_ts', 'creation_ts', 'lat', 'lon', 'alt', 'description', 'device_type', 'favorited', 'trashed', 'from_partner')}"""
ORACLES["search_scored"] = f"with ix as ({INDEX} select * from ix), ru as ({MEASURED} select item_id, max(score) as score from rules group by 1) select ix.item_id, local_date, score from ix join ru on ru.item_id = ix.item_id where score >= 0.6 and local_date <= '2019-12-31' and not (lat is not null and lon is not null) order by score desc, local_date, local_time, ix.item_id limit 100"
ORACLES["search_total"] = f"{INDEX}, t as (select count(*) as total from ix where contains(lower(filename), 'img') and year = 2018) select total, case when total > 10 then 10 end as next_offset from t"
ORACLES["search_group"] = f"with {DUP} select item_id from d where group_id = (select min(group_id) from d)"
ORACLES["junk_pages"] = f"with ix as ({INDEX} select * from ix), ru as ({MEASURED} select item_id, score from rules where category = 'tiny' and score >= 0.5) select ix.item_id, score from ix join ru on ru.item_id = ix.item_id order by score desc, local_date is null, local_date, local_time, ix.item_id limit 20 offset 5"
ORACLES["queue_counts"] = f"select count(*) filter (where status = 'proposed') as proposed, count(*) filter (where status = 'approved') as approved, count(*) filter (where status = 'rejected') as rejected, count(*) filter (where status = 'deleted') as deleted from ({FOLD})"
ORACLES["queue_rows"] = f"with ix as ({INDEX} select * from ix), q as (select distinct item_id from {sidecars('item_id')} where item_id is not null) select 'x:' || q.item_id as item_uid, ix.item_id, local_date from q left join ix on ix.item_id = q.item_id"
ORACLES["extended_plan"] = "with p as (select zip_id, zipkey from zips where zip_id % 3 > 0), n as (select zipkey, row_number() over (order by zipkey) as k from zips where zip_id > 1 and zip_id % 3 = 0) select zip_id as shard_id, zipkey, cast(zip_id > 1 as integer) as present from p union all select k + (select max(zip_id) from p), zipkey, 1 from n"
ORACLES["snapshot_round_trip"] = "select item_id, item_uid, year from items"
