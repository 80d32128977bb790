"""DuckDB SQL by brute force for the training-data queries that SQL can express on small tables."""

from __future__ import annotations


def latest(table: str, key: str, *fields: str) -> str:
    cols = ", ".join(f"arg_max({f}, scanned_at) filter (where {f} is not null) as {f}" for f in fields)
    return f"(select {key}, {cols} from {table} where {key} is not null group by {key})"


LINKS = f"""with recursive p as materialized (select * from {latest("items_raw", "item_id", "sha256", "phash64")}),
e as materialized (select a.item_id as a, b.item_id as b from p a join p b on a.sha256 = b.sha256 and a.item_id <> b.item_id
 union select a.item_id, b.item_id from p a join p b on a.item_id <> b.item_id and a.phash64 <> 0 and b.phash64 <> 0 and bit_count(xor(a.phash64, b.phash64)) <= 3),
r as (select a as v, a as u from e union select r.v, e.b from r join e on e.a = r.u),
g as (select min(u) as group_item_id, v as item_id from r group by v)"""
ORACLES = {
    "p2_found": f"{LINKS} select group_item_id, item_id from g",
    "p1_found": f"""{LINKS}, m as (select * from {latest("items_raw", "item_id", "width", "height", "stored_w", "stored_h", "has_camera_exif", "exif_lat", "exif_lon", "file_size")}),
f as (select item_id from {latest("sidecars_raw", "sidecar_id", "item_id", "favorited")} where favorited = 1 and item_id is not null group by 1),
k as (select g.group_item_id, m.item_id, row_number() over (partition by g.group_item_id order by case when width > 0 and height > 0 then cast(width as bigint) * height when stored_w > 0 and stored_h > 0 then cast(stored_w as bigint) * stored_h else 0 end desc,
 coalesce(has_camera_exif = 1, false) desc, coalesce(exif_lat is not null and exif_lon is not null and not (exif_lat = 0 and exif_lon = 0), false) desc, (f.item_id is not null) desc, greatest(coalesce(file_size, 0), 0) desc, m.item_id) as n
 from g join m on m.item_id = g.item_id left join f on f.item_id = m.item_id) select group_item_id, item_id as keeper_item_id from k where n = 1""",
    "p4_found": """with v as materialized (select emb_row, list_transform(emb, lambda x: cast(x as double)) as e from emb_matrix where emb_row in (select emb_row from items)),
u as materialized (select emb_row, list_transform(e, lambda x: x / n) as e from (select *, sqrt(list_dot_product(e, e)) as n from v) where n > 0),
s as (select a.emb_row as a, b.emb_row as b, list_dot_product(a.e, b.e) as cos from u a join u b on a.emb_row <> b.emb_row and list_dot_product(a.e, b.e) >= 0.9),
t as (select *, row_number() over (partition by a order by round(cos, 12) desc, b) as r from s) select distinct least(a, b) as emb_row_a, greatest(a, b) as emb_row_b from t where r <= 10""",
}
