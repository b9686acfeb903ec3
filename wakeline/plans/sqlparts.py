"""Common table expressions of the SQL forms (DuckDB dialect)."""

PINGS = """
pings as (
  select event_id as ping_seq, 200000000::BIGINT + user_id as MMSI, epoch_us(ts) as us,
    35.0::DOUBLE + ((event_id * 37) % 400)::DOUBLE / 100.0::DOUBLE as Lat,
    11.0::DOUBLE + ((event_id * 53) % 500)::DOUBLE / 100.0::DOUBLE as Lon,
    value / 4.0::DOUBLE as SOG,
    regexp_extract(props, '([0-9]+)', 1)::DOUBLE * 3.6::DOUBLE as COG
  from events)"""

ITEMS = """
items as (
  select (l_orderkey * 10 + l_linenumber) * 1000 + l_partkey % 1000 as ping_seq, 300000000::BIGINT + l_suppkey as MMSI,
    epoch_us(l_shipdate) + (l_orderkey % 4) * 21600000000 as us,
    34.5::DOUBLE + (l_partkey % 400)::DOUBLE / 100.0::DOUBLE as Lat,
    11.0::DOUBLE + (l_orderkey % 500)::DOUBLE / 100.0::DOUBLE as Lon,
    l_quantity + 2.0::DOUBLE as SOG, (l_orderkey % 370)::DOUBLE as COG
  from lineitem)"""

DIRTY = """
dirty as (
  select ping_seq, us,
    case when ping_seq % 17 = 0 then 'x' || MMSI when ping_seq % 19 = 0 then MMSI || '.0'
      else MMSI::VARCHAR end as id_text,
    case when ping_seq % 23 = 0 then 'nan'::DOUBLE else Lat end as Lat,
    case when ping_seq % 29 = 0 then 'inf'::DOUBLE else Lon end as Lon,
    case when ping_seq % 31 = 0 then 'nan'::DOUBLE when ping_seq % 37 = 0 then null else SOG end as SOG,
    case when ping_seq % 41 = 0 then '-inf'::DOUBLE else COG end as COG
  from pings)"""


def kept(source: str, name: str = "kept") -> str:
    return f"""
{name} as (
  select * from {source}
  where Lat >= 35.0 and Lat <= 38.0 and Lon >= 11.0 and Lon <= 15.5
    and SOG >= 0 and SOG <= 50 and COG >= 0 and COG <= 360)"""


def first_rows(source: str, name: str = "firsts") -> str:
    return f"""
{name} as (
  select * from {source} qualify row_number() over (partition by MMSI, us order by ping_seq) = 1)"""


def binned(source: str, name: str = "binned", minutes: int = 360) -> str:
    w = minutes * 60_000_000
    return f"""
{name} as (
  select MMSI, us - us % {w} as us, Lat, Lon, SOG, COG from {source}
  qualify row_number() over (partition by MMSI, us - us % {w} order by us desc, ping_seq desc) = 1)"""


def wrap(d: str) -> str:
    r = f"(({d}) + 180.0::DOUBLE) % 360.0::DOUBLE"
    return f"(case when {r} < 0 then ({r} + 360.0::DOUBLE) % 360.0::DOUBLE else {r} end - 180.0::DOUBLE)"


def feats(source: str = "binned", name: str = "feats") -> str:
    return f"""
{name}_d as (
  select *, (us - lag(us) over w)::DOUBLE / 3600000000.0::DOUBLE as dt,
    SOG - lag(SOG) over w as ds, COG - lag(COG) over w as dc_raw
  from {source} window w as (partition by MMSI order by us)),
{name}_w as (select *, {wrap('dc_raw')} as dc from {name}_d),
{name} as (
  select MMSI, us, Lat, Lon, SOG, COG, coalesce(dt, 0) as dt_prev_hours, coalesce(ds, 0) as delta_SOG,
    coalesce(dc, 0) as delta_COG,
    case when dt is null or dt = 0 then 0 else least(greatest(ds / dt, -15.0::DOUBLE), 15.0::DOUBLE) end as speed_acc,
    case when dt is null or dt = 0 then 0 else least(greatest(dc / dt, -180.0::DOUBLE), 180.0::DOUBLE) end as turn_rate
  from {name}_w)"""


FEATURES = (PINGS, kept("pings"), binned("kept"), feats())

GAPS = """
gaps as (
  select *, (us - lag(us) over (partition by MMSI order by us, ping_seq))::DOUBLE / 60000000.0::DOUBLE / 60.0::DOUBLE as gap_h,
    (lead(us) over (partition by MMSI order by us, ping_seq) - us)::DOUBLE / 3600000000.0::DOUBLE as next_h
  from pings)"""

LASTLABEL = """
labelled as (
  select *, (next_h >= 12.0 and next_h <= 36.0)::INTEGER as y from gaps where next_h is not null)"""

SLIDELABEL = """
slid as (
  select g.*, coalesce(max((next_h >= 12.0)::INTEGER) over (
      partition by MMSI order by us range between 1 following and 86400000000 following), 0) as y
  from gaps g)"""

SCORED = (PINGS, GAPS, LASTLABEL, """
scored as (
  select MMSI, us, ping_seq, SOG, COG, y, 1.0::DOUBLE / (SOG + 1.0::DOUBLE) as score_a,
    (ping_seq * 7919 % 1000)::DOUBLE / 1000.0::DOUBLE as score_b from labelled)""")

DOCS = """
docs as (
  select l.doc_id as MMSI, l.toxic as y, (d.n_chars % 97)::DOUBLE / 97.0::DOUBLE as score
  from labels l join documents d using (doc_id))"""


def cumulated(source: str, score: str, name: str = "cum", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    return f"""
{name}_c as (
  select {k}{score} as score, sum(y)::BIGINT as pos, sum(1 - y)::BIGINT as neg from {source}
  group by {k}{score}),
{name} as (
  select *, sum(pos) over (w order by score desc)::BIGINT as tp, sum(neg) over (w order by score desc)::BIGINT as fp,
    sum(pos) over (w)::BIGINT as n_pos, sum(neg) over (w)::BIGINT as n_neg
  from {name}_c window w as ({part}))"""


AP = "sum((tp::DOUBLE / (tp + fp)) * (pos::DOUBLE / n_pos))"
AUC = "sum(neg * (tp - pos / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg))"

VESSELS = """
vessels as (
  select MMSI, row_number() over (order by md5('42-' || MMSI), MMSI) as rank, count(*) over () as n
  from (select distinct MMSI from pings))"""

# rows of the regime model: t from 0, n rows, scaled inputs
def standardised(name: str = "rows_", window: int = 12) -> str:
    return f"""
{name}n as (
  select *, row_number() over (partition by MMSI order by us) - 1 as t, count(*) over (partition by MMSI) as n
  from feats),
{name}s as (
  select MMSI, avg(speed_acc) as ms, stddev_pop(speed_acc) as ss, avg(turn_rate) as mt, stddev_pop(turn_rate) as st
  from {name}n where t < least({3 * window}, n // 3) group by MMSI),
{name}f as (
  select MMSI, avg(speed_acc) as ms, stddev_pop(speed_acc) as ss, avg(turn_rate) as mt, stddev_pop(turn_rate) as st
  from {name}n group by MMSI),
std_c as (
  select r.MMSI, us, t, n, (speed_acc - ms) / (case when ss = 0 then 1 else ss end) as x,
    (turn_rate - mt) / (case when st = 0 then 1 else st end) as v
  from {name}n r left join {name}s using (MMSI)),
std_f as (
  select r.MMSI, us, t, n, (speed_acc - ms) / (case when ss = 0 then 1 else ss end) as x,
    (turn_rate - mt) / (case when st = 0 then 1 else st end) as v
  from {name}n r left join {name}f using (MMSI))"""
