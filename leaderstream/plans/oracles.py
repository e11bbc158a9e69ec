"""The queries of ``registry`` as SQL for an independent engine."""

from __future__ import annotations

from leaderstream.metrics import STAT_PAGES
from leaderstream.operators.prompts import INVALID_REQUEST, PROMPT, SECTION
from leaderstream.plans.fixtures import EVENT_METRICS, LINE_METRICS, STATE_DAYS


def _case(value: str, names: dict[str, str]) -> str:
    return f"case {value} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + " end"


_SAFE = "regexp_replace(lower(trim(stat_category)), '[^a-zA-Z0-9]', '_', 'g')"

_IND = f"""
ind as (
  select event_id as "offset", date_diff('day', date '2024-01-01', cast(ts as date)) as batch_id,
         {_case("event_type", EVENT_METRICS)} as stat_category,
         'individual_' || {_SAFE} as table_name,
         case when user_id >= 3 then 'Player ' || cast(user_id as varchar) end as "Name",
         'Team ' || cast(cast(props->>'$.k' as int) % 5 as varchar) as "Team",
         case when cast(props->>'$.k' as int) % 4 = 0 then ''
              else 'Cl ' || cast(cast(props->>'$.k' as int) % 4 as varchar) end as "Cl",
         cast(cast(props->>'$.k' as int) % 3 as varchar) as "Position",
         cast(cast(value as decimal(18,2)) as varchar) as "Value",
         strftime(ts, '%Y-%m-%d %H:%M:%S') as event_time,
         cast(props->>'$.k' as int) as k
  from events)"""

_TEAM = f"""
team as (
  select l_orderkey * 8 + l_linenumber as "offset", cast(year(l_shipdate) - 1995 as bigint) as batch_id,
         {_case("l_returnflag || l_linestatus", LINE_METRICS)} as stat_category,
         'team_' || {_SAFE} as table_name,
         'Supplier ' || cast(l_suppkey as varchar) as "Team",
         cast(cast(l_extendedprice as decimal(18,2)) as varchar) as "Value",
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as event_time
  from lineitem)"""

_IND_FIELD = (
    "case stat_category when 'Slugging Percentage' then 'SLG PCT' "
    "when 'Strikeouts Per Nine Innings' then 'K/9' when 'Earned Run Average' then 'ERA' "
    "when 'WHIP' then 'WHIP' else 'Value' end"
)
_TEAM_FIELD = (
    "case stat_category when 'WL Pct' then 'PCT' when 'Fielding Percentage' then 'PCT' "
    "when 'Earned Run Average' then 'ERA' when 'WHIP' then 'WHIP' "
    "when 'Slugging Percentage' then 'SLG PCT' else 'Value' end"
)
_IND_PAYLOAD = f"""('{{' || case when "Name" is null then '' else '"Name":"' || "Name" || '",' end
  || '"Team":"' || "Team" || '","Cl":"' || "Cl" || '","Position":"' || "Position" || '","'
  || {_IND_FIELD} || '":"' || "Value" || '"}}')"""
_TEAM_PAYLOAD = f"""('{{"Team":"' || "Team" || '","' || {_TEAM_FIELD} || '":"' || "Value" || '"}}')"""

_IND_STATE = """
ind_state as (
  select * from ind
  qualify rank() over (partition by table_name, "Name", "Team" order by batch_id desc) = 1
       or "Name" is null or "Team" is null)"""
_TEAM_STATE = """
team_state as (
  select * from team qualify rank() over (partition by table_name, "Team" order by batch_id desc) = 1)"""

_ASC = "('individual_earned_run_average', 'individual_whip', 'team_earned_run_average', 'team_whip')"
_UNRANKED = "('individual_saves', 'team_saves')"


def _ranked(source: str, name: str, by: str, ties: str, kind: str = "integer", limit: str = "place <= 300") -> str:
    """Rows of a source with ``place`` and ``rank_`` per table, at most 300 unless another limit is given."""
    if by == "text":
        value = (
            f'case when table_name in {_ASC} then "Value" end asc nulls first, '
            f'case when table_name not in {_ASC} and table_name not in {_UNRANKED} then "Value" end desc nulls last'
        )
    else:
        value = (
            f'case when table_name in {_UNRANKED} then null when table_name in {_ASC} '
            f'then try_cast("Value" as double) else -try_cast("Value" as double) end asc nulls last'
        )
    return f"""
{name} as (
  select *, cast(case when table_name not in {_UNRANKED} then place end as {kind}) as "Rank" from (
    select *, cast(row_number() over (partition by table_name order by {value}, {ties}) as {kind}) as place
    from {source}) where {limit})"""


_IND_TIES = '"Name" asc nulls first, "Team" asc nulls first, "offset" asc'
_TEAM_TIES = '"Team" asc nulls first, "offset" asc, "Value" asc'


def _with(*ctes: str) -> str:
    return "with " + ",".join(ctes) + "\n"


def _chosen(*facets: str, prefix: str = "") -> str:
    """Columns of a cube, empty where a facet is not chosen."""
    columns = (f"""case when grouping("{c}") = 1 then '' else "{c}" end as "{(prefix + c.lower()) if prefix else c}\"""" for c in facets)
    return ", ".join(columns)


def _any_or_given(*facets: str) -> str:
    return " and ".join(f"""(grouping("{c}") = 1 or "{c}" <> '')""" for c in facets)


_PLAYER = 'table_name, "Name", "Team", "Cl", "Position", "Value"'

_QUOTED = """coalesce('"' || {0} || '"', 'null')"""
_IND_RECORD = (
    "'{\"Name\":' || " + _QUOTED.format('"Name"') + " || ',\"Team\":' || " + _QUOTED.format('"Team"')
    + " || ',\"Cl\":' || " + _QUOTED.format('"Cl"') + " || ',\"Position\":' || " + _QUOTED.format('"Position"')
    + " || ',\"Value\":' || " + _QUOTED.format('"Value"')
    + " || coalesce(',\"Rank\":' || cast(\"Rank\" as varchar), '') || '}'"
)
_TEAM_RECORD = (
    "'{\"Team\":\"' || \"Team\" || '\",\"Value\":\"' || \"Value\" || '\"' "
    "|| coalesce(',\"Rank\":' || cast(\"Rank\" as varchar), '') || '}'"
)

# Upper-case each letter after a non-letter; names are ASCII here.
_TITLE = (
    "list_reduce(list_transform(string_split({0}, ''), lambda c: c), lambda a, c: "
    "a || case when regexp_matches(a, '[a-zA-Z]$') then lower(c) else upper(c) end, '')"
)


def _snapshot_cte(by: str, name: str) -> str:
    title = _TITLE.format("replace(table_name, '_', ' ')")
    return f"""
{name} as (
  select table_name, {title} as category,
         '{{"category":"' || {title} || '","rows":[' || string_agg(record, ',' order by place) || ']}}' as snapshot
  from (select table_name, place, {_IND_RECORD} as record from ind_{by}
        union all select table_name, place, {_TEAM_RECORD} as record from team_{by})
  group by table_name)"""


def _boards(by: str) -> tuple[str, str]:
    return _ranked("ind", f"ind_{by}", by, _IND_TIES), _ranked("team", f"team_{by}", by, _TEAM_TIES)


_NUMBER = r"""try_cast(nullif(regexp_extract("Value", '^\s*([-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?)', 1), '') as double)"""

_PART = f"""
parts as (
  select *, 'individual_' || {_SAFE} as table_name from (
    select p_type as stat_category, 'Part ' || cast(p_partkey as varchar) as "Name", p_partkey,
           case when p_partkey % 3 = 0 then cast(p_size as varchar) else p_brand end as "Value", p_brand as "Team"
    from part)),
served as (
  select *, row_number() over (partition by table_name order by "Name", "Team", p_partkey) as place
  from parts qualify place <= 300)"""

_ASKED = r"""
requests as (
  select cast(conv_id as varchar) || ':' || cast(turn as varchar) as question_id,
         regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') as query,
         case when conv_id % 7 = 0 then 'player' when role = 'user' then 'individual' else 'team' end as type
  from conversations),
asked as (select *, list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: w <> '') as words
          from requests where query <> '' and type in ('individual', 'team')),
tables as (select distinct table_name from ind union select distinct table_name from team),
scores as (
  select question_id, table_name,
         cast(len(list_filter(words, lambda w: contains(table_name, w))) as bigint) as score
  from asked join tables on starts_with(table_name, type)),
picks as (
  select *, cast(row_number() over (partition by question_id order by score desc, table_name) as integer) as place
  from scores qualify place <= 5)"""


def _dump(columns: tuple[str, ...]) -> str:
    """A record as indented JSON text, two levels deep in a list."""
    fields = [f"""'    "{c}": ' || """ + _QUOTED.format(f'"{c}"') for c in columns]
    return "'  {\n' || " + " || ',\n' || ".join(fields) + " || '\n  }'"


_IND_DUMP = _dump(("Name", "Team", "Cl", "Position", "Value"))
_TEAM_DUMP = _dump(("Team", "Value"))

_SECTION = SECTION.split("%s")
_SECTIONS = f"""
sections as (
  select table_name, '{_SECTION[0]}' || {_TITLE.format("replace(table_name, '_', ' ')")} || '{_SECTION[1]}[\n'
         || string_agg(record, ',\n' order by place) || '\n]' as section
  from (select table_name, place, {_IND_DUMP} as record from ind_number where place <= 20
        union all select table_name, place, {_TEAM_DUMP} as record from team_number where place <= 20)
  group by table_name)"""

_LINKS = r"""
links as (
  select page_id, unnest(names) as "Name", unnest(range(1, len(names) + 1)) as row_no
  from (select page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) as names from pages)),
html_rows as (
  select page_id, cast(row_no as integer) as row_no, trim("Name") as "Name", trim("Name") || ' & Co' as "Team",
         '.' || cast(page_id as varchar) as "BA" from links)"""

_STAT_PAGES = ", ".join(f"({i}, '{e}', '{m}', '{p}')" for i, (e, m, p) in enumerate(STAT_PAGES))

_UPSERT_IND = _with(_IND, _IND_STATE) + f'select "offset", {_PLAYER}, batch_id from ind_state'
_UPSERT_TEAM = _with(_TEAM, _TEAM_STATE) + 'select "offset", table_name, "Team", "Value", batch_id from team_state'
_LATEST_IND = (
    _with(_IND)
    + f"""select {_PLAYER}, event_time, "offset" from ind where "Name" is not null and "Team" is not null
qualify row_number() over (partition by table_name, "Name", "Team" order by event_time desc, "offset" desc) = 1"""
)

# Six days are a batch of the stream.
_WEEKLY = "weekly as (select * replace (cast(batch_id // 6 as bigint) as batch_id) from ind)"
_UPSERT_WEEKLY = (
    _with(_IND, _WEEKLY)
    + f'''select "offset", {_PLAYER}, batch_id from weekly
qualify rank() over (partition by table_name, "Name", "Team" order by batch_id desc) = 1
     or "Name" is null or "Team" is null'''
)
_QUARANTINE = (
    _with(_IND)
    + """select case when k % 10 in (0, 1) then 'bad_envelope' when k % 10 = 2 then 'no_payload'
            when k % 10 = 3 then 'no_category' when k % 10 = 4 or "Name" is null then 'null_key' end as reason,
       count(*) as messages from ind group by 1 having reason is not null"""
)

SQL: dict[str, str] = {
    "envelope_parse": _with(_IND)
    + f"""select "offset", stat_category, 'player' as stat_type, event_time, {_IND_PAYLOAD} as player_stats,
       cast(null as varchar) as team_stats from ind""",
    "payload_flatten": _with(_IND) + f'select "offset", {_PLAYER}, event_time from ind',
    "payload_flatten_team": _with(_TEAM) + 'select "offset", table_name, "Team", "Value", event_time from team',
    "payload_routing": _with(_IND, _TEAM)
    + f"""select 'individual' as entity_type, "offset", stat_category, {_IND_PAYLOAD} as payload from ind
union all select 'team' as entity_type, "offset", stat_category, {_TEAM_PAYLOAD} as payload from team""",
    "quarantine_counts": _QUARANTINE,
    "column_guard": _with(_IND) + f'select "offset", {_PLAYER} from ind',
    "empty_table": _with(_TEAM) + 'select "offset", table_name, "Team", "Value" from team',
    "batch_categories": _with(_IND, _TEAM)
    + """select distinct 'individual' as entity_type, batch_id, stat_category from ind
union all select distinct 'team' as entity_type, batch_id, stat_category from team""",
    "event_out": _with(_IND)
    + f"""select "offset", '{{"stat_category":"' || stat_category || '","stat_type":"player","timestamp":"' || event_time
       || '","player_stats":' || {_IND_PAYLOAD} || '}}' as value from ind""",
    "table_names": _with(_IND, _TEAM)
    + f""", categories as (
  select distinct ' ' || p_brand || ' K/9x ' || p_type || chr(9) as category from part
  union select stat_category from ind union select stat_category from team),
named as (select category, 'team_' || regexp_replace(lower(trim(category, chr(32) || chr(9))), '[^a-zA-Z0-9]', '_', 'g')
          as table_name from categories),
titled as (select *, {_TITLE.format("replace(table_name, '_', ' ')")} as title from named)
select category, table_name,
       case when contains(title, 'Whip') then 'WHIP' when contains(title, 'Wl Pct') then 'WL Pct'
            else regexp_replace(title, '^Team ', '') end as metric,
       title, regexp_replace(replace(table_name, '_', ' '), '^team ', '') as label,
       'section-' || regexp_replace(lower(title), '\\s+', '-', 'g') as section,
       coalesce(nullif(regexp_extract(category, 'Brand#[0-9]+'), ''), 'Unknown') as brand from titled""",
    "list_tables": _with(_IND, _TEAM)
    + "select distinct table_name from ind union all select distinct table_name from team",
    "anti_join_keys": _with(_IND)
    + f"""select "offset", {_PLAYER} from ind s where batch_id < (select max(batch_id) from ind)
  and not exists (select 1 from ind b where b.batch_id = (select max(batch_id) from ind)
                  and b.table_name = s.table_name and b."Name" = s."Name" and b."Team" = s."Team")""",
    "upsert_one_batch": _with(_TEAM)
    + """, newest as (select * from team where batch_id = (select max(batch_id) from team))
select "offset", table_name, "Team", "Value", batch_id from newest
union all select "offset", table_name, "Team", "Value", batch_id from team
where batch_id < (select max(batch_id) from team)
  and (table_name, "Team") not in (select (table_name, "Team") from newest)""",
    "upsert_individual": _UPSERT_IND,
    "upsert_team": _UPSERT_TEAM,
    "upsert_latest": _with(_TEAM)
    + """select table_name, "Team", "Value", event_time, "offset" from team
qualify row_number() over (partition by table_name, "Team"
                           order by event_time desc, "offset" desc, "Value" desc) = 1""",
    "upsert_latest_individual": _LATEST_IND,
    "rank_lexicographic": _with(_IND, _IND_STATE, _ranked("ind_state", "board", "text", _IND_TIES))
    + f'select {_PLAYER}, "Rank", "offset" from board',
    "rank_numeric": _with(_TEAM, _TEAM_STATE, _ranked("team_state", "board", "number", _TEAM_TIES))
    + 'select table_name, "Team", "Value", "Rank", "offset" from board',
    "rank_all_rows": _with(
        _IND,
        _IND_STATE,
        _TEAM,
        _TEAM_STATE,
        _ranked("ind_state", "players", "number", _IND_TIES, "bigint", "true"),
        _ranked("team_state", "teams", "number", _TEAM_TIES, "bigint", "true"),
    )
    + f"""select {_PLAYER}, "Rank", place, "offset" from players
union all select table_name, null, "Team", null, null, "Value", "Rank", place, "offset" from teams""",
    "validity_intervals": _with(_TEAM)
    + """select "offset", table_name, "Team", "Value", batch_id, valid_to from team join (
  select table_name, "Team", batch_id, lead(batch_id) over (partition by table_name, "Team" order by batch_id) as valid_to
  from (select distinct table_name, "Team", batch_id from team)) using (table_name, "Team", batch_id)""",
    "states_at_times": _with(_IND)
    + f"""select as_of, "offset", {_PLAYER}, batch_id
from ind, (select cast(unnest([{", ".join(map(str, STATE_DAYS))}]) as bigint) as as_of) where batch_id <= as_of
qualify rank() over (partition by as_of, table_name, "Name", "Team" order by batch_id desc) = 1
     or "Name" is null or "Team" is null""",
    "as_of_lookup": _with(_IND)
    + """select l.as_of, i."offset", i.table_name, i."Name", i."Team", i."Cl", i."Position", i."Value", i.batch_id
from (select distinct table_name, "Name", "Team", batch_id - 7 as as_of from ind) l
asof join (select distinct table_name, "Name", "Team", batch_id from ind) b
  on l.table_name = b.table_name and l."Name" = b."Name" and l."Team" = b."Team" and l.as_of >= b.batch_id
join ind i on i.table_name = b.table_name and i."Name" = b."Name" and i."Team" = b."Team" and i.batch_id = b.batch_id""",
    "rank_all_text": _with(_TEAM, _ranked("team", "board", "text", _TEAM_TIES, "bigint", "true"))
    + 'select table_name, "Team", "Value", "Rank", place, "offset" from board',
    "leaderboard": _with(
        _IND,
        _IND_STATE,
        _TEAM,
        _TEAM_STATE,
        _ranked("ind_state", "players", "number", _IND_TIES),
        _ranked("team_state", "teams", "number", _TEAM_TIES),
    )
    + f"""select {_PLAYER}, "Rank" from players
union all select table_name, null, "Team", null, null, "Value", "Rank" from teams""",
    "unranked_limit": _with(_IND)
    + f"""select 'individual_wl_pct' as table_name, "Name", "Team", "Cl", "Position", "Value",
       cast(null as integer) as "Rank", "offset" from ind order by {_IND_TIES} limit 250""",
    "leaderboard_filtered": _with(_IND, _ranked("ind", "board", "number", _IND_TIES))
    + f"""select {_PLAYER}, "Rank" from board where "Team" = 'Team 1' and "Cl" = 'Cl 2'""",
    "facet_values": _with(_IND, _ranked("ind", "board", "number", _IND_TIES))
    + """select table_name, 'Team' as facet, "Team" as facet_value from board where "Team" <> ''
union select table_name, 'Cl', "Cl" from board where "Cl" <> ''
union select table_name, 'Position', "Position" from board where "Position" <> ''""",
    "facet_counts": _with(_IND, _IND_STATE)
    + f"""select table_name, {_chosen("Team", "Cl", "Position")}, count(*) as n from ind_state
group by table_name, cube("Team", "Cl", "Position") having {_any_or_given("Team", "Cl", "Position")}""",
    "facet_options": _with(_IND, _ranked("ind", "board", "number", _IND_TIES))
    + " union all by name ".join(
        f"""select table_name, '{facet}' as facet, "{facet}" as facet_value, '' as for_{facet.lower()},
       {_chosen(*others, prefix="for_")}, count(*) as n from board where "{facet}" <> ''
group by table_name, "{facet}", cube({", ".join(f'"{c}"' for c in others)}) having {_any_or_given(*others)}"""
        for facet, others in (("Team", ("Cl", "Position")), ("Cl", ("Team", "Position")), ("Position", ("Team", "Cl")))
    ),
    "numeric_aware_sort": _with(_PART)
    + f"""select table_name, "Name", "Value", 'up' as direction,
       cast(row_number() over (partition by table_name order by {_NUMBER} asc nulls last,
         case when {_NUMBER} is null then lower("Value") end asc nulls first, place) as integer) as sort_position
from served
union all
select table_name, "Name", "Value", 'down' as direction,
       cast(row_number() over (partition by table_name order by
         case when {_NUMBER} is null then lower("Value") end desc nulls last, {_NUMBER} desc nulls last, place)
         as integer) as sort_position
from served""",
    "table_by_name": _with(_TEAM, _ranked("team", "board", "text", _TEAM_TIES))
    + f"""select table_name, place, {_TEAM_RECORD} as record from board where table_name = 'team_whip'""",
    "table_view": _with(_IND)
    + """select "Name", "Team", "Cl", "Position", "Value" from ind
where table_name = 'individual_whip' and "Team" = 'Team 3'""",
    "snapshot_json": _with(_IND, _TEAM, *_boards("number"), _snapshot_cte("number", "snaps"))
    + "select table_name, category, snapshot from snaps",
    "latest_snapshot": _with(
        _IND, _TEAM, *_boards("number"), *_boards("text"), _snapshot_cte("number", "second"), _snapshot_cte("text", "first_")
    )
    + """select category, 2 as version, snapshot from second where starts_with(table_name, 'individual')
union all select category, 1 as version, snapshot from first_ where not starts_with(table_name, 'individual')""",
    "request_check": _with(_ASKED.split(",\nasked as")[0])
    + "select question_id, type, query <> '' and type in ('individual', 'team') as valid from requests",
    "relevance_scores": _with(_IND, _TEAM, _ASKED)
    + "select question_id, table_name, score from scores where score > 0",
    "relevance_top_tables": _with(_IND, _TEAM, _ASKED) + "select question_id, table_name, score, place from picks",
    "prompt_context": _with(_IND, _TEAM, *_boards("number"), _SECTIONS, _ASKED)
    + """, bodies as (
  select question_id, string_agg(section, '

' order by place) as body from picks join sections using (table_name) group by question_id)
select question_id, case when body is not null then """
    + "'{}' || query || '{}' || body || '{}'".format(*PROMPT.split("%s"))
    + f""" end as prompt,
case when body is null then '{INVALID_REQUEST}' end as message
from requests left join bodies using (question_id)""",
    "html_table_rows": _with(_LINKS) + 'select page_id, row_no, "Name", "Team", "BA" from html_rows',
    "page_events": _with(_LINKS)
    + """select page_id, row_no, '{"stat_category":"Batting Average","stat_type":"player","timestamp":"'
       || strftime(timestamp '2024-01-01' + to_seconds(cast(page_id as integer)), '%Y-%m-%d %H:%M:%S')
       || '","player_stats":{"Name":' || cast(to_json("Name") as varchar) || ',"Team":'
       || cast(to_json("Team") as varchar) || ',"BA":"' || "BA" || '"}}' as value from html_rows""",
    "page_sequence_cut": r"""
with visits as (
  select page_id, regexp_extract(url, '^[a-z]+://([^/]+)/', 1) as site,
         cast(regexp_extract(url, '/([0-9]+)', 1) as integer) % 12 + 1 as page_no,
         len(regexp_extract_all(html, '<li>')) > 4 as usable from pages),
newest as (select * from visits qualify row_number() over (partition by site, page_no order by page_id desc) = 1),
first_gap as (
  select sites.site, min(n) as stop
  from (select distinct site from visits) sites cross join range(1, 12) r(n)
  left join newest on newest.site = sites.site and newest.page_no = n
  where not coalesce(usable, false) or n = 11 group by sites.site)
select '/stats/' || site as path, page_no, 'https://www.example.com/stats/' || site
       || case when page_no > 1 then '/p' || cast(page_no as varchar) else '' end as url, page_id
from newest join first_gap using (site) where page_no < stop""",
    "scrape_events": _with(_LINKS)
    + f""", listed as (select * from (values {_STAT_PAGES}) v(slot, entity, metric, path)),
visits as (
  select page_id, entity, metric, path, cast((page_id // {len(STAT_PAGES)}) % 12 + 1 as integer) as page_no,
         len(regexp_extract_all(html, '<li>')) > 4 as usable
  from pages join listed on slot = page_id % {len(STAT_PAGES)}),
newest as (select * from visits qualify row_number() over (partition by path, page_no order by page_id desc) = 1),
first_gap as (
  select paths.path, min(n) as stop
  from (select distinct path from visits) paths cross join range(1, 12) r(n)
  left join newest on newest.path = paths.path and newest.page_no = n
  where not coalesce(usable, false) or n = 11 group by paths.path)
select 'https://www.example.com' || path || case when page_no > 1 then '/p' || cast(page_no as varchar) else '' end as url,
       page_no, row_no, '{{"stat_category":"' || metric || '","stat_type":"' || kind || '","timestamp":"'
       || strftime(timestamp '2024-01-01' + to_seconds(cast(page_id as integer)), '%Y-%m-%d %H:%M:%S') || '","'
       || kind || '_stats":{{"Name":' || cast(to_json("Name") as varchar) || ',"Team":'
       || cast(to_json("Team") as varchar) || ',"BA":"' || "BA" || '"}}}}' as value
from (select *, case entity when 'team' then 'team' else 'player' end as kind
      from newest join first_gap using (path) join html_rows using (page_id) where page_no < stop)""",
    "stream_upsert": _UPSERT_WEEKLY,
    "stream_upsert_team": _UPSERT_TEAM,
    "stream_buckets": _UPSERT_WEEKLY,
    "stream_buckets_team": _UPSERT_TEAM,
    "stream_tables": f'''select {_PLAYER}, "offset" from ({_UPSERT_WEEKLY})
where table_name in ('individual_whip', 'individual_saves')''',
    "stream_latest": _LATEST_IND,
    "stream_rejects": _QUARANTINE,
    "stream_served": _with(
        _IND,
        _WEEKLY,
        """
state as (
  select * from weekly
  qualify rank() over (partition by table_name, "Name", "Team" order by batch_id desc) = 1
       or "Name" is null or "Team" is null)""",
        _ranked("state", "board", "number", _IND_TIES),
    )
    + f'select {_PLAYER}, "Rank", place, "offset" from board',
    "stream_snapshots": _with(
        _IND,
        _TEAM,
        _TEAM_STATE,
        _ranked("ind", "ind_number", "number", _IND_TIES),
        _ranked("team_state", "team_number", "number", _TEAM_TIES),
        _snapshot_cte("number", "snaps"),
    )
    + "select category, cast(1 as bigint) as version, snapshot from snaps where starts_with(table_name, 'team')",
}
