"""The registered queries once more, as plain SQL over the test tables (DuckDB dialect)."""

from tidemark.workload.views import HORIZONS, PRESENT, WIDE

_HORIZON = "case g.group_id " + " ".join(
    f"when '{g}' then {h}" for g, h in HORIZONS.items()
) + " end"
_NAMES = ",".join(f"('{g}')" for g in HORIZONS)

_BASE = f"""
ev as (
  select event_type as topic,
         cast(case when event_type='error'
                   then case when user_id % 10 < 7 then 0 else user_id % 4 end
                   else user_id end as int) as partition,
         (epoch_us(ts) - 1704067200000000 + 3599999999) // 3600000000 as hour_no
  from events),
hours as (select unnest(generate_series(0, (select max(hour_no) + 48 from ev))) as h),
days as (select (max(hour_no) + 23) // 24 as last_day from ev),
counts as (select topic, partition, hour_no, count(*) as n from ev group by all),
cum as materialized (
  select g.topic, g.partition, g.h,
         sum(coalesce(e.n,0)) over (partition by g.topic, g.partition order by g.h) as n
  from (select * from (select distinct topic, partition from ev) x cross join hours) g
  left join counts e on e.topic=g.topic and e.partition=g.partition and e.hour_no=g.h),
topic_offsets as materialized (
  select cast(h // 24 as bigint) as snapshot_id, topic, partition, cast(n as bigint) as end_offset
  from cum cross join days where h % 24 = 0 and h between 24 and 24 * last_day and n > 0),
snaps as (select distinct snapshot_id from topic_offsets),
horizon as (
  select group_id, snapshot_id, cast({_HORIZON} as bigint) as h
  from (select group_id, snapshot_id, snapshot_id as s
        from (values {_NAMES}) v(group_id) cross join snaps) g),
commits as (
  select z.snapshot_id, z.group_id, t.topic, t.partition, cast(c.n as bigint) as n, t.end_offset
  from horizon z join topic_offsets t on t.snapshot_id=z.snapshot_id
  join cum c on c.topic=t.topic and c.partition=t.partition and c.h=z.h),
group_offsets as materialized (
  select snapshot_id, group_id, topic, partition,
         case when group_id='g-silent' or (group_id='g-partial' and partition=5) then null
              when group_id='g-ahead' and partition=0 then end_offset+5
              else n end as committed
  from commits where {PRESENT}),
states as (
  select snapshot_id, group_id, state from snaps cross join (values
    ('g-realtime','STABLE'),('g-steady','STABLE'),('g-slow','STABLE'),('g-stalled','STABLE'),
    ('g-catchup','PREPARING_REBALANCE'),('g-partial','COMPLETING_REBALANCE'),
    ('g-ahead','STABLE'),('g-empty','EMPTY'),('g-silent','DEAD'),('g-ghost','EMPTY'))
    v(group_id, state)
  union all
  select snapshot_id, 'c-' || conv_id,
         case when conv_id % 17 = 0 then 'STABLE'
              else case conv_id % 6 when 0 then 'STABLE' when 1 then 'EMPTY'
                   when 2 then case when roles > 1 then 'STABLE' else 'EMPTY' end when 3 then 'DEAD'
                   when 4 then 'PREPARING_REBALANCE' else 'COMPLETING_REBALANCE' end end
  from (select conv_id, count(distinct role) as roles from conversations
        where conv_id is not null group by conv_id) join snaps on snapshot_id > conv_id % 5),
configs as (select * from (values
    ('click','flush.ms','60000'),('click','retention.ms','1209600000'),
    ('click','segment.bytes','1073741824'),('click','x.ms','5400000'),
    ('view','flush.ms','60000'),('view','retention.ms','1209600000')) v(topic, key, value)
  union all select event_type, 'measured.records', cast(count(*) as varchar) from events group by event_type
  union all select event_type, 'measured.span.ms',
                   cast((max(epoch_us(ts)) - min(epoch_us(ts))) // 1000 as varchar) from events group by event_type)
"""


def _analysis(groups: str = "group_id <> 'g-empty'", eta: str = "net-rate", pairs: str = "true"):
    """The analysis under a filter on groups: lags, statistics, rates, health."""
    speed = "cons - coalesce(arr, 0.0)" if eta == "net-rate" else "cons"
    return f"""
go as materialized (select * from group_offsets where {groups}),
asked as (select distinct snapshot_id, topic, partition from go where committed is not null),
plag as materialized (
  select g.*, t.end_offset, greatest(t.end_offset - g.committed, 0) as lag
  from go g join topic_offsets t using (snapshot_id, topic, partition)
  where g.committed is not null),
ls as materialized (
  select snapshot_id, group_id, topic, count(*) as n_parts, min(lag) as lag_min,
         max(lag) as lag_max, cast(sum(lag) as bigint) as lag_sum,
         cast(sum(lag) as double) / count(*) as lag_mean,
         list_sort(list(lag)) as v,
         case when sum(lag) > 0 then max(lag) / (cast(sum(lag) as double) / count(*))
              else 0.0 end as par,
         case when sum(lag) > 0
              then sqrt(cast(count(*) * sum(cast(lag as hugeint) * lag)
                             - cast(sum(lag) as hugeint) * cast(sum(lag) as hugeint) as double))
                   / cast(sum(lag) as double)
              else 0.0 end as cv
  from plag group by snapshot_id, group_id, topic),
lag_stats as (
  select * exclude (v),
         (v[(n_parts - 1) // 2 + 1] + v[n_parts // 2 + 1]) // 2 as lag_median from ls),
entries as (select distinct snapshot_id, group_id, topic from go),
pairs as (
  select a.snapshot_id + 1 as snapshot_id, a.snapshot_id as prev_snapshot_id,
         a.group_id, a.topic
  from entries a join entries b
    on b.snapshot_id = a.snapshot_id + 1 and b.group_id = a.group_id and b.topic = a.topic
  where {pairs}),
moved as materialized (
  select p.snapshot_id, p.prev_snapshot_id, p.group_id, p.topic,
         cast(coalesce(sum(b.committed), 0) - coalesce(sum(a.committed), 0) as bigint)
           as events_consumed
  from pairs p
  join go a on a.snapshot_id = p.prev_snapshot_id and a.group_id = p.group_id
           and a.topic = p.topic
  left join go b on b.snapshot_id = p.snapshot_id and b.group_id = p.group_id
           and b.topic = p.topic and b.partition = a.partition and a.committed is not null
  group by all),
ends as (
  select t.snapshot_id, t.topic,
         cast(sum(case when a.topic is null then 0 else end_offset end) as bigint) as end_sum
  from topic_offsets t left join asked a using (snapshot_id, topic, partition)
  group by all),
arrivals as (
  select b.snapshot_id, a.snapshot_id as prev_snapshot_id, b.topic,
         b.end_sum - a.end_sum as events_arrived, (b.end_sum - a.end_sum) / 86400.0 as arr
  from ends a join ends b on b.topic = a.topic and b.snapshot_id = a.snapshot_id + 1),
speeds as (
  select m.*, events_consumed / 86400.0 as cons, coalesce(r.arr, 0.0) as arr,
         l.n_parts, l.lag_min, l.lag_max, l.lag_sum, l.lag_mean, l.par, l.cv
  from moved m left join arrivals r using (snapshot_id, prev_snapshot_id, topic)
  left join lag_stats l using (snapshot_id, group_id, topic)),
etas as (
  select *, case when lag_sum is null then 0
                 when {speed} > 0
                 then cast(trunc(cast(lag_sum as double) / ({speed})) as bigint)
                 else -1 end as remaining_sec
  from speeds),
rates as materialized (
  select *, case when lag_sum is null or remaining_sec < 0 then '-'
                 else printf('%d:%02d:%02d', remaining_sec // 3600, remaining_sec % 3600 // 60,
                             remaining_sec % 60) end as remaining_hms
  from etas)
"""


_DAY = "cast(86400 as double)"
_ISSUE = """(remaining_sec >= 120 or
             (remaining_sec = -1 and (arr > 1.0 or coalesce(lag_sum, 0) > 1000)))"""
_ETA_LEVEL = """case when remaining_sec = -1 then 'red' when remaining_sec < 60 then 'green'
  when remaining_sec < 600 then 'yellow' when remaining_sec < 7200 then 'magenta'
  else 'red' end"""
_RATE_LEVEL = """case when lag_sum > 0 and cons = 0 then 'red' when arr > 5 * cons then 'red'
  when arr > 2 * cons then 'yellow' else 'green' end"""
_CV_LEVEL = """case when cv <= 0 then 'none' when cv < 0.5 then 'green'
  when cv <= 1.0 then 'yellow' else 'red' end"""
_REPORT = f"""
report as materialized (
  select snapshot_id, prev_snapshot_id, group_id, topic, n_parts as parts, {_DAY} as since,
         events_consumed as consumed, cast(trunc(arr) as bigint) as new_rate,
         cast(trunc(cons) as bigint) as cons_rate, cons as consumption_rate,
         arr as arrival_rate, remaining_hms as eta, remaining_sec, lag_sum as lag, par, cv,
         {_ISSUE} as has_issues, {_ETA_LEVEL} as eta_level, {_RATE_LEVEL} as rate_level,
         'white' as lag_level, {_CV_LEVEL} as cv_level
  from rates where n_parts is not null)
"""
_DETAIL = """
detail as materialized (
  select l.snapshot_id, l.group_id, l.topic, l.partition, l.committed as committed_offset,
         l.end_offset, l.lag, coalesce((l.committed - a.committed) / 86400.0, 0.0) as rate
  from plag l left join go a on a.snapshot_id = l.snapshot_id - 1 and a.group_id = l.group_id
       and a.topic = l.topic and a.partition = l.partition
  where l.snapshot_id > 1),
bands as (
  select snapshot_id, group_id, topic, min(lag) as l0, max(lag) as l1, min(rate) as r0,
         max(rate) as r1 from detail group by all),
ranked as materialized (
  select d.*,
    case when l0 = l1 then 'none' when (lag - l0) / (l1 - l0) < 0.33 then 'low'
         when (lag - l0) / (l1 - l0) < 0.67 then 'mid' else 'high' end as lag_rank,
    case when r0 = r1 then 'none' when (rate - r0) / (r1 - r0) < 0.33 then 'low'
         when (rate - r0) / (r1 - r0) < 0.67 then 'mid' else 'high' end as rate_rank
  from detail d join bands using (snapshot_id, group_id, topic))
"""
_METADATA = """
meta as (
  select snapshot_id, topic, 'id-' || topic as topic_id, partition, partition % 3 + 1 as leader,
         (partition + 1) % 3 + 1 as follower, partition = 7 as alone, partition % 50 = 49 as failed
  from topic_offsets
  union all
  select snapshot_id, 'lost', 'id-click', 0, 1, 2, false, true from topic_offsets
  where topic = 'click' and partition = 0)
"""
_FNV = """cast(list_reduce(list_prepend(cast(2166136261 as bigint),
    list_transform(generate_series(1, octet_length(encode({0}))),
      lambda i: cast(('0x' || substr(hex(encode({0})), 2 * i - 1, 2)) as bigint))),
    lambda h, b: (xor(h, b) * 16777619) & 4294967295) as bigint)"""


def _si_integer(x: str) -> str:
    size = f"abs({x})"
    return f"case when {x} < 0 then '-' else '' end || {_si(size, f'cast({size} as varchar)')}"


def _si(x: str, small: str) -> str:
    parts, value = [f"when {x} < 1000 then {small}"], f"cast({x} as double)"
    for unit in "KMGTP":
        value = f"{value} / 1000"
        shown = (
            f"case when {value} >= 100 then printf('%.0f', {value}) when {value} >= 10 "
            f"then printf('%.1f', {value}) else printf('%.2f', {value}) end || '{unit}'"
        )
        parts.append(f"when {value} < 1000 or '{unit}' = 'P' then {shown}")
    return "case " + " ".join(parts) + " end"


def _si_rate(x: str) -> str:
    whole = f"case when {x} = trunc({x}) then printf('%.0f', {x}) else printf('%.1f', {x}) end"
    return f"case when {x} < 0 then '-' when {x} = 0 then '0' else {_si(x, whole)} end"


def _query(select: str, *parts: str) -> str:
    return "with " + ",".join([_BASE, *parts]) + select


def _wide(sql: str) -> str:
    return sql.replace("else user_id end", f"else {WIDE} end")


def oracle_sql() -> dict[str, str]:
    full = _analysis()
    every = _analysis("true")
    key = "snapshot_id, group_id, topic"
    anon = "printf('{0} %06d', " + _FNV + " % 1000000)"
    group_name = anon.format("group_id").replace("'group_id ", "'group ")
    topic_name = anon.format("topic").replace("'topic ", "'topic ")
    eta_status = """case when remaining_sec < 60 then 'OK' when remaining_sec < 120 then 'OK'
      when remaining_sec < 600 then 'WARNING' when remaining_sec < 7200 then 'ERROR'
      else 'CRITICAL' end as eta_status,
      case when remaining_sec < 60 then 'ETA < 1m' when remaining_sec < 120 then 'ETA < 2m'
      when remaining_sec < 600 then 'ETA > 2m' when remaining_sec < 7200 then 'ETA > 10m'
      else 'ETA > 2h' end as eta_reason"""
    rate_status = """case when lag_sum > 0 and cons = 0 then 'ERROR'
      when arr > 5 * cons then 'ERROR' when arr > 2 * cons then 'WARNING'
      else 'OK' end as rate_status,
      case when lag_sum > 0 and cons = 0 then 'Lag detected but no event consumption'
      when arr > 5 * cons then 'Arrival rate > 5 * consumption rate'
      when arr > 2 * cons then 'Arrival rate > 2 * consumption rate' else '' end as rate_reason"""
    skew = """
    spd as (
      select b.snapshot_id, a.snapshot_id as prev_snapshot_id, a.group_id, a.topic,
             b.committed - a.committed as d
      from go a join go b on b.snapshot_id = a.snapshot_id + 1 and b.group_id = a.group_id
           and b.topic = a.topic and b.partition = a.partition
      where a.committed is not null and b.committed is not null)"""
    placed = """
      select d.*, m.topic is null or failed as gone, leader, follower, alone
      from ranked d left join meta m using (snapshot_id, topic, partition)"""
    meta_text = """
      case when gone then '-' else '(' || leader || ',' || follower || ')' end as replicas,
      case when gone then '-' when alone then '(' || leader || ')'
           else '(' || leader || ',' || follower || ')' end as isr,
      case when gone then '-' else cast(leader as varchar) end as leader"""
    report_columns = "*, group_id as shown_group, topic as shown_topic"
    by_lag = "lag desc, group_id desc, topic desc"
    flat = f"select {key}, "
    transactions = """
    tx as (
      select topic, partition, nullif(event_id % 4, 3) as producer_id, event_id // 4 % 5 = 0 as control,
             greatest((hour_no + 23) // 24, 1) as poll,
             row_number() over (partition by topic, partition order by ts, event_id) - 1 as off
      from (select event_id, ts, event_type as topic,
                   cast(case when event_type='error'
                             then case when user_id % 10 < 7 then 0 else user_id % 4 end
                             else user_id end as int) as partition,
                   (epoch_us(ts) - 1704067200000000 + 3599999999) // 3600000000 as hour_no from events)),
    done as (
      select snapshot_id, topic, partition, producer_id, max(off) filter (control) as ended
      from snaps join tx on poll <= snapshot_id where producer_id is not null group by all),
    open_ones as (
      select snapshot_id, topic, partition, min(off) as stable
      from done join tx using (topic, partition, producer_id)
      where poll <= snapshot_id and not control and off > coalesce(ended, -1) group by all)"""
    uneven = """
    uneven as (
      select cast(k as bigint) as k from (select unnest(generate_series(1, 10000)) as k)
      where k * k <= (select max(hour_no) from ev))"""

    sql = {
        # sources
        "s1_groups": _query("select snapshot_id, group_id from states"),
        "s2_group_state": _query("select * from states"),
        "s3_committed_scan": _query(
            "select snapshot_id, group_id, topic, partition, committed as committed_offset "
            "from group_offsets"
        ),
        "s4_end_offsets_requested": _query(
            "select t.* from topic_offsets t join asked using (snapshot_id, topic, partition)",
            full,
        ),
        "s5_topics": _query(
            "select snapshot_id, topic, count(*) filter (not failed) as partitions from meta "
            "group by all",
            _METADATA,
        ),
        "s6_topic_metadata": _query(
            "select snapshot_id, topic, topic_id, count(*) filter (not failed) as partitions, "
            "max(case when not failed then 2 end) as replication_factor from meta "
            "where topic = 'click' group by all",
            _METADATA,
        ),
        "s7_topic_configs": _query(
            "select t.topic, key, value from (select distinct topic from ev) t "
            "join configs using (topic)"
        ),
        "s8_brokers": _query(
            "select leader as broker_id, 'host-' || leader as host, 9092 as port, "
            "count(*) as led from meta where not failed group by all",
            _METADATA,
        ),
        "s9_topic_usage": _query(
            "select snapshot_id, topic, count(distinct group_id) as n_groups, "
            "count(distinct partition) filter (committed is not null) as n_partitions "
            "from go group by all",
            every,
        ),
        "s10_end_offsets": _query("select * from topic_offsets"),
        "s11_committed_offsets": _query(
            "select snapshot_id, group_id, topic, partition, n as committed_offset from commits"
        ),
        "s10_stable_offsets": _query(
            "select t.snapshot_id, t.topic, t.partition, least(end_offset, coalesce(stable, end_offset)) "
            "as stable_offset, end_offset as last_offset from topic_offsets t left join open_ones "
            "using (snapshot_id, topic, partition)",
            transactions,
        ),
        "s10_uneven_polls": _query(
            "select k as snapshot_id, topic, partition, cast(n as bigint) as end_offset "
            "from uneven join cum on h = k * k where n > 0",
            uneven,
        ),
        "s11_uneven_polls": _query(
            "select k as snapshot_id, group_id, topic, partition, n as committed_offset "
            "from uneven join commits on snapshot_id = k * k // 24",
            uneven,
        ),
        # filters and joins
        "f1_f2_group_filter": _query(
            "select distinct snapshot_id, group_id, topic from go",
            _analysis("group_id <> 'g-empty' and group_id like '%-s%' and group_id not like '%nt'"),
        ),
        "f5_live_groups": _query("select * from states where state <> 'EMPTY'"),
        "f7_f8_report_filter": _query(
            f"select {report_columns} from report where group_id like '%st%' "
            "and (topic like 'c%' or topic like '%w')",
            full,
            _REPORT,
        ),
        "f9_only_issues": _query(
            f"select {report_columns} from report where has_issues", full, _REPORT
        ),
        "f10_search": _query(
            f"select {key}, lag, match_index from (select *, row_number() over "
            f"(partition by snapshot_id order by {by_lag}) - 1 as match_index from report) "
            "where contains(lower(group_id || ' ' || topic), 'p c')",
            full,
            _REPORT,
        ),
        "f12_error_rows": _query(
            "select snapshot_id, 'topic' as kind, count(*) as n from topic_offsets "
            "where partition % 50 = 0 group by all union all "
            "select snapshot_id, 'group' as kind, count(*) as n from commits "
            "where group_id = 'g-realtime' and partition = 0 group by all"
        ),
        "j1_partition_lag": _query(
            f"select {key}, partition, committed as committed_offset, end_offset, lag from plag",
            full,
        ),
        # lag statistics
        "l1_lag_stats": _query(
            f"select {key}, n_parts, lag_min, lag_max, lag_sum, lag_mean, lag_median, par, cv "
            "from lag_stats",
            every,
        ),
        "a5_median": _query(flat + "lag_median from lag_stats", full),
        "a7_a8_skew": _query(flat + "par, cv from lag_stats", full),
        "a10_rate_skew": _query(
            f"""select snapshot_id, prev_snapshot_id, group_id, topic, count(*) as n_parts,
            case when sum(d) > 0 then max(d) / (cast(sum(d) as double) / count(*)) else 0.0 end
              as rate_par,
            case when sum(d) > 0 then sqrt(cast(count(*) * sum(cast(d as hugeint) * d)
                - cast(sum(d) as hugeint) * cast(sum(d) as hugeint) as double))
                / cast(sum(d) as double) else 0.0 end as rate_cv
            from spd group by all""",
            full,
            skew,
        ),
        "a11_totals": _query(
            "select snapshot_id, count(distinct group_id) as n_groups, "
            "cast(count(*) as bigint) as n_topics from report group by all",
            full,
            _REPORT,
        ),
        "a13_follow": _query(
            f"select {key}, lag from (select *, row_number() over (partition by snapshot_id "
            "order by lag desc, group_id, topic) as k from report) where k = 1",
            full,
            _REPORT,
        ),
        # rates
        "k0b_disjoint_pairs": _query(
            "select snapshot_id, prev_snapshot_id, group_id, topic, events_consumed, "
            "cons as consumption_rate, arr as arrival_rate, remaining_sec from rates",
            _analysis(pairs="a.snapshot_id % 2 = 1"),
        ),
        "k1_consumption": _query(
            f"select snapshot_id, prev_snapshot_id, group_id, topic, {_DAY} as time_delta, "
            "events_consumed, events_consumed / 86400.0 as consumption_rate from moved",
            every,
        ),
        "k3_partition_rates": _query(
            """select b.snapshot_id, a.snapshot_id as prev_snapshot_id, a.group_id, a.topic,
            a.partition, a.committed as prev_offset, b.committed as committed_offset,
            (b.committed - a.committed) / 86400.0 as rate
            from go a join go b on b.snapshot_id = a.snapshot_id + 1 and b.group_id = a.group_id
              and b.topic = a.topic and b.partition = a.partition
            where a.committed is not null and b.committed is not null""",
            full,
        ),
        "k4_arrival": _query(
            "select snapshot_id, prev_snapshot_id, topic, events_arrived, arr as arrival_rate "
            "from arrivals",
            full,
        ),
        "k4_arrival_filtered": _query(
            "select snapshot_id, prev_snapshot_id, topic, events_arrived, arr as arrival_rate "
            "from arrivals",
            _analysis("group_id like '%partial%'"),
        ),
        "k5_eta_net": _query(flat + "remaining_sec, remaining_hms from rates", full),
        "k6_eta_simple": _query(
            flat + "remaining_sec, remaining_hms from rates", _analysis(eta="simple")
        ),
        "k9_rates": _query(
            f"""select snapshot_id, prev_snapshot_id, group_id, topic, {_DAY} as time_delta,
            events_consumed, cons as consumption_rate, arr as arrival_rate, remaining_sec,
            remaining_hms, n_parts, lag_min, lag_max, lag_sum, lag_mean, par, cv from rates""",
            every,
        ),
        # text
        "c1_hms": _query(
            flat + """partition, printf('%d:%02d:%02d', lag * 100 // 3600,
            lag * 100 % 3600 // 60, lag * 100 % 60) as hms from plag""",
            full,
        ),
        "c2_si_numbers": _query(
            flat
            + "partition, "
            + _si_integer("(lag * lag * 37 - 500)")
            + " as shown_lag, "
            + _si_rate("((end_offset * end_offset) / 8.0)")
            + " as shown_rate from plag",
            full,
        ),
        "c5_ratio_text": _query(
            flat
            + "case when par > 0 then printf('%.2f', par) else '-' end as par, "
            + "case when cv > 0 then printf('%.2f', cv) else '-' end as cv from lag_stats",
            full,
        ),
        "c6_config_text": _query(
            """select snapshot_id, topic, key, case when not ends_with(key, '.ms') then value
            when v >= 86400000 then value || ' (' || v // 86400000 || ' days)'
            when v >= 3600000 then value || ' (' || printf('%.1f', v / 3600000) || ' hours)'
            else value || ' (' || printf('%.1f', v / 60000) || ' min)' end as shown
            from (select distinct snapshot_id, topic from topic_offsets)
            join (select *, cast(value as bigint) as v from configs) using (topic)"""
        ),
        "c8_anonymise": _query(
            f"select distinct snapshot_id, group_id, topic, {group_name} as shown_group, "
            f"{topic_name} as shown_topic from group_offsets"
        ),
        "c9_c11_viewport": _query(
            """select snapshot_id, topic, n_parts || '/' || total as covered,
            least(cast(trunc(n_parts / total * 100) as int), 100) as percent, group_id
            from lag_stats join (select snapshot_id, topic, count(*) as total
              from asked group by all) using (snapshot_id, topic)""",
            full,
        ),
        # health
        "h1_eta_status": _query(f"select {key}, {eta_status} from rates", full),
        "h2_rate_status": _query(f"select {key}, {rate_status} from rates", full),
        "h3_issue_flag": _query(
            f"select {key}, {_ISSUE} as has_issues, {_ETA_LEVEL} as eta_level from rates", full
        ),
        "h4_rate_level": _query(f"select {key}, {_RATE_LEVEL} as rate_level from rates", full),
        "h6_cv_level": _query(f"select {key}, {_CV_LEVEL} as cv_level from lag_stats", full),
        "h7_h8_bands": _query(
            f"""select {key}, case when cv <= 0.2 then 'Excellent' when cv <= 0.5
            then 'Acceptable' when cv <= 1.0 then 'High skew' else 'Critical skew' end as cv_band,
            case when par <= 1.0 then 'Balanced' when par <= 1.1 then 'Safe margin'
            when par <= 1.5 then 'Bottleneck' else 'Severe hotspot' end as par_band,
            case when cv > 0.5 then 'Widespread skew' when par > 2.0 then 'Localized hotspot'
            else 'Ideal' end as diagnosis from lag_stats""",
            full,
        ),
        "h10_rank_bucket": _query(
            flat + "partition, lag_rank, rate_rank from ranked", full, _DETAIL
        ),
        "h11_state_level": _query(
            "select snapshot_id, group_id, case when state = 'EMPTY' then 'red' else 'green' end "
            "as state_level from states"
        ),
        # reports
        "p1_report_sorted": _query(
            f"select {key}, lag, row_number() over (partition by snapshot_id order by {by_lag}) "
            "as position from report",
            full,
            _REPORT,
        ),
        "p1_sort_keys": _query(
            f"""select {key},
            row_number() over (partition by snapshot_id order by remaining_sec desc,
              group_id desc, topic desc) as by_eta,
            row_number() over (partition by snapshot_id order by topic, group_id) as by_topic,
            row_number() over (partition by snapshot_id order by new_rate, group_id, topic)
              as by_newrate from report""",
            full,
            _REPORT,
        ),
        "p3_page": _query(
            f"""select {key}, lag, first_row, first_row + 9 as last_row, n_rows,
            least(cast(trunc((first_row + 9) / n_rows * 100) as int), 100) as percent
            from (select *, row_number() over (order by lag desc, group_id desc, topic desc) as k,
                  count(*) over () as n_rows, cast(21 as bigint) as first_row from report)
            where k between 21 and 30""",
            full,
            _REPORT,
        ),
        "p3_deep_page": _query(
            f"""select {key}, lag, first_row, first_row + 39 as last_row, n_rows,
            least(cast(trunc((first_row + 39) / n_rows * 100) as int), 100) as percent
            from (select *, row_number() over (order by lag desc, group_id desc, topic desc, snapshot_id) as k,
                  count(*) over () as n_rows, cast(601 as bigint) as first_row from report)
            where k between 601 and 640""",
            full,
            _REPORT,
        ),
        "p4_detail_sorted": _query(
            flat + f"partition, lag, row_number() over (partition by {key} "
            "order by lag desc, partition) as position from detail",
            full,
            _DETAIL,
        ),
        "r1_report": _query(f"select {report_columns} from report", full, _REPORT),
        "r1_report_anonymous": _query(
            f"select *, {group_name} as shown_group, {topic_name} as shown_topic from report",
            full,
            _REPORT,
        ),
        "r1_report_last_pair": _query(
            f"select {report_columns} from report where snapshot_id = "
            "(select max(snapshot_id) from snaps)",
            full,
            _REPORT,
        ),
        "r2_status": _query(
            f"select {key}, group_id || '-' || topic as status_key, {eta_status}, {rate_status}, "
            "'OK' as lag_status, '' as lag_reason from rates",
            full,
        ),
        "r3_summary": _query(
            """select g.snapshot_id, g.group_id, state, l.topic, l.n_parts as partitions,
            lag_max, lag_min, par, cv,
            coalesce((select string_agg(key || '=' || value, ';' order by key) from configs c
                      where c.topic = l.topic), '') as configs
            from (select distinct snapshot_id, group_id from go) g
            join states using (snapshot_id, group_id)
            left join lag_stats l using (snapshot_id, group_id)""",
            full,
        ),
        "o4_lag_table": _query(
            flat + "n_parts as partitions, state, lag_min, lag_max, lag_median from lag_stats "
            "join states using (snapshot_id, group_id)",
            full,
        ),
        "o5_rate_table": _query(
            flat + f"events_consumed, {_DAY} as time_delta, cons as consumption_rate, "
            "arr as arrival_rate, remaining_hms from rates",
            full,
        ),
        "o6_summary_table": _query(
            flat + """group_id as shown_group, topic as shown_topic,
            n_parts || '/' || total as partitions, lag_median,
            'ConsumerGroupState.' || state as state,
            case when state = 'EMPTY' then 'red' else 'green' end as state_level
            from lag_stats join states using (snapshot_id, group_id)
            join (select snapshot_id, topic, count(*) as total from asked group by all)
              using (snapshot_id, topic)""",
            every,
        ),
        "o7_shown_report": _query(
            f"""select snapshot_id, group_id as shown_group, topic as shown_topic,
            cast(parts as varchar) as parts, '86400.0' as since,
            {_si_integer('consumed')} as consumed, {_si_integer('new_rate')} as new_rate,
            {_si_integer('cons_rate')} as cons_rate, eta, {_si_integer('lag')} as lag,
            case when par > 0 then printf('%.2f', par) else '-' end as par,
            case when cv > 0 then printf('%.2f', cv) else '-' end as cv from report""",
            full,
            _REPORT,
        ),
        "d1_partition_detail": _query(
            flat + "partition, committed_offset, end_offset, lag, rate, lag_rank, rate_rank, "
            f"{meta_text} from ({placed})",
            full,
            _DETAIL,
            _METADATA,
        ),
        "t1_topic_info": _query(
            "select snapshot_id, topic, count(*) filter (not failed) as partitions, "
            "any_value(topic_id) as topic_id, "
            "max(case when not failed then 2 end) as replication_factor from meta group by all",
            _METADATA,
        ),
        "t2_topic_info_parts": _query(
            """select snapshot_id, topic, partition, leader,
            leader || ',' || follower as replicas,
            case when alone then cast(leader as varchar) else leader || ',' || follower end as isr,
            case when alone then 1 else 2 end as nisrs from meta where not failed""",
            _METADATA,
        ),
    }
    sql["p5_sorted_ids"] = _query(
        "select *, row_number() over (partition by snapshot_id order by group_id) as position "
        "from (select distinct snapshot_id, group_id from states)"
    )
    sql["p6_poll_budget"] = _query(
        f"select {key}, events_consumed, remaining_sec from rates",
        _analysis(pairs="a.snapshot_id <= (select min(snapshot_id) + 4 from snaps)"),
    )
    sliced = "select snapshot_id, prev_snapshot_id, group_id, topic, events_consumed, remaining_sec from rates"
    sql["k0b_slice"] = _query(
        sliced, _analysis(pairs="a.snapshot_id between 5 and 10 and a.snapshot_id % 2 = 1")
    )
    sql["p6_slice"] = _query(sliced, _analysis(pairs="a.snapshot_id between 5 and 6"))
    sql["p6_slice_detail"] = _query(
        flat + "partition, lag, rate from detail where snapshot_id in (6, 8)", full, _DETAIL
    )
    sql["d1_last_pair"] = sql["d1_partition_detail"] + (
        " where snapshot_id = (select max(snapshot_id) from snaps)"
    )
    sql["d1_header"] = _query(
        f"""select {key}, n_parts as partitions, lag_sum, lag_min, lag_max, par, cv,
        cons as consumption_rate, arr as arrival_rate, remaining_sec, remaining_hms,
        max(case when m.topic is not null and not failed then 2 end) as replication_factor,
        cast((select count(*) from configs c where c.topic = rates.topic) as int) as n_configs
        from rates left join meta m using (snapshot_id, topic) group by all""",
        full,
        _METADATA,
    )
    sql["o8_shown_detail"] = _query(
        f"""select snapshot_id, {group_name} as shown_group, {topic_name} as shown_topic,
        cast(partition as varchar) as partition, {_si_integer('committed_offset')} as committed_offset,
        {_si_integer('end_offset')} as end_offset, {_si_integer('lag')} as lag,
        {_si_rate('rate')} as rate, lag_rank, rate_rank, {meta_text} from ({placed})""",
        full,
        _DETAIL,
        _METADATA,
    )
    sql["o3_brokers"] = _query(
        "select cast(leader as varchar) as key, leader as id, 'host-' || leader as host, "
        "9092 as port, 'host-1' as broker_name, 'demo' as cluster_id, count(*) as led "
        "from meta where not failed group by all",
        _METADATA,
    )
    by = "row_number() over (partition by snapshot_id order by"
    sql["p1_more_sort_keys"] = _query(
        f"""select {key}, {by} group_id, topic) as by_group,
        {by} parts, group_id, topic) as by_partitions,
        {by} consumption_rate, group_id, topic) as by_rate,
        {by} par desc, group_id desc, topic desc) as by_par,
        {by} cv desc, group_id desc, topic desc) as by_cv
        from report""",
        full,
        _REPORT,
    )
    sql["p1_reversed"] = _query(
        f"""select {key}, {by} lag, group_id, topic) as by_lag,
        {by} topic desc, group_id desc) as by_topic from report""",
        full,
        _REPORT,
    )
    within = f"row_number() over (partition by {key} order by"
    sql["p4_detail_sort_keys"] = _query(
        f"""select {key}, partition, {within} partition) as by_partition,
        {within} committed_offset desc, partition) as by_groupoffset,
        {within} end_offset desc, partition) as by_topicoffset,
        {within} rate desc, partition) as by_rate from detail""",
        full,
        _DETAIL,
    )
    sql["f12_error_rows_listed"] = _query(
        """select snapshot_id, 'topic' as kind, cast(null as varchar) as group_id, topic,
        partition + 1000000 as partition, 'LEADER_NOT_AVAILABLE' as error from topic_offsets where partition % 50 = 0 union all
        select snapshot_id, 'group', 'g-broken', topic, partition, 'COORDINATOR_NOT_AVAILABLE'
        from commits where group_id = 'g-realtime' and partition = 0"""
    )
    # The first-generation tool: negative offsets and lags count as they are, the end
    # offsets asked for are those of the first group of a topic, and sums are independent.
    legacy = """
    lo as (select * exclude (committed), coalesce(committed, -1) as committed from group_offsets
           where group_id <> 'g-empty'),
    first_group as (select snapshot_id, topic, min(group_id) as group_id from lo group by all),
    lasked as (select lo.snapshot_id, lo.topic, lo.partition from lo
               join first_group using (snapshot_id, topic, group_id)),
    llag as (select l.*, t.end_offset - l.committed as lag from lo l
             join topic_offsets t using (snapshot_id, topic, partition)
             join lasked using (snapshot_id, topic, partition)),
    lsum as (
      select e.snapshot_id, e.group_id, e.topic, count(lag) as n_parts,
             coalesce(min(lag), 0) as lag_min, coalesce(max(lag), 0) as lag_max,
             cast(coalesce(sum(lag), 0) as bigint) as lag_sum,
             cast(coalesce(median(lag), 0) as double) as lag_median
      from (select distinct snapshot_id, group_id, topic from lo) e
      left join llag using (snapshot_id, group_id, topic) group by all),
    lmoved as (select snapshot_id, group_id, topic, cast(sum(committed) as bigint) as total
               from lo group by all)"""
    sql["l1_lag_stats_legacy"] = _query("select * from lsum", legacy)
    sql["k1_consumption_legacy"] = _query(
        f"""select b.snapshot_id, b.group_id, b.topic, b.total - a.total as events_consumed,
        s.lag_sum from lmoved a join lmoved b on b.snapshot_id = a.snapshot_id + 1
          and b.group_id = a.group_id and b.topic = a.topic
        join lsum s on s.snapshot_id = b.snapshot_id and s.group_id = b.group_id
          and s.topic = b.topic""",
        legacy,
    )
    sql["x1_streaming_lag"] = _query(
        f"select {key}, n_parts, lag_min, lag_max, lag_sum, lag_median, par, cv from lag_stats", full
    )
    paired = f"""snapshot_id, prev_snapshot_id, group_id, topic, {_DAY} as time_delta, events_consumed,
        cons as consumption_rate, arr as arrival_rate, lag_sum, remaining_sec"""
    sql["x2_streaming_rates"] = _query(f"select {paired}, remaining_hms from rates", full)
    sql["x4_end_offsets_from_stream"] = sql["s10_end_offsets"]
    sql["x5_committed_from_stream"] = sql["s11_committed_offsets"]
    usual = _query(
        f"select {paired} from rates where snapshot_id <= 25 and snapshot_id not between 10 and 19", full
    )
    changed = _query(
        f"select {paired} from rates where snapshot_id between 10 and 19",
        _analysis("group_id <> 'g-empty' and group_id not like 'g-s%'", "simple"),
    )
    sql["x6_changed_filter"] = f"select * from ({usual}) union all select * from ({changed})"
    sql["x3_poll_loop"] = sql["r1_report"]
    sql["l1_lag_stats_wide"] = _wide(
        _query(
            f"select {key}, n_parts, lag_min, lag_max, lag_sum, lag_mean, lag_median, par, cv "
            "from lag_stats",
            full,
        )
    )
    sql["d1_detail_wide"] = _wide(_query("select * from ranked", full, _DETAIL))
    # The JSON forms hold the same values.
    sql["j1_bucketed_lag"] = sql["j1_partition_lag"]
    sql["o1_summary_json"] = sql["r3_summary"]
    by = "partition by snapshot_id order by group_id, topic"
    sql["o1_document_places"] = f"""select snapshot_id, group_id, topic,
        case when row_number() over ({by}) = 1 then '{{' else ',' end as opening,
        case when row_number() over (partition by snapshot_id, group_id order by topic) = 1
             then '"' || group_id || '":{{"state":"' || state || '","topics":{{' else '' end as head,
        case when lead(topic) over ({by}) is null or lead(group_id) over ({by}) <> group_id then '}}}}'
             else '' end || case when lead(group_id) over ({by}) is null then '}}' else '' end as closing
        from ({sql["r3_summary"]})"""
    sql["o2_status_json"] = sql["r2_status"]
    sql["o3_topic_json"] = sql["t2_topic_info_parts"]
    return sql
