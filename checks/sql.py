"""ANSI SQL (DuckDB) equivalents of the registered queries, written independently of the Spark plans."""

from checks.content import content_sql

LOG = """log as (
 select seq, time, host, sourcetype, source, app, error_code, duration_ms, active_threads, status, uri, _raw from (
  select event_id as seq, ts as time,
   concat('web-', lpad(cast(user_id % 12 as varchar), 2, '0')) as host,
   concat('app:', event_type) as sourcetype, concat('/var/log/', event_type, '.log') as source,
   case when user_id % 2 = 0 then 'shop' else 'api' end as app,
   concat('E', cast(k % 20 as varchar)) as error_code, value as duration_ms, k as active_threads,
   case when event_type <> 'error' then case when k % 10 = 0 then 302 else 200 end
        when k % 3 = 0 then 503 when k % 3 = 1 then 404 else 500 end as status,
   concat('/', event_type, '/', cast(k % 7 as varchar)) as uri,
   case when event_type <> 'error' then concat('INFO ', event_type, ' served k=', cast(k as varchar))
        when k % 5 = 0 then concat('ERROR OCSP validation failed for cert ', cast(k as varchar))
        when k % 5 = 1 then 'CRITICAL TLS handshake failed'
        when k % 5 = 2 then 'ERROR connection pool exhausted, queue full'
        when k % 5 = 3 then 'WARN Full GC pause observed'
        else 'WARNING socket in CLOSE_WAIT state' end as _raw
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events)))"""


def _log(body: str) -> str:
    return f"with recursive {LOG} {body}"


def _keywords(words: list[str], text: str = "lower(_raw)") -> str:
    """Matched keywords in list order, comma-joined."""
    parts = ", ".join(f"case when contains({text}, '{w}') then '{w}' end" for w in words)
    return f"concat_ws(',', {parts})"


CERT = ["ocsp", "crl", "chain validation", "handshake failed", "revocation", "certificate expired", "cert expired"]
EXHAUSTION = [
    "threadpoolexecutor", "rejectedexecutionexception", "pool exhausted", "pool is exhausted", "queue full",
    "queue capacity", "max threads", "maxthreads", "thread starvation", "no available threads",
    "connection pool exhausted", "timeout waiting for connection", "timeout waiting for idle object",
    "too many open files", "socket accept queue", "backlog exceeded", "cannot accept connection",
]
GC = ["full gc", "stop-the-world", "gc pause", "allocation stall"]


def _spikes(w: int, threshold: int) -> str:
    return _log(f""", counted as (
      select time, count(*) over (order by time range between current row and interval {w} seconds following) as n
      from log),
    anchors as (
      select min(time) as window_start, arg_min(n, time) as event_count from counted where n >= {threshold}
      group by date_trunc('minute', time))
    select a.window_start, {w} as window_seconds, a.event_count, {threshold} as threshold,
      string_agg(distinct l.host, ',' order by l.host) as hosts
    from anchors a join log l on l.time between a.window_start and a.window_start + interval {w} seconds
    group by a.window_start, a.event_count""")


SESSIONS = """, steps as (
   select *, case when time - lag(time) over (order by time, seq) <= interval 60 seconds then 0 else 1 end as opens
   from log),
  numbered as (select *, sum(opens) over (order by time, seq) as sid from steps)
  select min(time) as group_start, max(time) as group_end,
    round((epoch_us(max(time)) - epoch_us(min(time))) / 1e6, 6) as span_seconds, count(*) as event_count,
    string_agg(distinct host, ',' order by host) as hosts,
    string_agg(distinct sourcetype, ',' order by sourcetype) as sourcetypes
  from numbered group by sid having count(*) > 1"""


def _pairs(rules: list[tuple[str, str, str, int]]) -> str:
    one = """select '{f}' as entity_field, a.entity, '{p}' as first_pattern, '{q}' as second_pattern,
      a.time as first_time, b.time as second_time,
      round((epoch_us(b.time) - epoch_us(a.time)) / 1e6, 6) as span_seconds,
      substr(a._raw, 1, 120) as first_raw_excerpt, substr(b._raw, 1, 120) as second_raw_excerpt
    from (select {f} as entity, time, seq, _raw from log where contains(lower(_raw), '{p}')
          qualify row_number() over (partition by {f} order by time, seq) = 1) a
    join log b on b.{f} is not distinct from a.entity and contains(lower(b._raw), '{q}')
      and (b.time > a.time or (b.time = a.time and b.seq > a.seq)) and b.time <= a.time + interval {s} seconds
    qualify row_number() over (partition by a.entity order by b.time, b.seq) = 1"""
    parts = [f"select * from ({one.format(f=f, p=p, q=q, s=s)})" for f, p, q, s in rules]
    return _log(" union all ".join(parts))


def _scan(kind: str, words: list[str], excerpt: int, sourcetype: bool = True) -> str:
    return _log(f"""select '{kind}' as type, host, time, {_keywords(words)} as matched_keywords,
      {'sourcetype,' if sourcetype else ''} substr(_raw, 1, {excerpt}) as raw_excerpt
    from log where {_keywords(words)} <> ''""")


SEVERITY = """, c as (
   select count(*) as total, count(*) filter (contains(upper(_raw), 'CRITICAL')) as c1,
    count(*) filter (contains(upper(_raw), 'ERROR')) as c2, count(*) filter (contains(upper(_raw), 'WARN')) as c3,
    count(*) filter (contains(upper(_raw), 'WARNING')) as c4, count(*) filter (contains(upper(_raw), 'INFO')) as c5,
    count(*) filter (contains(upper(_raw), 'DEBUG')) as c6 from log)
  select * from (
   select 'CRITICAL' as level, c1 as "count" from c union all select 'ERROR', c2 from c
   union all select 'WARN', c3 from c union all select 'WARNING', c4 from c union all select 'INFO', c5 from c
   union all select 'DEBUG', c6 from c union all select 'UNKNOWN', total - (c1 + c2 + c3 + c4 + c5 + c6) from c)
  where "count" <> 0"""

REPEATED = """select sourcetype, error_code, count(*) as "count" from log group by 1, 2 having count(*) > 1"""

Z = """, framed as (
   select *, row_number() over (order by time, seq) - 1 as idx,
     avg(duration_ms) over w as rolling_mean, stddev_samp(duration_ms) over w as rolling_std, count(*) over w as filled
   from log window w as (order by time, seq rows between 19 preceding and current row)),
  flagged as (
   select *, (duration_ms - rolling_mean) / rolling_std as z from framed
   where filled = 20 and rolling_std > 0 and abs((duration_ms - rolling_mean) / rolling_std) > 3.0),
  marked as (
   select *, case when idx - lag(idx) over (order by idx) <= 20 then 0 else 1 end as opens from flagged),
  clustered as (select *, cast(sum(opens) over (order by idx) as bigint) as cluster from marked),
  led as (select *, row_number() over (partition by cluster order by abs(z) desc, idx) as place from clustered)"""

SATURATION_GROWTH = """, buckets as (
   select epoch_us(time) // 3600000000 as bucket, avg(cast(active_threads as double)) as current_avg from log group by 1),
  pairs as (select *, lag(current_avg) over (order by bucket) as prev_avg from buckets)
  select 'thread_count_growth' as type, make_timestamp(bucket * 3600000000) as window_start, 3600 as window_seconds,
    round(prev_avg, 6) as prev_avg, round(current_avg, 6) as current_avg,
    round(current_avg / prev_avg, 6) as growth_ratio
  from pairs where prev_avg <> 0 and current_avg / prev_avg >= 1.5"""

TEXT_TIMES = """, texts as (
   select *, case seq % 3 when 0 then 'Z' when 1 then '+00:00' else '+0000' end as zone,
     epoch_us(time) // 1000000 as s from log),
  times as (
   select seq, case seq % 7
     when 0 then concat(cast(s as varchar), '.5')
     when 1 then concat(strftime(time, '%Y-%m-%dT%H:%M:%S'), zone)
     when 2 then concat(strftime(time, '%Y-%m-%dT%H:%M:%S.%f'), zone)
     when 3 then strftime(time, '%m/%d/%Y %H:%M:%S')
     when 4 then strftime(time, '%Y-%m-%dT%H:%M:%S')
     when 5 then 'None'
     else concat(cast(s as varchar), 'd') end as _time,
    case seq % 7
     when 0 then make_timestamp(s * 1000000 + 500000)
     when 1 then make_timestamp(s * 1000000)
     when 2 then time
     when 3 then make_timestamp(s * 1000000) end as time
   from texts)"""

MIXED_HOSTS = """, mixed as (
   select seq, time, case when seq % 5 < 2 then host when seq % 5 = 2 then '' end as host,
     case when seq % 5 = 3 then app end as src, case when seq % 10 = 4 then source end as hostname from log),
  eff as (
   select seq, time, coalesce(nullif(host, ''), nullif(src, ''), nullif(hostname, ''), 'unknown') as effective_host
   from mixed)"""

ORACLE: dict[str, str] = {
    "detect_spikes": _spikes(3600, 25),
    "detect_spikes_short": _spikes(600, 7),
    "detect_repeated_errors": _log(REPEATED),
    "detect_raw_prefixes": """select substr(text, 1, 60) as prefix, count(*) as "count" from documents
      group by 1 having count(*) > 1 order by 2 desc, 1 limit 10""",
    "detect_patterns": _log(f"""select 'repeated_error' as type, sourcetype, error_code, null as prefix, "count"
      from ({REPEATED})
      union all select * from (select 'repeated_raw_prefix', null, null, substr(_raw, 1, 60) as p, count(*) as n
        from log group by p having count(*) > 1 order by n desc, p limit 10)"""),
    "correlate_events": _log(SESSIONS),
    "detect_event_pairs": _pairs([("host", "ocsp", "handshake failed", 86400)]),
    "detect_event_pair_patterns": _pairs([
        ("host", "ocsp", "handshake failed", 86400), ("sourcetype", "pool exhausted", "close_wait", 7200)]),
    "detect_cert_anomalies": _scan("cert_anomaly", CERT, 120),
    "severity_summary": _log(SEVERITY),
    "severity_summary_levels": _log("""select upper(app) as level, count(*) as "count" from log group by 1"""),
    "host_error_ranking": _log("""select host, count(*) as error_count from log
      where contains(upper(_raw), 'ERROR') or contains(upper(_raw), 'CRITICAL') group by 1"""),
    "detect_slow_queries": _log("""select duration_ms, 'duration_ms' as field, host, substr(_raw, 1, 200) as query, time
      from log where duration_ms > 100"""),
    "detect_http_errors": _log("""select cast(status as bigint) as status_code,
      case when status >= 500 then '5xx' else '4xx' end as class, 'status' as field, host, substr(uri, 1, 200) as path, time
      from log where status >= 400"""),
    "detect_numeric_anomalies": _log(Z + """ select 'duration_ms' as field, duration_ms as value,
      round(z, 6) as z_score, round(rolling_mean, 6) as rolling_mean, round(rolling_std, 6) as rolling_std, time,
      place > 1 as window_contaminated, host from led"""),
    "anomaly_clusters": _log(Z + """ select cluster, arg_min(idx, place) as leader_idx, arg_min(time, place) as leader_time,
      round(arg_min(z, place), 6) as leader_z, count(*) as members, min(time) as first_time, max(time) as last_time
      from led group by cluster"""),
    "detect_thread_exhaustion": _scan("thread_exhaustion", EXHAUSTION, 160),
    "detect_socket_backlog": _log("""select 'socket_backlog' as type, host, state, count(*) as "count"
      from log join (values ('close_wait'), ('syn_recv'), ('time_wait')) s(state) on contains(lower(_raw), state)
      group by host, state having count(*) >= 5"""),
    "detect_gc_pressure": _scan("gc_pressure", GC, 160, sourcetype=False),
    "detect_thread_count_growth": _log(SATURATION_GROWTH),
    "correlate_latency_load": _log("""select make_timestamp(epoch_us(time) // 3600000000 * 3600000000) as window_start,
      round(avg(cast(active_threads as double)), 6) as avg_threads, round(avg(duration_ms), 6) as avg_latency_ms,
      count(*) as event_count from log group by 1"""),
    "saturation_host_ranking": _log(f"""select host, count(*) as exhaustion_events from log
      where {_keywords(EXHAUSTION)} <> '' group by 1"""),
    "saturation_verdict": _log(f""", buckets as (
       select epoch_us(time) // 300000000 as bucket, avg(active_threads) as a, avg(duration_ms) as l from log group by 1),
      steps as (select a / nullif(lag(a) over (order by bucket), 0) as ratio from buckets),
      flags as (select (select count(*) from log) as event_count,
        exists (select 1 from log where {_keywords(EXHAUSTION)} <> '') as thread_exhaustion,
        exists (select 1 from steps where ratio >= 1.5) as thread_count_growth,
        exists (select 1 from buckets where a > 0) as latency_vs_thread_load,
        exists (select host from log where contains(lower(_raw), 'close_wait') group by host having count(*) >= 5)
          as socket_backlog,
        exists (select 1 from log where {_keywords(GC)} <> '') as gc_pressure),
      summed as (select *, thread_exhaustion::int + thread_count_growth::int + latency_vs_thread_load::int
        + socket_backlog::int + gc_pressure::int as signals from flags)
      select *, case when signals >= 2 then 'High' when signals = 1 then 'Medium' else 'Low' end as confidence
      from summed"""),
    "extract_timestamps": _log(TEXT_TIMES + " select seq, _time, time from times"),
    "extract_cert_fields": _log("""select seq, null::varchar as cert_expiry, null::varchar as cert_issuer,
      null::varchar as cert_serial, null::varchar as cert_subject, null::varchar as chain_depth,
      case when contains(_raw, 'OCSP') then 'timeout' end as ocsp_status, null::varchar as revocation_reason,
      case when contains(_raw, 'handshake') then _raw end as tls_error, null::varchar as tls_version from log"""),
    "build_timeline": _log("""select seq, time,
      round((epoch_us(time) - (select min(epoch_us(time)) from log)) / 1e6, 6) as relative_offset_s from log"""),
    "prepare_events": _log(TEXT_TIMES + """ select seq, time,
      round(coalesce((epoch_us(time) - (select min(epoch_us(time)) from times)) / 1e6, 0.0), 6) as relative_offset_s
      from times"""),
    "effective_host": _log(MIXED_HOSTS + " select seq, effective_host from eff"),
    "group_by_host": _log(MIXED_HOSTS + """ select effective_host, count(*) as event_count,
      min(time) as first_time, max(time) as last_time from eff group by 1"""),
    "append_events": _log("""select seq, time, host, duration_ms, null as status, null as uri from log where duration_ms > 100
      union all select seq, time, host, null, status, uri from log where status >= 400"""),
}

# --- follow-up areas: nine hosts, three codes, one sourcetype, a spike start ---

HOSTS = ", ".join(f"'web-{i:02d}'" for i in range(9))
SPIKE = "timestamp '2024-01-10 06:30:00'"
CODES = "error_code in ('E1', 'E2', 'E3')"


def _between(before: str, after: str) -> str:
    return f"time >= {SPIKE} - interval {before} and time < {SPIKE} + interval {after}"


def _transaction(source: str) -> str:
    """Anchored groups of at most an hour per host, one start after the other."""
    return f"""src as ({source}),
      starts as (
       select host, min(time) as s from src group by host
       union all
       select t.host, min(l.time) from starts t join src l on l.host = t.host and l.time > t.s + interval 1 hour
       group by t.host, t.s),
      spans as (select host, s, lead(s) over (partition by host order by s) as next_s from starts),
      groups as (
       select host, s as start_time, max(l.time) as end_time, count(*) as event_count
       from spans join src l using (host) where l.time >= s and (next_s is null or l.time < next_s)
       group by host, s)"""


ORACLE |= {
    "area_api_errors": _log(f"""select host, cast(status as bigint) as status, uri, count(*) as "count" from log
      where host in ({HOSTS}) and sourcetype = 'app:error' and status >= 400 and {_between('0 hour', '1 hour')}
      group by all"""),
    "area_database_slowdown": _log(f"""select host, round(avg(duration_ms), 6) as avg_ms, max(duration_ms) as max_ms,
      count(*) as "count" from log where host in ({HOSTS}) and duration_ms > 50 and {_between('0 hour', '1 hour')}
      group by host"""),
    "area_cascading_failure": _log(f""", {_transaction(
        f"select host, time from log where host in ({HOSTS}) and {_between('5 minute', '30 minute')}")}
      select start_time as time, host, round((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 6) as duration,
        event_count as eventcount from groups"""),
    "transaction": _log(f""", {_transaction('select host, time from log')}
      select host, start_time, end_time, round((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 6) as duration,
        event_count from groups"""),
    "area_host_isolation": _log(f"""select host, sourcetype, error_code, count(*) as "count" from log
      where host in ({HOSTS}) and {_between('0 hour', '2 hour')} group by all"""),
    "area_timeline": _log(f"""select date_trunc('minute', time) as minute, host, count(*) as "count" from log
      where sourcetype = 'app:error' and {CODES} group by all"""),
    "timeline_chart": _log("select date_trunc('minute', time) as minute, " + ", ".join(
        f"count(*) filter (host = 'web-{i:02d}') as \"web-{i:02d}\"" for i in range(9))
        + f" from log where sourcetype = 'app:error' and {CODES} group by 1"),
    "area_first_occurrence": _log(f"""select time, host, sourcetype, null as message from log
      where sourcetype = 'app:error' and {CODES} order by time, seq limit 1"""),
    "error_filter": _log("select seq, error_code from log where error_code = 'E1' or error_code = 'E2'"),
    "event_count": "select count(*) as event_count from events",
}

ORACLE["area_dispatch"] = content_sql({area: ORACLE[f"area_{area}"] for area in (
    "api_errors", "cascading_failure", "host_isolation", "timeline", "first_occurrence")} | {
    "database_slowdown": _log(f"""select host, round(avg(duration_ms), 6) as avg_ms, max(duration_ms) as max_ms,
      count(*) as "count" from log where host in ({HOSTS}) and sourcetype = 'app:error' and duration_ms > 1000
      and {_between('0 hour', '1 hour')} group by host""")})

# --- findings -----------------------------------------------------------------

BUNDLE = {
    "spikes": "detect_spikes", "patterns": "detect_patterns", "cert_anomalies": "detect_cert_anomalies",
    "correlations": "correlate_events", "host_ranking": "host_error_ranking", "slow_queries": "detect_slow_queries",
    "numeric_anomalies": "detect_numeric_anomalies", "event_pairs": "detect_event_pairs",
}


def _found(name: str) -> str:
    return f"({ORACLE[BUNDLE.get(name, name)]})"


def _counts(names) -> str:
    return " union all ".join(f"select '{n}' as type, count(*) as n from {_found(n)}" for n in names)


_ISO = ("concat(strftime({0}, '%Y-%m-%dT%H:%M:%S'), "
        "case when epoch_us({0}) % 1000000 <> 0 then strftime({0}, '.%f') else '' end, '+00:00')")

_WITH_HOST = {"cert_anomalies", "host_ranking", "slow_queries", "numeric_anomalies"}
_WITH_TYPE = {"patterns", "cert_anomalies"}


def _long(names) -> str:
    parts = []
    for n in names:
        severity = "type" if n in _WITH_TYPE else "''"
        host = "host" if n in _WITH_HOST else "''"
        parts.append(f"select '{n}' as kind, {severity} as severity, {host} as host from {_found(n)}")
    return f"select kind as type, severity, host, count(*) as n from ({' union all '.join(parts)}) group by all"


WHOLE = {name: ORACLE[query] for name, query in BUNDLE.items()} | {
    "severity": ORACLE["severity_summary"], "event_count": ORACLE["event_count"]}

_LEVELS = f"(select coalesce(max(\"count\") filter (level = '{{0}}'), 0) from ({ORACLE['severity_summary']}))"

_CERT_LINE = "concat('[', host, '] ', replace(matched_keywords, ',', ', '), ' at ', " + _ISO.format("time") + ")"

ORACLE |= {
    "build_findings": content_sql({n: sql for n, sql in WHOLE.items() if n != "event_pairs"}),
    "findings_counts": _counts(BUNDLE),
    "findings_long": _long(BUNDLE),
    "shared_findings": _long(BUNDLE),
    "findings_json": content_sql(WHOLE),
    "run_summary": f"""select cast((select sum(n) from ({_counts(
        ['spikes', 'cert_anomalies', 'patterns', 'slow_queries', 'numeric_anomalies', 'event_pairs'])})) as bigint)
        as n_findings, {_LEVELS.format('CRITICAL')} as critical, {_LEVELS.format('ERROR')} as error,
      coalesce((select host from {_found('host_ranking')} order by error_count desc, host limit 1), 'n/a')
        as top_error_host""",
    "findings_digest": " union all ".join(
        f"""select {i} as section, '{kind}' as type, 0 as place, concat(count(*), ' {title}') as line from ({WHOLE[kind]})
          having count(*) > 0
          union all select {i}, '{kind}', row_number() over (order by {order}) as place, {line} from ({WHOLE[kind]})
          {where} qualify place <= {limit}"""
        for i, (kind, title, order, line, where, limit) in enumerate((
            ("spikes", "spike(s)", "window_start", f"""concat({_ISO.format('window_start')}, ' — ', event_count, ' events in ',
              window_seconds, 's on hosts: ', replace(hosts, ',', ', '))""", "", 3),
            ("patterns", "repeated pattern(s)", '"count" desc, sourcetype, error_code',
             """concat(sourcetype, ' / error ', error_code, ' — ', "count", 'x')""", "where type = 'repeated_error'", 3),
            ("cert_anomalies", "certificate event(s)", "time, host, raw_excerpt", _CERT_LINE, "", 3),
            ("severity", "severity level(s)", '"count" desc, level', """concat(level, ': ', "count")""", "", 99),
            ("host_ranking", "host(s) with errors", "error_count desc, host", "concat(host, '(', error_count, ')')", "", 3)), 1)),
    "findings_report": f"""
      select 0 as section, 0 as part, '# Findings' as line
      union all select 0, 1, concat('**Severity** ', level, ': ', "count") from {_found('severity_summary')}
      union all select 1, 0, '## Events analysed' union all select 1, 1, cast(count(*) as varchar) from events
      union all select 2, 0, concat('## Spikes (', count(*), ')') from {_found('spikes')}
      union all select 2, 1, concat('- ', {_ISO.format('window_start')}, ' — ', event_count, ' events on ',
        replace(hosts, ',', ', ')) from {_found('spikes')}
      union all select 3, 0, concat('## Cert Anomalies (', count(*), ')') from {_found('cert_anomalies')}
      union all select 3, 1, concat('- ', {_CERT_LINE}) from {_found('cert_anomalies')}
      union all select 4, 0, '## Top Error Hosts'
      union all select * from (select 4, 1, concat('- ', host, ': ', error_count, ' errors') from {_found('host_ranking')}
        order by error_count desc, host limit 5)
      union all select 5, 0, concat('## Slow Queries (', count(*), ')') from {_found('slow_queries')}
      union all select * from (select 5, 1, concat('- ', cast(round_even(duration_ms, 0) as bigint), 'ms [', host, '] — ',
        query) from {_found('slow_queries')} order by duration_ms desc, time, host limit 10)
      union all select 6, 0, concat('## Event Pairs (', count(*), ')') from {_found('event_pairs')}
      union all select 6, 1, concat('- [', entity, '] ''', first_pattern, ''' at ', {_ISO.format('first_time')}, ' -> ''',
        second_pattern, ''' at ', {_ISO.format('second_time')}, ' (+', cast(round_even(span_seconds, 0) as bigint), 's)')
        from {_found('event_pairs')}
      union all select 7, 0, concat('## Numeric Anomalies (', count(*), ')') from {_found('numeric_anomalies')}
      union all select * from (select 7, 1, concat('- ', field, '=', printf('%.2f', value), ' [', host, '] — z=',
        printf('%.2f', z_score), ' (mean=', printf('%.2f', rolling_mean), ', std=', printf('%.2f', rolling_std), ') at ',
        {_ISO.format('time')}, case when window_contaminated then ' (likely window-contamination artifact)' else '' end)
        from {_found('numeric_anomalies')} order by abs(z_score) desc limit 10)""",
}

ORACLE["write_report"] = f"select section, part, line, 'Medium' as confidence from ({ORACLE['findings_report']})"

# The same detectors over the log whose times are text: lines without a readable time drop out of
# every detector that needs the order, and whole seconds replace fractions for some.
_TEXT_LOG = f"{LOG} {TEXT_TIMES}".replace("log as (", "plain as (", 1).replace("from log)", "from plain)", 1) + """,
  log as (select p.* replace (t.time as time) from plain p join times t using (seq))"""


_NEED_TIME = {"spikes", "correlations", "event_pairs", "numeric_anomalies"}


def _on_text(name: str) -> str:
    log = _TEXT_LOG
    if name in _NEED_TIME:
        log = log.replace("join times t using (seq))", "join times t using (seq) where t.time is not null)")
    return WHOLE[name].replace(LOG, log, 1)


# --- history ------------------------------------------------------------------

PAST = """past as (
  select o_orderkey as id, concat('run-', o_custkey) as run_id, cast(o_orderkey % 3 + 1 as int) as iteration,
    lower(regexp_extract(o_orderpriority, '-(\\w+)', 1)) as area, concat('index=main status=', o_orderstatus) as spl,
    o_orderstatus <> 'P' as executed,
    case when o_orderstatus = 'F' then cast(floor(o_totalprice) as bigint) end as result_rows, o_orderdate as created_at
  from orders)"""

REPORTS = """reports as (
  select concat('run-', conv_id) as run_id, conv_id * 100 + turn as id,
    make_timestamp((1704067200 + turn * 3600 + conv_id % 5) * 1000000) as created_at,
    case when role = 'user' then '' else role end as source_file,
    concat('## Report\n**Confidence:** ', case (conv_id + turn) % 4 when 0 then 'High' when 1 then 'medium'
      when 2 then 'LOW' else 'none' end, '\n', text) as report_md,
    'index=main' as spl, '-24h' as earliest, 'now' as latest,
    (conv_id + turn) % 4 as c from conversations)"""

RUNLOG = """runlog as (
  select concat('run-', o_custkey % 50) as run_id, o_orderkey as k, o_orderdate as updated_at, o_orderkey % 97 = 0 as cleared,
    case when o_orderkey % 5 = 0 then o_orderpriority end as source,
    case when o_orderkey % 2 = 0 then cast(o_orderkey % 4 as int) end as iteration,
    case when o_orderkey % 3 = 0 then o_orderstatus end as confidence,
    case when o_orderkey % 7 = 0 then o_orderkey end as events from orders),
  cuts as (select run_id, max((updated_at, k)) as cut from runlog where cleared group by run_id),
  live as (select r.*, (updated_at, k) as moment from runlog r left join cuts c using (run_id)
    where not cleared and (c.cut is null or (updated_at, k) > c.cut)),
  state as (select run_id, arg_max(source, moment) filter (source is not null) as source,
    arg_max(iteration, moment) filter (iteration is not null) as iteration,
    arg_max(confidence, moment) filter (confidence is not null) as confidence,
    arg_max(events, moment) filter (events is not null) as events, max(moment) as moment, max(updated_at) as updated_at
    from live group by run_id)"""

ALERTS = """alerts as (
  select cast(seq as varchar) as alert_id, 'watch' as run_id, time as ts,
    case when status >= 500 then 'critical' else 'warning' end as severity, concat('HTTP ', status) as summary,
    '{}' as detail_json, seq % 3 = 0 as acked from log where status >= 400)"""

_EXAMPLE = "area, spl, result_rows, run_id, iteration"

ORACLE |= {
    "query_examples_recent": f"with {PAST} select {_EXAMPLE} from past where area = 'urgent' order by id desc limit 20",
    "query_examples_effective": f"""with {PAST} select {_EXAMPLE} from past
      order by result_rows desc nulls last, id desc limit 20""",
    "query_area_stats": f"""with {PAST} select area, count(*) as executed_count,
      round(avg(result_rows), 6) as avg_result_rows, median(result_rows) as median_result_rows from past
      where executed and result_rows is not null group by area""",
    "run_queries": f"""with {PAST} select iteration, area, spl, executed, result_rows, created_at from past
      where run_id = 'run-7'""",
    "parse_query_blocks": f"""with {PAST} select id, case when id % 4 = 0 then '' else area end as area, spl from past""",
    "run_history": f"""with {REPORTS} select run_id, coalesce(nullif(source_file, ''), '—') as source,
      strftime(created_at, '%Y-%m-%d %H:%M') as created_at,
      case c when 0 then 'High' when 1 then 'medium' when 2 then 'LOW' else '—' end as confidence from reports""",
    "run_detail": f"""with {REPORTS}, {PAST}, newest as (
       select * from reports qualify row_number() over (partition by run_id order by created_at desc, id desc) = 1)
      select n.run_id, coalesce(nullif(source_file, ''), '—') as source, report_md, n.spl as report_spl, earliest, latest,
        iteration, area, p.spl, executed, result_rows from newest n left join past p on p.run_id = n.run_id""",
    "confidence_flag": f"with {REPORTS} select id, case when c = 0 then 'High' else 'Medium' end as confidence from reports",
    "alerts_open": _log(f", {ALERTS} select * from alerts where severity = 'critical' and not acked"),
    "alerts_ack": _log(f""", {ALERTS} select severity, summary, alert_id in (
        select alert_id from alerts order by ts, alert_id limit 20) as acked, count(*) as n from alerts group by all"""),
    "write_queries": f"""with {PAST} select run_id, iteration, area, 'index=main' as spl, true as executed, n as result_rows
      from (select run_id, iteration, area, count(*) as n from past where run_id in ('run-7', 'run-8') group by all)""",
    "latest_run_status": f"""with {RUNLOG} select run_id, source, iteration, confidence, events, updated_at from state
      order by moment desc limit 1""",
    "latest_run_status_by_id": f"""with {RUNLOG} select run_id, source, iteration, confidence, events, updated_at from state
      where run_id = 'run-7'""",
    "investigation_status": f"""with {REPORTS} select id, case when c = 0 then 'High' else 'Medium' end as confidence,
      case when c = 0 or id % 100 % 4 + 1 >= 3 or id % 3 = 0 or id % 7 = 0 then 'done' else 'continue' end as status
      from reports""",
    "analyze_events": content_sql({name: _on_text(name) for name in WHOLE}),
    "grow_investigation": content_sql({name: _on_text(name) for name in WHOLE if name != "event_pairs"}),
}

# --- sources, sinks, catalogue --------------------------------------------------

_KINDS = """body as (
  select event_type as sourcetype, ts, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events),
 typed as (
  select sourcetype, 'k' as field_name, case when k % 50 = 0 then 'array<string>' when k % 9 = 0 then 'string' else 'bigint' end
    as dtype, ts from body
  union all select sourcetype, 'tag', 'string', ts from body where k % 50 = 0
  union all select sourcetype, 'ratio', 'double', ts from body where k % 9 = 0 and k % 50 <> 0),
 seen as (select sourcetype, field_name, dtype, min(ts) as first_seen, max(ts) as last_seen from typed group by all),
 cols as (
  select event_type as sourcetype, f.field_name, f.dtype, min(ts) as first_seen, max(ts) as last_seen
  from events cross join (values ('event_id', 'bigint'), ('user_id', 'bigint'), ('sourcetype', 'string'),
    ('value', 'double'), ('props', 'string')) f(field_name, dtype) group by all)"""

_MERGED = """select sourcetype, field_name, arg_max(dtype, (last_seen, dtype)) as dtype, min(first_seen) as first_seen,
  max(last_seen) as last_seen from {0} group by sourcetype, field_name"""

_TIME_TEXT = "strftime(log.time, '%Y-%m-%d %H:%M:%S.%f')"

ORACLE |= {
    "read_events_json": _log(f"""select f.form, log.* replace ({_TIME_TEXT} as time)
      from log, (values ('envelope'), ('list')) f(form)"""),
    "read_events_csv": _log(f"""select cast(seq as varchar) as seq, {_TIME_TEXT} as time, host, sourcetype, source, app,
      error_code, cast(duration_ms as varchar) as duration_ms, cast(active_threads as varchar) as active_threads,
      cast(status as varchar) as status, uri, _raw from log"""),
    "read_events": _log(f"""select f.form, seq, {_TIME_TEXT} as time, host, status, duration_ms, _raw
      from log, (values ('lines'), ('envelope'), ('list'), ('csv')) f(form)"""),
    "read_events_lines": _log("""select seq, case when active_threads % 5 <> 0 then active_threads end as k,
      case when active_threads % 5 = 0 or active_threads % 7 = 0 then concat('{"k":',
        case when active_threads % 5 = 0 then concat('"', active_threads, 'x"') else cast(active_threads as varchar) end,
        case when active_threads % 7 = 0 then ',"fresh":[1]' else '' end, '}') end as kept from log"""),
    "read_records": _log("select seq, date_trunc('second', time) as time, host, active_threads, duration_ms from log"),
    "scan_events": _log("""select seq, time, host, status from log where sourcetype = 'app:error'
      and time >= timestamp '2024-01-11 00:00:00' and time < timestamp '2024-01-12 06:00:00'"""),
    "relative_time": _log("""select count(*) filter (time >= timestamp '2024-01-11 12:00:00') as day,
      count(*) filter (time >= timestamp '2024-01-12 11:45:00') as quarter,
      count(*) filter (time >= timestamp '2024-01-02 00:00:00') as since
      from log where time < timestamp '2024-01-12 12:00:00'"""),
    "write_events": _log("select 'run-1' as run_id, cast(seq as varchar) as _time, host, app, uri, status from log"),
    "load_run_events": _log("""select cast(seq as varchar) as _time, host, _raw, seq, duration_ms, error_code from log"""),
    "write_findings": content_sql({name: ORACLE[query] for name, query in BUNDLE.items()}),
    "write_alerts": _log("""select 'watch' as run_id, case when status >= 500 then 'critical' else 'warning' end as severity,
      concat('HTTP ', status, ' on ', host, ' ', uri) as summary, count(*) as n from log where status >= 400 group by all"""),
    "schema_catalog_upsert": f"with {_KINDS} " + _MERGED.format("(select * from seen union all select * from cols)"),
    "schema_catalog_reset": f"""with {_KINDS} select * from ({_MERGED.format('seen')})
      where sourcetype not in ('click', 'view')
      union all select * from cols where sourcetype in ('click', 'view')""",
    "schema_catalog_load": _log("select seq, host, status, duration_ms from log where sourcetype = 'app:error'"),
    "schema_drift": f"""with {_KINDS} select sourcetype, field_name, string_agg(dtype, ',' order by dtype) as dtypes
      from seen group by 1, 2 having count(*) > 1""",
}

# --- streaming ------------------------------------------------------------------

_ROW_ALERTS = f"""
  select 'slow_query' as detector, case when duration_ms >= 300 then 'critical' else 'warning' end as severity,
    concat('Slow query: ', cast(round_even(duration_ms, 0) as bigint), 'ms on ', host) as summary from log
  where duration_ms > 100
  union all select 'cert_anomaly', 'warning', concat('Cert anomaly on ', host, ': ', replace({_keywords(CERT)}, ',', ', '))
    from log where {_keywords(CERT)} <> ''
  union all select 'http_error', case when status >= 500 then 'critical' else 'warning' end,
    concat('HTTP ', status, ' on ', host, ' ', uri) from log where status >= 400"""

_ALL_ALERTS = f"""{_ROW_ALERTS}
  union all select 'spike', 'warning', concat('Spike: ', event_count, ' events in 3600s starting ',
    {_ISO.format('window_start')}) from {_found('spikes')}
  union all select 'pattern', 'info', concat('Repeated ', type, ': count=', "count") from {_found('patterns')}"""

ORACLE |= {
    "tag_alerts": _log(_ALL_ALERTS),
    "stream_row_alerts": _log(_ROW_ALERTS),
    "stream_source": "select event_id, ts, event_type from events where ts >= timestamp '2024-01-19 23:45:00'",
    "stream_spikes_grid": _log("""select date_trunc('hour', time) as window_start, 3600 as window_seconds,
      count(*) as event_count, 20 as threshold, string_agg(distinct host, ',' order by host) as hosts
      from log group by 1 having count(*) >= 20"""),
    "stream_patterns_complete": _log("""select date_trunc('day', time) as slice_start, sourcetype, error_code, count(*) as "count"
      from log group by all having count(*) > 1"""),
    "stream_sessions_keyed": _log(""", steps as (select *, case when time - lag(time) over (partition by app order by time, seq)
        <= interval 60 seconds then 0 else 1 end as opens from log),
      numbered as (select *, sum(opens) over (partition by app order by time, seq) as sid from steps)
      select app, min(time) as group_start, max(time) as group_end, count(*) as event_count,
        string_agg(distinct host, ',' order by host) as hosts,
        string_agg(distinct sourcetype, ',' order by sourcetype) as sourcetypes
      from numbered group by app, sid having count(*) > 1"""),
    "stream_overlap": "select count(*) as n, count(distinct event_id) as events, cast(sum(event_id) as bigint) as total from events",
    "watch_cycles": _log(f"select severity, summary, count(*) as n from ({_ROW_ALERTS}) group by all"),
    "stream_cycle_guard": _log(f"""select severity, summary, count(*) as n from ({_ALL_ALERTS}) group by all"""),
}

# Append mode: what the watermark, 30 seconds behind the newest event, has closed when the stream ends.
_MARK = "(select epoch_ms(max(ts)) * 1000 - 30000000 from events)"

ORACLE |= {
    "stream_spikes": f"""select * from ({_spikes(3600, 20)})
      where (epoch_us(window_start) // 3600000000 + 2) * 3600000000 <= {_MARK}""",
    "stream_sessions": f"""with found as ({_log(SESSIONS)}), next as (
        select *, lead(group_start) over (order by group_start) as later from (
          select group_start, group_end from found union all
          select time, time from ({_log("select time from log")}) where not exists (
            select 1 from found where time between group_start and group_end)) order by group_start)
      select f.* from found f join next n using (group_start)
      where epoch_us(n.group_end) + 120001000 <= {_MARK}
        or (epoch_us(n.later) // 60000000 + 1) * 60000000 <= {_MARK}""",
    "stream_patterns": _log(f""", sliced as (
        select *, date_trunc('day', time) as slice_start from log
        where epoch_us(date_trunc('day', time)) + 86400000000 <= {_MARK}), starts as (
        select * from (select slice_start, substr(_raw, 1, 60) as prefix, count(*) as "count" from sliced group by 1, 2)
        where "count" > 1 qualify row_number() over (partition by slice_start order by "count" desc, prefix) <= 10)
      select slice_start, 'repeated_error' as type, sourcetype, error_code, null as prefix, count(*) as "count"
        from sliced group by all having count(*) > 1
      union all select slice_start, 'repeated_raw_prefix', null, null, prefix, "count" from starts"""),
}
