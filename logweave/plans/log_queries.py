"""Registered queries over records, time, filters, search, facets and sequences, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions import text as shape
from logweave.functions import times
from logweave.operators import facets, filters, records, search, sequences, timeaxis
from logweave.operators.records import Format
from logweave.plans.base import CLASSIC, CLOCKED, LOG, clock_rows, conversation_rows, document_lines, event_lines, event_rows, parsed_rows, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


OPENS = Format("paragraphs", r"^(?'Text'[A-Z].*)")
DOC_LINES = """
dl as (select doc_id as file_id, unnest(string_split(coalesce(text, ''), chr(10))) as text, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as byte_offset from documents),
numbered as (select *, sum(case when regexp_matches(text, '^[A-Z]') then 1 else 0 end) over (partition by file_id order by byte_offset) - 1 as line_no from dl),
recs as (select file_id, line_no::bigint as line_no, min(byte_offset)::bigint as byte_offset, string_agg(text, chr(10) order by byte_offset) as text from numbered group by file_id, line_no)
"""


@query(f"with {DOC_LINES} select * from recs where line_no >= 0")
def record_assembly(spark, sf):
    return records.records(document_lines(spark, sf), OPENS)


@query(f"with {DOC_LINES} select file_id, regexp_replace(text, '\\s+$', '') as text from recs where line_no < 0 and file_id in (select file_id from recs where line_no >= 0)")
def headers(spark, sf):
    return records.headers(document_lines(spark, sf), OPENS)


@query(f"""with {DOC_LINES}, sizes as (select file_id, count(*) as size from dl group by file_id)
select r.file_id, r.line_no, r.byte_offset, (coalesce(lead(r.byte_offset) over (partition by r.file_id order by r.line_no), s.size) - r.byte_offset)::bigint as byte_len
from recs r join sizes s using (file_id) where r.line_no >= 0""")
def record_extents(spark, sf):
    lines = document_lines(spark, sf)
    sizes = lines.groupBy("file_id").agg(F.count("*").alias("size"))
    return records.extents(records.records(lines, OPENS), sizes).select("file_id", "line_no", "byte_offset", "byte_len")


@query("""with dl as (select doc_id as file_id, unnest(string_split(coalesce(text, ''), chr(10))) as text from documents)
select file_id, count(*) as n, sum(length(text))::bigint as chars from dl where text <> '' group by file_id""")
def plain_text_records(spark, sf):
    return records.plain(document_lines(spark, sf)).groupBy("file_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"with {LOG} select file_id, line_no, time, level, thread, component, message from rec")
def field_extraction(spark, sf):
    rows = records.fields(records.records(event_lines(spark, sf), CLASSIC), CLASSIC)
    return rows.select("file_id", "line_no", *[F.col(n).alias(n.lower()) for n in CLASSIC.pattern.names])


@query("""with dl as (select doc_id as file_id, unnest(string_split(coalesce(text, ''), chr(10))) as text, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as k from documents),
head as (select *, row_number() over (partition by file_id order by k) as i from dl where k < 1048576),
r as (select file_id, avg(case when regexp_matches(text, '^[A-Z]') then 1.0 else 0 end) as a, avg(case when regexp_matches(text, '^[a-z]') then 1.0 else 0 end) as b, avg(case when regexp_matches(text, '^[A-Z][a-z]') then 1.0 else 0 end) as c from head where i <= 256 group by file_id)
select file_id, case when greatest(a, b, c) <= 0.05 then 'plain' when a = greatest(a, b, c) then 'capital' when b = greatest(a, b, c) then 'small' else 'sentence' end as format, greatest(a, b, c)::double as ratio from r""")
def format_detection(spark, sf):
    formats = [Format("capital", "^(?'Text'[A-Z].*)"), Format("small", "^(?'Text'[a-z].*)"), Format("sentence", "^(?'Text'[A-Z][a-z].*)")]
    return records.detect(document_lines(spark, sf), formats)


@query("""select event_id, 'x=' || to_base64(event_type::blob) || ' y=' || event_type || '/' || props || ' [' || case when event_id % 2 = 0 then user_id::varchar else to_base64(user_id::varchar::blob) || '!' end || ']' as shown from events""")
def transformation(spark, sf):
    e = table(spark, sf, "events")
    coded = lambda *c: F.base64(F.concat(*c).cast("binary"))
    # the group's text stands twice where event_type and props are empty, the second rule reads what the first has made
    text = F.concat(F.lit("x="), coded("event_type"), F.lit(" y="), coded("event_type", F.lit("/"), "props"), F.lit(" ["), coded(F.col("user_id").cast("string")), F.when(F.col("event_id") % 2 == 0, "").otherwise("!"), F.lit("]"))
    rules = [r"^x=\S+ y=(?'Base64Decode'[A-Za-z0-9+/=]+)", r"/.* (?'Other'\[)(?'Base64Decode'[A-Za-z0-9+/=]+)\]$", r"^other (?'Other'\w+)"]
    return e.select("event_id", records.transform(text, rules).alias("shown"))


@query("""select doc_id, case when length(text) >= 200 then list_aggregate(list_transform(string_split(regexp_replace(text, '\\s+$', ''), chr(10)), lambda x: case when length(x) > 200 then substr(x, 1, 200) || '...' else x end), 'string_agg', chr(10)) else text end as shown from documents""")
def big_line_pruning(spark, sf):
    return table(spark, sf, "documents").select("doc_id", shape.prune(F.col("text"), 200).alias("shown"))


@query("""with l as (select doc_id, unnest(string_split(regexp_replace(text, '\\s+$', ''), chr(10))) as x, length(text) >= 200 as long from documents)
select doc_id, max(case when long then least(length(x), 200) else 0 end)::integer as longest, case when any_value(long) then sum(greatest(1, ceil(length(x) / 200.0)))::integer else 0 end as pieces from l group by doc_id""")
def big_line_breaking(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), F.split(shape.break_lines(F.col("text"), 200), "\n").alias("l"))
    long = F.col("n") >= 200
    return d.select("doc_id", F.when(long, F.array_max(F.transform("l", lambda x: F.length(x)))).otherwise(0).alias("longest"), F.when(long, F.size("l")).otherwise(0).alias("pieces"))


@query("""select doc_id, case when n > 21 then array_to_string(l[1:20], chr(10)) else text end as kept, (case when n > 21 then n - 20 else 0 end)::integer as lines_cut
from (select doc_id, text, string_split(text, chr(10)) as l, len(string_split(text, chr(10))) as n from documents)""")
def long_text_split(spark, sf):
    kept, cut = shape.fold(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", kept.alias("kept"), cut.alias("lines_cut"))


@query(f"with {LOG} select file_id, line_no, ts as ts_raw, time as shown from rec")
def time_parsing(spark, sf):
    return event_rows(spark, sf).select("file_id", "line_no", "ts_raw", times.show(F.col("ts_raw")).alias("shown"))


@query(f"with {CLOCKED} select file_id, line_no, ts_norm from norm")
def time_normalisation(spark, sf):
    return timeaxis.normalise(clock_rows(spark, sf), True).select("file_id", "line_no", "ts_norm")


@query(f"""with {CLOCKED}, b as (select *, lag(ts_norm) over (partition by file_id order by line_no) as p from norm)
select file_id, count(*) as n, bool_or(ts_raw is not null) as has_time, bool_and(coalesce(ts_norm >= p, true)) as monotonic, min(ts_norm) as min_ts, max(ts_norm) as max_ts,
bool_or(ts_raw is not null) and bool_and(coalesce(ts_norm >= p, true)) as timed,
case when bool_or(ts_raw is not null) and bool_and(coalesce(ts_norm >= p, true)) and max(ts_norm) > min(ts_norm) then 'time' else 'lines' end as axis from b group by file_id""")
def file_time_summary(spark, sf):
    return timeaxis.summary(timeaxis.normalise(clock_rows(spark, sf), True))


@query(f"""with {CLOCKED}, d as (select *, case when ts_raw is not null then ts_norm // 86400000000 end as day from norm),
p as (select *, last_value(day ignore nulls) over (partition by file_id order by line_no rows between unbounded preceding and 1 preceding) as before from d)
select file_id, line_no from p where day is not null and line_no > 0 and (before is null or before <> day)""")
def day_boundaries(spark, sf):
    return timeaxis.day_starts(timeaxis.normalise(clock_rows(spark, sf), True))


RANGES = "ranges as (select i as range_id, i * 86400000000 as t_from, i * 86400000000 + 50000000000 as t_to from range(0, 12) t(i))"


@query(f"""with {CLOCKED}, {RANGES} select r.range_id, n.file_id, count(*) filter (n.ts_norm < r.t_from)::bigint as line_from, count(*) filter (n.ts_norm <= r.t_to)::bigint as line_to from norm n, ranges r group by 1, 2""")
def time_range_lines(spark, sf):
    rows = timeaxis.normalise(clock_rows(spark, sf), True)
    ranges = spark.range(12).select(F.col("id").alias("range_id"), (F.col("id") * times.DAY).alias("t_from"), (F.col("id") * times.DAY + 50_000_000_000).alias("t_to"))
    return timeaxis.line_ranges(rows, ranges, timeaxis.summary(rows))


@query("""with d as (select o_orderkey, (o_orderkey * 7919 * case o_orderkey % 4 when 0 then 1 when 1 then 1000 when 2 then 100000 else 1000000 end)::bigint as d from orders),
p as (select *, case when d < 3600000000 then d // 60000000 when d < 86400000000 then d // 3600000000 else d // 86400000000 end as large,
  case when d < 3600000000 then d % 60000000 // 1000000 when d < 86400000000 then d % 3600000000 // 60000000 else d % 86400000000 // 3600000000 end as rest,
  case when d < 3600000000 then ['min', 'sec'] when d < 86400000000 then ['h', 'min'] else ['d', 'h'] end as unit from d)
select o_orderkey, case when d <= 0 then '0 ms' when d < 1000000 then (d // 1000) || ' ms' when d < 60000000 then regexp_replace(round(d::decimal(18,0) / 1000000, 1)::decimal(9,1)::varchar, '[.]0$', '') || ' sec'
else large || ' ' || unit[1] || case when rest > 0 then ' ' || rest || ' ' || unit[2] else '' end end as shown from p""")
def duration_formatting(spark, sf):
    k = F.col("o_orderkey")
    d = k * 7919 * F.when(k % 4 == 0, 1).when(k % 4 == 1, 1000).when(k % 4 == 2, 100000).otherwise(1000000)
    return table(spark, sf, "orders").select("o_orderkey", times.show_duration(d.cast("long")).alias("shown"))


@query(f"with {LOG} select file_id, component as value, count(*) as n from rec where level not in ('VIEW', 'CLICK') and thread not in ('T-8') group by 1, 2")
def facet_counts_after_exclusion(spark, sf):
    keep = filters.Filter().add("Level", ["VIEW"]).add("Level", ["CLICK"]).put("Thread", ["T-8"])
    return facets.counts(keep.apply(parsed_rows(spark, sf)), ["Component"]).drop("field")


@query(f"with {LOG} select file_id, line_no from rec where level in ('ERROR', 'SIGNUP')")
def exclude_all_but(spark, sf):
    return parsed_rows(spark, sf).filter(filters.exclude_all_but("Level", ["ERROR", "SIGNUP"])).select("file_id", "line_no")


@query(f"with {LOG} select file_id, line_no from rec where thread not in (select thread from rec where line_no < 3)")
def exclude_selected(spark, sf):
    rows = parsed_rows(spark, sf)
    return filters.exclude_values_of(rows, rows.filter("line_no < 3"), "Thread").select("file_id", "line_no")


T0 = 1704067200000000  # 2024-01-01 in microseconds


@query(f"with {LOG} select file_id, line_no, ts as ts_norm from rec where ts between {T0 + 86400000000} and {T0 + 3 * 86400000000} and level <> 'VIEW' and line_no >= 100 and line_no < 900")
def composed_view(spark, sf):
    f = filters.Filter(times=(T0 + times.DAY, T0 + 3 * times.DAY), lines=(100, 900)).add("Level", ["VIEW"])
    return f.apply(event_rows(spark, sf)).select("file_id", "line_no", "ts_norm")


@query(f"with {LOG} select file_id, line_no from rec where thread = 'T-46' and level not in ('VIEW')")
def thread_focus(spark, sf):
    rows = filters.Filter().add("Level", ["VIEW"]).apply(parsed_rows(spark, sf))
    return rows.filter(filters.thread("Thread", "T-46")).select("file_id", "line_no")


@query(f"with {LOG} select distinct thread as value from rec where contains(lower(thread), 't-1')")
def facet_value_filter(spark, sf):
    return filters.facet_values(parsed_rows(spark, sf), "Thread", "T-1").select(F.col("Thread").alias("value"))


@query(f"with {LOG} select file_id, line_no from rec where regexp_matches(text, 'error .*value=1[0-9]\\.', 'i')")
def regex_search(spark, sf):
    return parsed_rows(spark, sf).filter(search.matches(r"error .*value=1[0-9]\.")).select("file_id", "line_no")


@query("select doc_id as file_id from documents where contains(lower(text), lower('The of'))")
def literal_search(spark, sf):
    return table(spark, sf, "documents").filter(search.matches("The of", regex=False)).select(F.col("doc_id").alias("file_id"))


@query(f"with {LOG} select file_id, line_no from rec where regexp_matches(text, 'T-4.*comp1.*\\{{\"k\"') and thread not in ('T-40')")
def ordered_terms_with_exclusions(spark, sf):
    p = search.in_order(["T-4", "comp1", '{"k"'])
    return filters.Filter().add("Thread", ["T-40"]).apply(parsed_rows(spark, sf)).filter(search.matches(p, case=True)).select("file_id", "line_no")


@query(f"with {LOG} select file_id, line_no from rec where line_no >= 100 and line_no < 900 and contains(lower(text), 'comp1 value=1')")
def search_in_range(spark, sf):
    rows = filters.Filter(lines=(100, 900)).apply(parsed_rows(spark, sf))
    return rows.filter(search.matches("Comp1 Value=1", regex=False)).select("file_id", "line_no")


@query("select p_partkey, p_name as name, p_type as pattern from part where contains(lower(p_name), 'small') or contains(lower(p_type), 'small')")
def saved_search_filter(spark, sf):
    return search.saved(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("pattern")), "SmalL")


@query("""select event_id, (epoch_us(ts) // 1000 * 1000 // case event_id % 8 when 0 then 1000 when 6 then 86400000000 when 5 then 60000000 when 7 then 60000000 else 1000000 end
* case event_id % 8 when 0 then 1000 when 6 then 86400000000 when 5 then 60000000 when 7 then 60000000 else 1000000 end)::bigint as micros from events""")
def general_time_parsing(spark, sf):
    """The same times in eight spellings, of which some leave out seconds or the time of day."""
    spellings = ["yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MM/dd/yyyy hh:mm:ss a", "d MMM yyyy HH:mm:ss", "MMMM d, yyyy HH:mm", "yyyy/M/d", "M/d/yyyy H:mm"]
    text = F.when(F.col("event_id") % 8 == 0, F.date_format("ts", spellings[0]))
    for i, x in enumerate(spellings[1:], 1):
        text = text.when(F.col("event_id") % 8 == i, F.date_format("ts", x))
    return table(spark, sf, "events").select("event_id", times.parse(text).alias("micros"))


HITS = f"{LOG}, h as (select file_id, line_no, row_number() over (partition by file_id order by line_no) - 1 as hit from rec where contains(text, 'value=9'))"


def _hits(spark, sf):
    return search.hits(parsed_rows(spark, sf), search.matches("value=9", regex=False, case=True))


@query(f"with {HITS} select * from h")
def hit_numbers(spark, sf):
    return _hits(spark, sf)


@query(f"""with {HITS}, e as (select file_id, min(line_no) as f, max(line_no) as l from h group by file_id), r as (select rec.file_id, rec.line_no as anchor, h.line_no as hit from rec left join h on h.file_id = rec.file_id and h.line_no = rec.line_no)
select file_id, anchor, coalesce(min(hit) over (partition by file_id order by anchor rows between 1 following and unbounded following), f) as next_hit, coalesce(max(hit) over (partition by file_id order by anchor rows between unbounded preceding and 1 preceding), l) as previous_hit from r join e using (file_id)""")
def neighbour_hits(spark, sf):
    anchors = parsed_rows(spark, sf).select("file_id", F.col("line_no").alias("anchor"))
    return search.neighbours(_hits(spark, sf).select("file_id", "line_no"), anchors)


@query(f"with {HITS}, n as (select file_id, count(*) as n from rec group by file_id) select h.file_id, (h.line_no * 1000 // n.n)::integer as bucket, count(*) as hits from h join n using (file_id) group by 1, 2")
def match_buckets(spark, sf):
    rows = parsed_rows(spark, sf)
    return search.buckets(_hits(spark, sf), rows.groupBy("file_id").agg(F.count("*").alias("n")))


@query(f"""with {LOG} select 'errors' as name, file_id, count(*) filter (regexp_matches(text, 'error', 'i')) as hits from rec group by file_id union all
select 'nines', file_id, count(*) filter (contains(text, 'value=9')) from rec group by file_id union all select 'keys', file_id, count(*) filter (regexp_matches(text, '"k": 1\\d\\}}')) from rec group by file_id""")
def saved_search_sweep(spark, sf):
    return search.sweep(parsed_rows(spark, sf), [("errors", "error", False, True), ("nines", "value=9", True, False), ("keys", r'"k": 1\d\}', True, True)])


@query("""with w as (select doc_id as file_id, 0::bigint as line_no, regexp_replace(text, '[\\r\\n]+$', '') as t from documents),
s as (select file_id, line_no, string_split_regex(t, 'tion\\w*') as g, regexp_extract_all(t, 'tion\\w*') as m from w),
e as (select *, unnest(range(0, len(m))) as i from s)
select file_id, line_no, (list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))::integer as start, length(m[i + 1])::integer as length, m[i + 1] as value from e""")
def match_spans(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.lit(0).cast("long").alias("line_no"), "text")
    found = search.spans(rows, r"tion[0-9A-Za-z_]*", case=True)
    return found


@query(f"""with {LOG}, c as (select regexp_extract(text, 'ERROR (.*) comp(.*) value', ['a', 'b']) as c from rec where regexp_matches(text, 'ERROR .* comp.* value'))
select c.a as first, c.b as second, count(*) as n from c group by 1, 2""")
def variable_parts(spark, sf):
    out = search.variable_parts(parsed_rows(spark, sf), "ERROR .* comp.* value", case=True)
    return out.select(F.col("captures")[0].alias("first"), F.col("captures")[1].alias("second"), "n")


@query("select event_type as value, count(*) as uses, max(ts) as last_used from events group by 1 order by uses desc, last_used desc limit 3")
def search_history(spark, sf):
    return search.history(table(spark, sf, "events").select(F.col("event_type").alias("value"), F.col("ts").alias("used_at")), 3)


@query(f"with {LOG} select distinct thread as value from rec")
def distinct_facet_values(spark, sf):
    return facets.values(parsed_rows(spark, sf), "Thread").select(F.col("Thread").alias("value"))


@query(f"with {LOG} select file_id, 'Level' as field, level as value, count(*) as n from rec group by file_id, level union all select file_id, 'Component', component, count(*) from rec group by file_id, component")
def facet_counts(spark, sf):
    return facets.counts(parsed_rows(spark, sf), ["Level", "Component"])


@query(f"""with {LOG}, k as (select file_id, level, thread, component, count(*) as n, min(line_no) as first_line from rec group by all)
select *, row_number() over (partition by file_id order by first_line) - 1 as key_no from k""")
def facet_tuples(spark, sf):
    out = facets.tuples(parsed_rows(spark, sf), list(CLASSIC.indexed))
    return out.select(*[F.col(c).alias(c.lower()) for c in out.columns])


@query(f"with {LOG} select file_id, 'Level' as field, level as value, count(*) as n from rec where contains(text, 'value=9') group by all")
def hit_facet_counts(spark, sf):
    return facets.counts(parsed_rows(spark, sf).filter(search.matches("value=9", False, True)), ["Level"])


@query("""with x as (select distinct 'type' as field, event_type as value from events where event_type in ('view', 'click') union select distinct 'user', user_id::varchar from events where user_id = 8)
select field, case when count(*) = 1 then min(value) else count(*)::varchar end as hidden from x group by field""")
def filter_summary(spark, sf):
    e = table(spark, sf, "events")
    some = e.filter(F.col("event_type").isin("view", "click")).select(F.lit("type").alias("field"), F.col("event_type").alias("value"))
    return facets.excluded_summary(some.unionByName(e.filter("user_id = 8").select(F.lit("user").alias("field"), F.col("user_id").cast("string").alias("value"))))


@query(f"""with {LOG}, f as (select file_id, min(ts) as a, max(ts) as z from rec group by file_id)
select r.file_id, least((r.ts - f.a) * 100 // (f.z - f.a), 99)::integer as bucket, count(*) as n from rec r join f using (file_id) group by 1, 2""")
def line_density(spark, sf):
    rows = event_rows(spark, sf)
    return facets.density(rows, timeaxis.summary(rows), 100)


TURNS = "t as (select conv_id as file_id, turn as line_no, role, lag(role) over (partition by conv_id order by turn) as before, max(turn) over (partition by conv_id) as z, lag(turn) over (partition by conv_id order by turn) as any_before from conversations)"


@query(f"""with {TURNS} select file_id, line_no::bigint as line_no, role, coalesce(any_before is not null and before is not distinct from role, false) as continuation, not coalesce(any_before is not null and before is not distinct from role, false) as first, line_no = z as last, role <> 'user' as other from t""")
def thread_grouping(spark, sf):
    rows = conversation_rows(spark, sf).select("file_id", "line_no", "role")
    return sequences.thread_marks(rows, "role", F.lit("user"), order="line_no")


@query(f"""with {LOG}, b as (select *, lag(level) over (partition by file_id order by line_no) as p from rec), g as (select *, sum(case when p = level then 0 else 1 end) over (partition by file_id order by line_no) - 1 as run from b)
select file_id, run::bigint as run, min(level) as thread, min(line_no) as first_line, max(line_no) as last_line, count(*) as n, max(ts) - min(ts) as duration from g group by file_id, run""")
def thread_runs(spark, sf):
    return sequences.thread_runs(event_rows(spark, sf), "Level")


@query(f"""with {LOG}, v as (select file_id, line_no, row_number() over (order by file_id, line_no) - 1 as view_pos from rec where level = 'ERROR') select * from v where view_pos >= 100 and view_pos < 150""")
def view_page(spark, sf):
    return sequences.page(parsed_rows(spark, sf).filter("Level = 'ERROR'").select("file_id", "line_no"), 100, 50)


@query(f"""with {HITS} select distinct r.file_id, r.line_no from rec r join h on h.file_id = r.file_id and r.line_no between h.line_no - 2 and h.line_no + 2""")
def hit_context(spark, sf):
    return sequences.context(parsed_rows(spark, sf).select("file_id", "line_no"), _hits(spark, sf), 2)


@query(f"""with {LOG}, n as (select file_id, count(*) as n from rec where level = 'ERROR' group by file_id)
select file_id, line_no as anchor, least(count(*) filter (level = 'ERROR') over (partition by file_id order by line_no rows between unbounded preceding and 1 preceding), n - 1)::bigint as view_pos from rec join n using (file_id)""")
def nearest_visible_row(spark, sf):
    rows = parsed_rows(spark, sf)
    return sequences.nearest(rows.filter("Level = 'ERROR'").select("file_id", "line_no"), rows.select("file_id", F.col("line_no").alias("anchor")))


@query(f"with {LOG} select file_id, line_no, level from rec order by file_id, line_no")
def record_order(spark, sf):
    return parsed_rows(spark, sf).select("file_id", "line_no", F.col("Level").alias("level")).orderBy("file_id", "line_no")
