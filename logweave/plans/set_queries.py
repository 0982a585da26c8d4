"""Registered queries over merges, row sets, dictionaries, rules, payloads and call stacks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.operators import dictionaries, filters, marks, merge, payloads, records, search, sequences, symbols, timeaxis
from logweave.plans.base import LOG, parsed_rows, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- merges: events and orders are timed, documents are not


def _sources(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_norm"), F.upper("event_type").alias("Level"), F.concat(F.lit("T-"), F.col("user_id").cast("string")).alias("Thread"), F.col("props").alias("Message"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_no"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + 800_000_000_000_000).alias("ts_norm"), F.col("o_orderstatus").alias("severity"), F.concat(F.lit("T-"), F.col("o_custkey").cast("string")).alias("thread"), F.col("o_orderpriority").alias("Text"), F.lit("orders").alias("Component"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("line_no"), F.lit(0).cast("long").alias("ts_norm"), F.col("text"))
    return [
        merge.Source(e, ("Level", "Thread", "Message"), frozenset({"Level", "Thread"}), True),
        merge.Source(o, ("severity", "thread", "Component", "Text"), frozenset({"thread", "Component"}), True),
        merge.Source(d, ("text",), frozenset(), False),
    ]


MERGED = """
src as (
  select 0 as source_ix, true as source_timed, event_id as line_no, epoch_us(ts) as ts_norm, upper(event_type) as severity, 'T-' || user_id as thread, props as message, '' as component from events
  union all select 1, true, o_orderkey, epoch_us(o_orderdate) + 800000000000000, o_orderstatus, 'T-' || o_custkey, o_orderpriority, 'orders' from orders
  union all select 2, false, doc_id, 0, '', '', substr(text, 1, 20), '' from documents),
merged as (select *, row_number() over (order by case when source_timed then ts_norm else 9223372036854775807 end, source_ix, line_no) - 1 as pos from src)
"""


def _small(df):
    return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])


WHOLE_MERGED = MERGED.replace("substr(text, 1, 20)", "coalesce(text, '')")


@query(f"with {WHOLE_MERGED} select pos, source_ix, line_no, severity, thread, component, message from merged")
def merged_logs(spark, sf):
    return _small(merge.merge(_sources(spark, sf)).drop("source_timed", "ts_norm"))


@query(f"with {MERGED}, m as (select *, max(case when source_timed then ts_norm end) over (order by pos) as n, lag(ts_norm) over (order by pos) as p from merged) select bool_and(p is null or coalesce(n >= p, true)) as monotonic, min(n) as min_ts, max(n) as max_ts, count(*) as n from m")
def merged_time_axis(spark, sf):
    rows = merge.merge(_sources(spark, sf)).select(F.lit(0).alias("file_id"), F.col("pos").alias("line_no"), F.when(F.col("source_timed"), F.col("ts_norm")).alias("ts_raw"))
    return timeaxis.summary(timeaxis.normalise(rows, False)).select("monotonic", "min_ts", "max_ts", "n")


@query(f"""with {WHOLE_MERGED}, c as (select count(nullif(severity, '')) as s, count(nullif(thread, '')) as t, count(nullif(message, '')) as m, count(nullif(component, '')) as c from merged)
select 0 as ord, 'Severity' as name, true as indexed, s as n from c union all select 1, 'Thread', true, t from c union all select 2, 'Message', false, m from c union all select 3, 'Component', true, c from c""")
def merged_schema(spark, sf):
    counts = merge.field_counts(_sources(spark, sf))
    return counts.withColumn("name", F.when(F.col("name") == "severity", "Severity").otherwise(F.col("name")))


@query(f"with {MERGED} select pos, source_ix from merged where not (source_ix in (0, 1) and thread in ('T-8', 'T-899'))")
def merged_exclusions(spark, sf):
    m = merge.merge(_sources(spark, sf))
    indexed = {0: {"Thread"}, 1: {"Thread"}, 2: set()}
    return m.filter(filters.merged_exclusion("Thread", ["T-8", "T-899"], indexed)).select("pos", "source_ix")


@query(f"with {MERGED} select pos, source_ix from merged where not source_timed or ts_norm between 1704153600000000 and 1704326400000000")
def merged_time_range(spark, sf):
    return merge.merge(_sources(spark, sf)).filter(filters.merged_times(1704153600000000, 1704326400000000)).select("pos", "source_ix")


@query(f"with {MERGED} select severity as value, count(*) as n from merged group by 1")
def merged_facet_counts(spark, sf):
    return merge.facet_counts(_small(merge.align(_sources(spark, sf))), "severity")


@query(f"with {MERGED} select pos, source_ix, line_no from merged where source_ix = 0 and thread = 'T-8' and regexp_matches(message, '\"k\": 6')")
def merged_search(spark, sf):
    sources = _sources(spark, sf)
    found = {0: sources[0].rows.filter(search.matches('"k": 6', text="Message")), 1: sources[1].rows.filter(search.matches("URGENT", text="Text"))}
    return merge.search(merge.merge(sources), found, ("Thread", "T-8", 0)).select("pos", "source_ix", "line_no")


SEGMENTS = f"{MERGED}, b as (select pos, source_ix, lag(source_ix) over (order by pos) as p from merged), g as (select *, sum(case when p = source_ix then 0 else 1 end) over (order by pos) as run from b)"


@query(f"with {SEGMENTS} select min(pos) as start, max(pos) + 1 as end, min(source_ix) as source_ix from g group by run")
def source_segments(spark, sf):
    return sequences.segments(merge.merge(_sources(spark, sf)))


@query(f"""with {MERGED}, n as (select count(*) as total from merged), e as (select i as b, round_even(i * (total / 50::double), 0)::bigint as a, round_even((i + 1) * (total / 50::double), 0)::bigint as z from range(0, 50) t(i), n),
c as (select b, a, z, source_ix, count(*) as c from merged m join e on m.pos >= a and m.pos < z group by all), t as (select *, row_number() over (partition by b order by c desc, source_ix) as k from c),
p as (select *, lag(source_ix) over (order by b) as p from t where k = 1), g as (select *, sum(case when p = source_ix then 0 else 1 end) over (order by b) as run from p)
select min(a) as start, max(z) as end, min(source_ix) as source_ix from g group by run""")
def sampled_source_segments(spark, sf):
    m = merge.merge(_sources(spark, sf))
    return sequences.sampled_segments(m, m.count(), 50)


@query(f"with {MERGED}, p as (select *, lag(source_ix) over (order by pos) as s, lag(thread) over (order by pos) as t from merged) select pos, coalesce(s = source_ix and t = thread, false) as continuation from p where source_ix < 2")
def merged_thread_identity(spark, sf):
    m = merge.merge(_sources(spark, sf)).withColumn("__id", F.struct("source_ix", "Thread")).withColumn("file_id", F.lit(0))
    return sequences.thread_marks(m, "__id").filter("source_ix < 2").select("pos", "continuation")


@query(f"with {MERGED}, k as (select source_ix, row_number() over (order by case when source_timed then ts_norm else 9223372036854775807 end, source_ix, line_no) - 1 as pos from src where source_ix in (0, 2)) select case when source_ix = 2 then 1 else 0 end as source_ix, pos from k")
def chosen_sources(spark, sf):
    return merge.merge(merge.chosen(_sources(spark, sf), [0, 2])).select("source_ix", "pos")


# ---- row sets: ranges of lineitem per supplier modulo


def _ranges(spark, sf, k: int):
    li = table(spark, sf, "lineitem").filter(F.col("l_linenumber") % 2 == k)
    return li.select((F.col("l_suppkey") % 5).alias("file_id"), (F.col("l_orderkey") * 3).alias("start"), (F.col("l_orderkey") * 3 + F.col("l_linenumber") - 3).alias("end"))


POINTS = """
a as (select distinct l_suppkey % 5 as file_id, unnest(range(l_orderkey * 3, l_orderkey * 3 + l_linenumber - 2)) as x from lineitem where l_linenumber % 2 = 0),
b as (select distinct l_suppkey % 5 as file_id, unnest(range(l_orderkey * 3, l_orderkey * 3 + l_linenumber - 2)) as x from lineitem where l_linenumber % 2 = 1)
"""
ISLANDS = "i as (select file_id, x, x - row_number() over (partition by file_id order by x) as g from s) select file_id, min(x) as start, max(x) as end from i group by file_id, g"


def _set_query(sets: str):
    return f"with {POINTS}, s as ({sets}), {ISLANDS}"


EVERY_POINT = "s as (select distinct l_suppkey % 5 as file_id, unnest(range(l_orderkey * 3, l_orderkey * 3 + l_linenumber - 2)) as x from lineitem)"


def _every_range(spark, sf):
    return _ranges(spark, sf, 0).unionByName(_ranges(spark, sf, 1))


@query(f"with {EVERY_POINT}, {ISLANDS}")
def ranges_normalised(spark, sf):
    return marks.normalise(_every_range(spark, sf))


@query(f"with {EVERY_POINT} select file_id, count(*) as n from s group by file_id")
def ranges_size(spark, sf):
    return marks.size(_every_range(spark, sf))


def _lower_half(spark, sf):
    """The lower half of each file's own extent."""
    extent = _every_range(spark, sf).filter("start <= end").groupBy("file_id").agg(F.min("start").alias("start"), F.max("end").alias("__z"))
    return extent.select("file_id", "start", F.floor((F.col("start") + F.col("__z")) / 2).alias("end"))


LOWER = "ext as (select file_id, (min(x) + max(x)) // 2 as mid from (select * from a union all select * from b) group by file_id), al as (select a.* from a join ext using (file_id) where x <= mid), bl as (select b.* from b join ext using (file_id) where x <= mid)"


@query(f"with {POINTS}, {LOWER}, s as (select * from (select * from a except select * from al) union select * from bl), {ISLANDS}")
def ranges_restore(spark, sf):
    return marks.restore(_ranges(spark, sf, 0), _ranges(spark, sf, 1), _lower_half(spark, sf))


@query(f"with {POINTS}, {LOWER}, open as (select distinct file_id from (select * from bl except select * from a)), s as ((select * from a union select * from bl where file_id in (from open)) except select * from bl where file_id not in (from open)), {ISLANDS}")
def ranges_toggle(spark, sf):
    return marks.toggle(_ranges(spark, sf, 0), marks.intersect(_ranges(spark, sf, 1), _lower_half(spark, sf)))


@query(_set_query("select * from a union select * from b"))
def ranges_union(spark, sf):
    return marks.union(_ranges(spark, sf, 0), _ranges(spark, sf, 1))


@query(_set_query("select * from a except select * from b"))
def ranges_subtract(spark, sf):
    return marks.subtract(_ranges(spark, sf, 0), _ranges(spark, sf, 1))


@query(_set_query("select * from a intersect select * from b"))
def ranges_intersect(spark, sf):
    return marks.intersect(_ranges(spark, sf, 0), _ranges(spark, sf, 1))


def _marks(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey % 40 = 0").select((F.col("o_orderkey") % 3).alias("file_id"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 9).alias("end"))


MARKS = f"{LOG}, m as (select o_orderkey % 3 as file_id, o_orderkey as a, o_orderkey + o_custkey % 9 as z from orders where o_orderkey % 40 = 0)"


def _every_mark(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_orderkey") % 3).alias("file_id"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 9).alias("end"))


EVERY_MARK = f"{LOG}, m as (select distinct o_orderkey % 3 as file_id, unnest(range(o_orderkey, o_orderkey + o_custkey % 9 + 1)) as line_no from orders)"


@query(f"with {EVERY_MARK} select file_id, line_no, text from rec semi join m using (file_id, line_no)")
def marked_rows(spark, sf):
    return marks.members(parsed_rows(spark, sf), _every_mark(spark, sf)).select("file_id", "line_no", "text")


@query(f"with {EVERY_MARK} select file_id, line_no from rec semi join m using (file_id, line_no) where level <> 'VIEW'")
def visible_marks(spark, sf):
    return filters.Filter().add("Level", ["VIEW"]).apply(marks.members(parsed_rows(spark, sf), _every_mark(spark, sf))).select("file_id", "line_no")


@query(f"with {EVERY_MARK} select text as value from rec semi join m using (file_id, line_no)")
def selection_export(spark, sf):
    return marks.export(parsed_rows(spark, sf), _every_mark(spark, sf))


@query("select distinct o_custkey as value from orders where o_custkey not in (select user_id from events)")
def values_except(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("value")).subtract(table(spark, sf, "events").select("user_id"))


# ---- dictionaries and rules


def _mappings(spark, sf):
    n = table(spark, sf, "nation")
    codes = n.select(F.lit("users").alias("list"), F.lit(1).alias("ord"), F.lit(True).alias("enabled"), F.lit(False).alias("ignore_case"), F.concat(F.lit("T-"), (F.col("n_nationkey") * 5).cast("string")).alias("value"), F.col("n_name").alias("mapping"))
    levels = spark.createDataFrame([("levels", 0, True, True, "click", "pressed"), ("levels", 0, True, True, "error", "failed"), ("off", 2, False, True, "view", "seen")], codes.schema)
    return codes.unionByName(levels)


MAPPED = f"{LOG}, map as (select 'users' as list, 'T-' || n_nationkey * 5 as value, n_name as mapping from nation union all values ('levels', 'CLICK', 'pressed'), ('levels', 'ERROR', 'failed'))"


@query(f"with {MAPPED} select file_id, line_no, token, list, mapping from (select file_id, line_no, unnest([level, thread]) as token from rec) t join map on map.value = t.token")
def code_occurrences(spark, sf):
    return dictionaries.occurrences(parsed_rows(spark, sf), _mappings(spark, sf)).drop("i", "start")


@query(f"with {MAPPED} select file_id, line_no, time || ' ' || level || coalesce('(' || a.mapping || ')', '') || ' ' || thread || coalesce('(' || b.mapping || ')', '') || ' ' || component || ' ' || message as annotated from rec left join map a on a.value = level left join map b on b.value = thread")
def annotated_text(spark, sf):
    return dictionaries.annotate(parsed_rows(spark, sf), _mappings(spark, sf)).select("file_id", "line_no", "annotated")


@query(f"with {LOG} select rule, count(*) as n from (select coalesce(case when regexp_matches(text, 'ERROR .*comp1') then 0 when regexp_matches(text, 'T-4') then 1 when regexp_matches(text, 'ERROR') then 2 end, -1)::integer as rule from rec) group by rule")
def rule_classification(spark, sf):
    return dictionaries.classify(parsed_rows(spark, sf), ["ERROR .*comp1", "T-4", "ERROR"]).groupBy(F.coalesce("rule", F.lit(-1)).alias("rule")).agg(F.count("*").alias("n"))


@query("select event_id, '$.k' as path, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null")
def payload_leaves(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("props").alias("payload"))
    return payloads.leaves(e, keys=("event_id",))


@query("select e.event_id, json_extract_string(props, '$.k') as value, n_name as mapping from events e join nation on n_nationkey::varchar = json_extract_string(props, '$.k')")
def payload_code_join(spark, sf):
    found = payloads.leaves(table(spark, sf, "events").select("event_id", F.col("props").alias("payload")), keys=("event_id",))
    codes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("value"), F.col("n_name").alias("mapping"))
    return found.join(codes, "value").select("event_id", "value", "mapping")


@query(f"with {LOG} select file_id, line_no, (length(text) - length(props))::integer as start, length(props)::integer as length, 'json' as kind, props as payload from (select r.*, e.props from rec r join events e on e.event_id = r.byte_offset)")
def structured_payloads(spark, sf):
    return payloads.structured(parsed_rows(spark, sf))


# ---- encoded payloads, rendered into log text


def _coded(spark, sf):
    e = table(spark, sf, "events")
    plain = F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).cast("binary")
    pem = F.concat(F.lit("-----BEGIN DATA-----\\n"), F.base64(plain), F.lit("\\n-----END DATA-----"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("sent "), F.base64(plain), F.lit(" ok"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("raw "), F.hex(plain), F.lit(" ok"))).otherwise(F.concat(F.lit("key "), pem))
    return e.select(F.lit(0).alias("file_id"), F.col("event_id").alias("line_no"), text.alias("text"))


PLAIN = "p as (select event_id, event_type || ' by user ' || user_id as s from events)"


@query(f"with {PLAIN} select event_id as line_no, s as decoded from p where event_id % 3 = 0")
def base64_payloads(spark, sf):
    return payloads.base64(_coded(spark, sf)).select("line_no", "decoded")


@query(f"with {PLAIN} select event_id as line_no, s as decoded from p where event_id % 3 = 1 and not regexp_matches(hex(s), '^[0-9]+$')")
def hex_payloads(spark, sf):
    return payloads.hex_runs(_coded(spark, sf)).select("line_no", "decoded")


@query(f"with {PLAIN} select event_id as line_no, 'DATA' as label, length(s)::integer as n_bytes, sha1(s) as sha1 from p where event_id % 3 = 2")
def pem_payloads(spark, sf):
    return payloads.pem(_coded(spark, sf)).select("line_no", "label", "n_bytes", "sha1")


@query(f"with {PLAIN} select case event_id % 3 when 0 then 'base64' when 1 then 'hex' else 'pem' end as kind, count(*) as n, count(distinct s) as n_distinct from p where event_id % 3 <> 1 or not regexp_matches(hex(s), '^[0-9]+$') group by 1")
def payload_kinds(spark, sf):
    return payloads.kinds(_coded(spark, sf))


@query(f"with {PLAIN} select event_id as line_no, case when event_id % 3 = 0 then 'sent ' || s || ' ok' when event_id % 3 = 2 then 'key -----BEGIN DATA-----' || chr(10) || s || chr(10) || '-----END DATA-----' when regexp_matches(hex(s), '^[0-9]+$') then 'raw ' || hex(s) || ' ok' else 'raw ' || s || ' ok' end as decoded from p")
def decoded_text(spark, sf):
    return payloads.decoded_text(_coded(spark, sf)).select("line_no", "decoded")


@query("select event_id as line_no, event_type || ' at home' as decoded from events")
def glued_base64(spark, sf):
    return _glued(table(spark, sf, "events"))


def _glued(e):
    d = e.select(F.lit(0).alias("file_id"), F.col("event_id").alias("line_no"), F.concat(F.lit("img/"), F.regexp_replace(F.base64(F.concat("event_type", F.lit(" at home")).cast("binary")), "=", "")).alias("text"))
    return payloads.glued_base64(d).select("line_no", "decoded")


@query("select event_id, json_extract_string(props, '$.k') || ' of user ' || user_id as decoded from events where json_extract_string(props, '$.k') is not null")
def decoded_leaves(spark, sf):
    return _coded_leaves(table(spark, sf, "events"))


def _coded_leaves(e):
    inner = F.concat(F.get_json_object("props", "$.k"), F.lit(" of user "), F.col("user_id").cast("string"))
    made = e.select("event_id", F.to_json(F.struct(F.base64(inner.cast("binary")).alias("data"))).alias("payload"))
    return payloads.base64_values(payloads.leaves(made, keys=("event_id",)), "value", ("event_id",))


@query(f"with {LOG} select file_id, line_no, 'value' as key, split_part(split_part(message, 'value=', 2), ' ', 1) as value from rec union all select r.file_id, r.line_no, 'props', e.props from rec r join events e on e.event_id = r.byte_offset")
def key_value_pairs(spark, sf):
    rows = parsed_rows(spark, sf).withColumn("text", F.col("Message"))
    return payloads.pairs(rows).drop("i")


@query("with m as (select event_id as line_no, event_type as t, user_id as u from events) select line_no, 'bracket' as kind, t as term from m union all select line_no, 'quoted', 'user ' || u from m union all select line_no, 'path', 'C:\\logs\\' || t || '.txt' from m")
def text_terms(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit("got ["), F.col("event_type"), F.lit('] from "user '), F.col("user_id").cast("string"), F.lit('" in C:\\logs\\'), F.col("event_type"), F.lit(".txt"))
    d = e.select(F.lit(0).alias("file_id"), F.col("event_id").alias("line_no"), text.alias("text"))
    return payloads.terms(d).select("line_no", "kind", "term")


@query("""with e as (select *, event_type as t, '_' || user_id as u from events) select event_id as line_no, 'token' as kind, unnest(['net', t, 'user' || u, 'v1.' || event_id, 'it''s']) as term from e""")
def text_tokens(spark, sf):
    text = F.concat(F.lit(".net <"), F.col("event_type"), F.lit(">-- user_"), F.col("user_id").cast("string"), F.lit(", v1."), F.col("event_id").cast("string"), F.lit(". it's '"))
    return payloads.tokens(table(spark, sf, "events").select(F.col("event_id").alias("line_no"), text.alias("text")), keys=("line_no",))


@query("""with h as (select event_id, sha256(event_id::varchar) || sha256(user_id::varchar) as h from events)
select event_id as line_no, 'rsa blob' as kind, 'CALG_RSA_KEYX' as algorithm, 512::bigint as bits, 65537::bigint as exponent, upper(array_to_string(list_reverse(list_transform(range(0, 64), lambda i: substr(h, 2 * i + 1, 2))), '')) as modulus from h""")
def key_blobs(spark, sf):
    body = F.concat(F.lit("06020000" "00A40000" "52534131" "00020000" "01000100"), F.sha2(F.col("event_id").cast("string"), 256), F.sha2(F.col("user_id").cast("string"), 256))
    text = F.concat(F.lit("key "), F.regexp_replace(F.base64(F.unhex(body)), r"\s", ""), F.lit(" end"))
    d = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), text.alias("text"))
    return payloads.key_blobs(d, keys=("line_no",)).drop("i", "token")


# ---- call stacks, rendered from lineitem; symbols are parts


GUID = "01234567-89AB-CDEF-0123-456789ABCDEF"


def _stacks(spark, sf):
    """Records of frames in all three spellings: with an identity, with an address alone, and with a sign before it."""
    li = table(spark, sf, "lineitem")
    module = F.concat(F.lit("mod"), (F.col("l_suppkey") % 10).cast("string"), F.lit(".dll"))
    rva = F.lower(F.hex(F.col("l_partkey") * 16 + F.col("l_linenumber") - 1))
    k = F.col("l_linenumber") % 3
    place = F.when(k == 0, F.concat(F.lit(f"!{GUID},0"), (F.col("l_suppkey") % 10).cast("string"), F.lit("!"), rva)).when(k == 1, F.concat(F.lit("!"), rva)).otherwise(F.concat(F.lit("+0x"), rva))
    frame = F.concat(F.when(k == 1, "  ").otherwise(""), F.col("l_linenumber").cast("string"), F.lit("# "), module, place)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", frame.alias("f")))), lambda x: x["f"])
    d = li.groupBy("l_orderkey").agg(F.concat(F.lit("Call stack:\n"), F.array_join(lines, "\n")).alias("text"))
    return d.select(F.lit(0).alias("file_id"), F.col("l_orderkey").alias("line_no"), "text")


def _symbols(spark, sf):
    p = table(spark, sf, "part").filter("p_partkey % 3 = 0")
    images = F.explode(F.array(F.concat(F.lit("image"), (F.col("p_partkey") % 10).cast("string")), F.concat(F.lit("flat"), (F.col("p_partkey") % 10).cast("string"))))
    return p.select(images.alias("image_id"), (F.col("p_partkey") * 16).cast("decimal(20,0)").alias("rva"), F.col("p_name").alias("function"), F.lit("main.c").alias("file"), F.col("p_partkey").cast("int").alias("line"))


def _catalogue(spark, sf):
    """Filed symbol files of modules below 8; flat ones of another identity for 0 and 1 in a store before; a flat one of 8
    whose second identity fits."""
    s = table(spark, sf, "supplier").filter("s_suppkey < 9")
    key, name = F.col("s_suppkey").cast("string"), F.concat(F.lit("mod"), F.col("s_suppkey").cast("string"), F.lit(".pdb")).alias("file_name")
    own = F.concat(F.lit(GUID.replace("-", "")), key)
    entry = lambda store, flat, index, other, image: (F.lit(store).alias("store_ord"), name, F.lit(flat).alias("flat"), index.alias("index"), other.cast("string").alias("other_index"), F.concat(F.lit(image), key).alias("image_id"))
    filed = s.filter("s_suppkey < 8").select(*entry(1, False, own, F.lit(None), "image"))
    before = s.filter("s_suppkey < 2").select(*entry(0, True, F.lit("other"), F.lit(None), "flat"))
    after = s.filter("s_suppkey = 8").select(*entry(2, True, F.lit("other"), own, "image"))
    return filed.unionByName(before).unionByName(after)


FRAMES = f"""f0 as (select l_orderkey as line_no, l_linenumber as number, l_suppkey % 10 as m, l_partkey * 16 + l_linenumber - 1 as rva, l_linenumber % 3 as k,
  case when l_linenumber % 3 = 1 then '  ' else '' end as lead from lineitem),
fa as (select *, 'mod' || m || '.dll' as module, case when k = 0 then '{GUID.replace("-", "")}' || m end as index,
  number || '# mod' || m || '.dll' || case k when 0 then '!{GUID},0' || m || '!' when 1 then '!' else '+0x' end || printf('%x', rva) as frame,
  case when k = 0 and m < 9 then 'image' || m when k <> 0 and m < 2 then 'flat' || m when k <> 0 and m = 8 then 'image8' end as image from f0),
fr as (select *, row_number() over (partition by line_no order by number, frame) - 1 as i from fa)"""


@query(f"with {FRAMES} select line_no, i::integer as i, number, module, rva::double as rva, index, (11 + sum(1 + length(lead || frame)) over (partition by line_no order by i) - length(frame))::integer as start, frame from fr")
def call_stack_frames(spark, sf):
    return symbols.identity(symbols.frames(_stacks(spark, sf))).select("line_no", "i", "number", "module", F.col("rva").cast("double").alias("rva"), "index", "start", "frame")


def _images(spark, sf):
    """Suppliers 0 to 8 name the modules whose symbols are known."""
    return symbols.symbol_files(symbols.identity(symbols.frames(_stacks(spark, sf))), _catalogue(spark, sf))


HELD = f"{FRAMES}, fi as (select fr.* exclude (image), case when exists (select 1 from supplier where s_suppkey = fr.m) then image end as image from fr)"


@query(f"with {HELD} select line_no, number, coalesce(image, '-') as image_id from fi")
def symbol_file_lookup(spark, sf):
    return _images(spark, sf).select("line_no", "number", F.coalesce("image_id", F.lit("-")).alias("image_id"))


RESOLVED = f"{HELD}, sy as (select unnest(['image' || p_partkey % 10, 'flat' || p_partkey % 10]) as image, p_partkey * 16 as addr, p_name as function, p_partkey as line from part where p_partkey % 3 = 0), r as (select f.*, s.addr, s.function, s.line, case when f.image is null or f.image not in (select image from sy) then 'no symbols' when s.addr is null then 'not resolved' else 'resolved' end as status from fi f asof left join sy s on f.image = s.image and f.rva >= s.addr)"


def _resolved(spark, sf):
    return symbols.resolve(_images(spark, sf), _symbols(spark, sf))


@query(f"with {RESOLVED} select line_no, number, coalesce(function, '') as function, coalesce(rva - addr, -1)::double as displacement, status from r")
def symbol_resolution(spark, sf):
    return _resolved(spark, sf).select("line_no", "number", F.coalesce("function", F.lit("")).alias("function"), F.coalesce(F.col("displacement").cast("double"), F.lit(-1.0)).alias("displacement"), "status")


@query(f"with {RESOLVED} select line_no, 'Call stack:' || chr(10) || string_agg(lead || case status when 'resolved' then number || '# ' || module || '!' || function || case when rva > addr then '+0x' || printf('%x', rva - addr) else '' end || ' [main.c @ ' || line || ']' when 'no symbols' then frame || '  (no symbols)' else frame || '  (symbol not found)' end, chr(10) order by i) as annotated from r group by line_no")
def frame_annotation(spark, sf):
    return symbols.annotate(_stacks(spark, sf), _resolved(spark, sf)).select("line_no", "annotated")


@query("""with p as (select 'D:/build/' || p_type || '/' || p_brand || '/main.c' as path, p_type || '/' || p_brand || '/main.c' as long, p_brand || '/main.c' as short, p_brand from (select distinct p_type, p_brand from part))
select path, case when p_brand in (select p_brand from part where p_partkey % 2 = 0) then 0 else 1 end as root_ord, case when p_brand in (select p_brand from part where p_partkey % 2 = 0) then short else long end as rel_path from p""")
def source_paths(spark, sf):
    p = table(spark, sf, "part")
    paths = p.select(F.concat(F.lit("D:/build/"), "p_type", F.lit("/"), "p_brand", F.lit("/main.c")).alias("path")).distinct()
    short = p.filter("p_partkey % 2 = 0").select(F.lit(0).alias("root_ord"), F.concat("p_brand", F.lit("/main.c")).alias("rel_path"))
    long = p.select(F.lit(1).alias("root_ord"), F.concat("p_type", F.lit("/"), "p_brand", F.lit("/main.c")).alias("rel_path"))
    return symbols.source_paths(paths, short.unionByName(long).distinct())
