"""Registered queries of the jq surface: every function over whole tables, given to the evaluator or the column compiler."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.spread import spread
from .plans import jq
from .registry import query, table

_PLAIN = {"ignoreNullFields": "false"}


def _asked(name: str, source: str, key: str, code: str, sql: str, columns: str, digest: bool = False, where: str = "") -> None:
    """Register `code` over rows of `source` as objects of `columns`; `sql`: the output as JSON text."""
    shown = f"md5({sql})" if digest else sql
    sql = f"SELECT {key}, {shown} AS output FROM {source}{where}"

    @query(sql, name)
    def run(spark, d):
        t = table(spark, d, source).select(*columns.split())
        if source == "events" and jq.explain(code)["path"] == "evaluator":
            t = spread(t)
        t = t.select(key, F.to_json(F.struct(*columns.split()), _PLAIN).alias("j"))
        out = jq.query_table(t, code, key, "j").select(key, "output")
        return out.withColumn("output", F.md5(F.col("output").cast("binary"))) if digest else out


def _event(name: str, code: str, sql: str, digest: bool = False, where: str = "") -> None:
    _asked(name, "events", "event_id", code, sql, "event_id user_id event_type value props", digest, where)


def _page(name: str, code: str, sql: str, digest: bool = False, where: str = "") -> None:
    _asked(name, "pages", "page_id", code, sql, "page_id url", digest, where)


def _list(*parts: str) -> str:
    """A JSON array of SQL expressions that are JSON text."""
    return "'[' || " + " || ',' || ".join(parts) + " || ']'"


def _text(sql: str) -> str:
    return f"to_json({sql})::VARCHAR"


_K = "(props->>'$.k')::BIGINT"
_TYPE = _text("event_type")

_event("jq_length", '[(.event_type|length), (.user_id|length), (null|length), ([1,2]|length), (.event_type|utf8bytelength)]', _list("length(event_type)", "user_id", "0", "2", "strlen(event_type)"))
_asked("jq_utf8bytelength", "documents", "doc_id", "[(.text|length), (.text|utf8bytelength)]", _list("length(text)", "strlen(text)"), "doc_id text", where=" WHERE text IS NOT NULL")
_event("jq_keys_has_in", '[(keys|join("+")), has("value"), has("zz"), ("user_id"|in({"user_id": 1})), ([7,8]|has(1))]', "'[\"event_id+event_type+props+user_id+value\",true,false,true,true]'")
_event("jq_map", "[([.user_id, .event_id] | map(. + 1)), ({a: .user_id} | map_values(. * 2) | .a)]", _list(_list("user_id + 1", "event_id + 1"), "user_id * 2"))
_event("jq_entries", 'with_entries(select(.key|startswith("user")) | .value += 1) | [., (to_entries|from_entries == {user_id: .[0].value})?, (to_entries[0].key)]', _list("'{\"user_id\":' || (user_id + 1) || '}'", "'true,\"user_id\"'"))
_event("jq_try_error", '[(try error(.event_type) catch .), (if .user_id % 2 == 0 then error("x") else 1 end)?, empty]', f"'[' || {_TYPE} || CASE WHEN user_id % 2 = 0 THEN '' ELSE ',1' END || ']'")
_event("jq_select_empty", "empty, (select(.user_id > 10) | .user_id)", "user_id::VARCHAR", where=" WHERE user_id > 10")
_event("jq_paths_del_transpose", '[([paths|join("/")]|sort|join(",")), (del(.props,.value)|keys|length), ([[1,2],[.user_id]]|transpose)]', "'[\"event_id,event_type,props,user_id,value\",3,[[1,' || user_id || '],[2,null]]]'")
_event("jq_types", "[(.user_id|type),(.event_type|type),(null|type),([]|type),({}|type),(true|type),(.value|isnan),(.value|isfinite),(infinite|isinfinite)]", "'[\"number\",\"string\",\"null\",\"array\",\"object\",\"boolean\",false,true,true]'")
_event("jq_conversions", "[(.props|fromjson.k|tostring), (.user_id|tojson|tonumber), (.event_type|tojson)]", _list(_text(f"{_K}::VARCHAR"), "user_id", _text(_TYPE)))
_event("jq_contains_index", '[(.event_type|contains("r")), ("r"|inside("error")), ([.user_id,3]|contains([3])), ("a,b,a"|indices("a")), ([-1,2,.user_id]|index(2)), (.event_type|rindex("e") // -1)]', _list("contains(event_type, 'r')", "'true,true,[0,4],1'", "CASE WHEN contains(event_type, 'e') THEN length(event_type) - instr(reverse(event_type), 'e') ELSE -1 END"))
_event("jq_flatten_range", "[([[.user_id,[1]],2]|flatten), ([[.user_id,[1]],2]|flatten(1)), [range(.user_id % 4)], [range(1;4)]]", _list("'[' || user_id || ',1,2],[' || user_id || ',[1],2]'", "to_json(range(user_id % 4))::VARCHAR", "'[1,2,3]'"))
_event("jq_rounding", "[(.value|floor),(.value|ceil),(.value|round),(.user_id * .user_id|sqrt|floor)]", _list("floor(value)::BIGINT", "ceil(value)::BIGINT", "round(value)::BIGINT", "user_id"))
_event("jq_affixes", '[(.event_type|startswith("c")),(.event_type|endswith("k")),(.event_type|ltrimstr("cl")),(.event_type|rtrimstr("or"))]', _list("starts_with(event_type, 'c')", "ends_with(event_type, 'k')", _text("regexp_replace(event_type, '^cl', '')"), _text("regexp_replace(event_type, 'or$', '')")))
_event("jq_codepoints", "[(.event_type|explode|add), (.event_type|explode|implode)]", _list("list_sum(list_transform(string_split(event_type, ''), lambda c: unicode(c)))::BIGINT", _TYPE))
_event("jq_split_join", '.props|split(": ")|[length, (map(ltrimstr("{"))|join("|"))]', _list("2", _text(f"""'"k"|' || {_K} || '}}'""")))
_event("jq_ascii_case", '[(.event_type|ascii_upcase), ("ÀÉ" + (.event_type|ascii_upcase)|ascii_downcase)]', _list(_text("upper(event_type)"), _text("'ÀÉ' || event_type")))
_event("jq_dates", "(.event_id * 3600) | [todate, (todate|fromdate), (todateiso8601|fromdateiso8601)]", _list(_text("strftime(make_timestamp(event_id * 3600000000), '%Y-%m-%dT%H:%M:%SZ')"), "event_id * 3600", "event_id * 3600"))
_event("jq_generators", "[isempty(empty), first(.user_id, 1), ([.user_id,2,3]|last), nth(1; .user_id, .event_id), [limit(2; .user_id, 1, 2)]]", _list("'true'", "user_id", "3", "event_id", "'[' || user_id || ',1]'"))
_event("jq_aggregates", "[.user_id,3,.event_id]|[add,min,max,(unique|length),any,all,(group_by(. % 2)|length),(min_by(-.)),(map({n:.})|unique_by(.n)|length)]", _list(
    "user_id + 3 + event_id", "least(user_id, 3, event_id)", "greatest(user_id, 3, event_id)", "len(list_distinct([user_id, 3, event_id]))", "'true,true'",
    "len(list_distinct([user_id % 2, 1, event_id % 2]))", "greatest(user_id, 3, event_id)", "len(list_distinct([user_id, 3, event_id]))"))
_event("jq_reduce", "[(reduce range(.user_id % 7) as $i (0; . + $i * $i)), ([foreach range(3) as $i (.user_id; . + $i)]|last)]", _list("coalesce(list_sum(list_transform(range(user_id % 7), lambda i: i * i)), 0)::BIGINT", "user_id + 3"))
_event("jq_sort_slice", "[.user_id,5,.event_id]|[sort, (sort_by(-.)|.[0]), first, last, .[1:], (sort|reverse|.[0]), .[-1], nth(1)]", _list(
    "to_json(list_sort([user_id, 5, event_id]))::VARCHAR", "greatest(user_id, 5, event_id)", "user_id", "event_id", "'[5,' || event_id || ']'", "greatest(user_id, 5, event_id)", "event_id", "5"))
_event("jq_functions", "def twice(f): f | f; def plus($n): . + $n; [(.user_id | twice(. + 1)), (.user_id | plus(5)), (.event_type as $t | [$t, $t] | length)]", _list("user_id + 2", "user_id + 5", "2"))

_page("jq_regex_test", '[(.url|test("page=[0-9]+")), (.url|re_test("^https"))]', _list("regexp_matches(url, 'page=[0-9]+')", "regexp_matches(url, '^https')"))
_page("jq_regex_capture", '.url|capture("^(?P<scheme>[a-z]+)://(?P<host>[^/]+)")', "'{\"host\":' || " + _text("regexp_extract(url, '^([a-z]+)://([^/]+)', 2)") + " || ',\"scheme\":' || " + _text("regexp_extract(url, '^([a-z]+)://([^/]+)', 1)") + " || '}'")
_page("jq_regex_match", '[([.url|match("[0-9]+").length]), ([.url|match("[0-9]+").offset]|first // -1)]', _list("to_json(list_transform(regexp_extract_all(url, '[0-9]+'), lambda x: strlen(x)))::VARCHAR", "CASE WHEN regexp_matches(url, '[0-9]') THEN strlen(regexp_extract(url, '^[^0-9]*')) ELSE -1 END"))
_page("jq_regex_scan", '[([.url|scan("[a-z]+")]|length), ([.url|scan("([a-z])[0-9]")|.[0]]|join(""))]', _list("len(regexp_extract_all(url, '[a-z]+'))", _text("array_to_string(regexp_extract_all(url, '([a-z])[0-9]', 1), '')")))
_page("jq_regex_splits", '[.url|splits("[/:?&=]+")]|join("|")', _text("array_to_string(string_split_regex(url, '[/:?&=]+'), '|')"))
_page("jq_regex_sub", '[(.url|sub("[aeiou]+"; "*")),(.url|gsub("(?P<v>[aeiou])"; "<$v>"))]', _list(_text("regexp_replace(url, '[aeiou]+', '*')"), _text(r"regexp_replace(url, '([aeiou])', '<\1>', 'g')")))

# normalisers to canonical records

_STATUS = "(CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 ELSE 200 END)"
_event(
    "jq_nginx_to_log",
    '"10.0.0.\\(.user_id) - u\\(.user_id) [01/Feb/2024:10:20:30 +0000] \\"GET /\\(.event_type) HTTP/1.1\\" \\({"error":503,"click":404}[.event_type] // 200) \\(.user_id) \\"-\\" \\"agent\\"" | nginx_to_log | [.timestamp,.level,.message,.data.remote_addr,.data.body_bytes,.source]',
    _list("'\"2024-02-01T10:20:30Z\"'", f"CASE WHEN {_STATUS} = 503 THEN '\"ERROR\"' WHEN {_STATUS} = 404 THEN '\"WARN\"' ELSE '\"INFO\"' END", _text(f"'GET /' || event_type || ' ' || {_STATUS}"), _text("'10.0.0.' || user_id"), "user_id", "'\"nginx\"'"),
)
_event("jq_identity_normalizers", "[(journald_to_log|.user_id), (github_to_task|.event_type), (task_format|.event_id)]", _list("user_id", _TYPE, "event_id"))
_event("jq_todo_to_task", '"x // TODO: \\(.event_type) priority:high" | todo_to_task | [.title,.priority,.status,.tags[0]]', _list(_TYPE, "'\"high\",\"open\",\"todo\"'"))
_event("jq_src_to_task", '"a\\n// FIXME: \\(.event_type)\\n# TODO: more */" | [src_to_task|[.title,.priority,.tags[1],.id]]', _list(_list(_TYPE, "'\"high\",\"fixme\"'", _text("'task_' || list_sum(list_transform(string_split(event_type, ''), lambda c: unicode(c)))::BIGINT")), f"'[\"more\",\"medium\",\"todo\",\"task_{sum(map(ord, 'more */'))}\"]'"))
_event(
    "jq_cargo_to_artifact",
    '{reason:"compiler-message", message:{level:(if .user_id % 2 == 0 then "error" else "warning" end), message:.event_type, rendered:"r", code:{code:"E1"}, spans:[{file_name:"f.rs",line_start:.user_id}]}} | cargo_to_artifact | [.type,.status,.summary,.location.line,.check_name]',
    _list("CASE WHEN user_id % 2 = 0 THEN '\"BUILD_ERROR\",\"FAILURE\"' ELSE '\"COMPILATION_WARNING\",\"WARNING\"' END", _TYPE, "user_id", "'\"E1\"'"),
)
_event("jq_git_status_to_diff", '{file:.event_type, status:(["M","A","D","R","X"][.user_id % 5])} | git_status_to_diff | [.file, .change_type]', _list(_TYPE, _text("list_extract(['MODIFIED', 'ADDED', 'DELETED', 'RENAMED', 'UNKNOWN'], user_id % 5 + 1)")))
_event(
    "jq_auto_normalize",
    '[{reason:"compiler-message",message:{level:"error",message:.event_type}}, {number:1,title:"t",state:"open"}, {"x-source":"openwebui",id:"i",chat:{messages:[]}}, .user_id] | auto_normalize | [.[0].type, .[0].summary, .[1].title, .[2].meta.original_id, .[3]]',
    _list("'\"BUILD_ERROR\"'", _TYPE, "'\"t\",\"i\"'", "user_id"),
)

# graphs and their renderings

_SOURCE = '{metadata:{path:("src/" + .event_type + ".rs")},functions:[{name:("f\\(.user_id)"),line_start:1,line_end:2}],structs:[{name:"S"}],imports:[{name:"std"}]}'
_PATH = "'src/' || event_type || '.rs'"
_event("jq_src_to_graph", _SOURCE + ' | src_to_graph | .graphs[0] | [(.nodes|keys|sort|join(",")), (.edges|map(.source + ">" + .target + ":" + .relation)|sort|join(","))]', _list(
    _text(f"{_PATH} || ',' || {_PATH} || '::S,' || {_PATH} || '::f' || user_id"), _text(f"{_PATH} || '::S>' || {_PATH} || ':child-of,' || {_PATH} || '::f' || user_id || '>' || {_PATH} || ':child-of,' || {_PATH} || '>std:imports'")))
_event("jq_src_to_architecture", _SOURCE + ' | src_to_architecture | .graphs[0] | [(.nodes|keys|sort|join(",")), (.edges|map(.source)|join(","))]', _list(_text(f"{_PATH} || ',' || {_PATH} || '::S'"), _text(f"{_PATH} || '::S'")))
_event("jq_graph_format", _SOURCE + " | src_to_graph | graph_format", _text(
    f"'# Graph: ' || {_PATH} || chr(10) || chr(10) || '## Nodes' || chr(10) || '- **' || {_PATH} || '** (file)' || chr(10) || '- **' || {_PATH} || '::S** (structure)' || chr(10) || '- **' || {_PATH} || '::f' || user_id || '** (function)' || chr(10) || chr(10) || '## Relationships' || chr(10) || '- '"
    f" || {_PATH} || '::f' || user_id || ' --[child-of]--> ' || {_PATH} || chr(10) || '- ' || {_PATH} || '::S --[child-of]--> ' || {_PATH} || chr(10) || '- ' || {_PATH} || ' --[imports]--> std' || chr(10)"), digest=True)  # fmt: skip
_SAFE = "'src_' || event_type || '_rs'"
_event("jq_graph_format_mermaid", _SOURCE + " | src_to_graph | graph_format_mermaid", _text(
    f"'graph TD' || chr(10) || '  ' || {_SAFE} || '[\"' || {_PATH} || '\"]' || chr(10) || '  ' || {_SAFE} || '__S[\"S\"]' || chr(10) || '  ' || {_SAFE} || '__f' || user_id || '[\"f' || user_id || '\"]' || chr(10) || '  ' || {_SAFE} || '__f' || user_id || ' -- child-of --> ' || {_SAFE} || chr(10)"
    f" || '  ' || {_SAFE} || '__S -- child-of --> ' || {_SAFE} || chr(10) || '  ' || {_SAFE} || ' -- imports --> std' || chr(10)"), digest=True)  # fmt: skip
_event("jq_architecture_formats", _SOURCE + " | src_to_architecture | architecture_format, architecture_format_mermaid | length", f"unnest([length('# Architecture: System' || chr(10) || chr(10) || '- ' || {_PATH} || chr(10) || '- S'), length('graph TD' || chr(10) || '  subgraph src [src]' || chr(10) || '    ' || {_SAFE} || '[\"' || {_PATH} || '\"]:::file' || chr(10) || '    ' || {_SAFE} || '__S[\"S\"]:::object' || chr(10) || '  end' || chr(10) || '  ' || {_SAFE} || '__S -.-> ' || {_SAFE})])::VARCHAR")
_event("jq_log_format", '{timestamp:"t",level:.event_type,message:"m",source:"s"} | log_format', _text("'[t] **' || event_type || '** (s): m'"))
_event("jq_artifact_format", '{type:"T",status:"FAILURE",summary:.event_type,location:{file:"f",line:.user_id},details:"d"} | artifact_format', _text("'❌ **T**: ' || event_type || chr(10) || '  Location: f:' || user_id || chr(10) || '  Details: d'"), digest=True)
_event("jq_diff_format", '{file:.event_type,change_type:"MODIFIED",hunks:[{content:"+ a"}]} | diff_format', _text("'### ' || event_type || ' (MODIFIED)' || chr(10) || '```diff' || chr(10) || '+ a' || chr(10) || '```'"))
_event("jq_markdown", '{metadata:{path:"p"},functions:[{name:.event_type,attributes:{signature:"fn x()",docstring:"doc"}}],imports:[{name:"std"}]} | markdown | split("\\n") | map(select(startswith("#"))) | join("/")', _text("'# p/## Imports/### std/## Functions/### ' || event_type"))

# conversations

_DECODED = "text"
for _a, _b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#x60;", "`")):
    _DECODED = f"replace({_DECODED}, '{_a}', '{_b}')"


def _chat(name: str, code: str, sql: str, digest: bool = False) -> None:
    shown = f"md5({sql})" if digest else sql

    @query(f"SELECT conv_id, {shown} AS output FROM conversations GROUP BY conv_id", name)
    def run(spark, d):
        m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
        t = table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("m")).select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), "m"), _PLAIN).alias("j"))
        out = jq.query_table(t, code, "conv_id", "j").select("conv_id", "output")
        return out.withColumn("output", F.md5(F.col("output").cast("binary"))) if digest else out


_chat("jq_chat_filter_role", '.m | chat_filter_role("user") | map(.content|length)', "coalesce(to_json(list(length(text) ORDER BY turn) FILTER (WHERE role = 'user'))::VARCHAR, '[]')")
_chat("jq_chat_search", '.m | chat_search("the ") | length', "count(*) FILTER (WHERE contains(text, 'the '))::VARCHAR")
_chat("jq_chat_tail_head", "[(.m | chat_tail(2) | map(.content|length)), (.m | chat_head(1) | .[0].role)]", _list("to_json(list_reverse(list_slice(list(length(text) ORDER BY turn DESC), 1, 2)))::VARCHAR", _text("arg_min(role, turn)")))
_chat("jq_chat_format", ".m | chat_format", _text("string_agg('### ' || role || chr(10) || text || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY turn)"), digest=True)
_chat("jq_openwebui_to_chat", '{id, title:"t", chat:{messages:.m}} | openwebui_conversation_to_chat | [.meta.original_id, (.messages|length), .messages[0].role, (.messages|map(.content|length)|add)]', _list("conv_id::VARCHAR", "count(*)", _text("arg_min(role, turn)"), f"sum(length({_DECODED}))::BIGINT"))
