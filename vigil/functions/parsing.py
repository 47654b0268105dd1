"""Parsers of raw records to the canonical event, its checks, and the routing of what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.state import settle
from . import registry
from . import text as text_ops

SVN = r'^(\S+) - (\S+) \[([^\]]+)\] "(\S+) (\S+) ([^"]+)" (\d+) (\d+)(?: "([^"]+)")?(?: (\S+) (\S+) r(\d+)(?: (\S+))?)?'
EVENT = (
    "struct<event:struct<id:string,time:string,category:string,type:string,action:string,outcome:string>,user:struct<id:string,name:string>,source:struct<ip:string>,destination:struct<ip:string>,"
    "host:struct<name:string>,device:struct<name:string,type:string,os_name:string,os_version:string>,resource:struct<type:string,id:string,name:string>,http:struct<method:string,status_code:bigint,bytes:bigint,path:string,user_agent:string>,network:struct<bytes:bigint>,"
    "parser:struct<id:string,version:string,status:string,confidence:double,origin:string,conflict:struct<candidate_count:int,selected_parser_id:string,competing_parser_ids:array<string>,resolution:string>>,"
    "raw:struct<record_id:string,source_id:string,source_type:string,checksum:string,storage_ref:string,size_bytes:bigint>,extensions:map<string,string>>"
)
# fixed values: the schema's required paths and the values of its enumerations
REQUIRED = ("event.id", "event.time", "event.category", "event.type", "event.action", "event.outcome", "parser.id", "parser.version", "parser.status", "parser.confidence", "raw.record_id", "raw.source_id", "raw.source_type", "raw.checksum", "raw.storage_ref")
ENUMS = {
    "event.category": ("application", "authentication", "endpoint", "network", "repository", "unknown"),
    "event.type": ("access", "activity", "api", "behavior", "login", "redirect", "unknown"),
    "event.outcome": ("failure", "success", "unknown"),
    "parser.status": ("success", "failed"),
}
READS, WRITES = ("get-file", "get-dir", "report", "propfind"), ("proppatch", "put", "post", "delete")


def http_outcome(status: Column) -> Column:
    return F.when((status >= 200) & (status < 400), "success").otherwise("failure")


def repository_action(verb: Column) -> Column:
    v = F.lower(verb)
    return F.when(v.isin(*READS), "repo_read").when(v.isin(*WRITES), "repo_write").otherwise(F.concat(F.lit("repo_"), v))


def _fields(**named: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in named.items()])


def _event(parser: str, confidence: float, **parts: Column) -> Column:
    """The parts that parsers fill; missing ones are null."""
    none = F.lit(None).cast("string")
    names = ("time", "category", "type", "action", "outcome", "user_id", "user_name", "source_ip", "destination_ip", "host", "resource_type", "resource_name", "method", "status_code", "bytes", "path", "user_agent", "device_name", "device_type", "os_name", "os_version")
    number = ("status_code", "bytes")
    more = parts.get("extensions", F.lit(None)).cast("map<string,string>")
    return _fields(**{n: parts.get(n, none).cast("bigint" if n in number else "string") for n in names}, parser_id=F.lit(parser), confidence=F.lit(confidence), extensions=more)


#: Groups 1, 2, 4, 5, 7, 8, 10 and 11 have no white space, group 9 no quote: so parted, all are told from one match.
SVN_GROUPS, SVN_PARTED = (1, 2, 4, 5, 7, 8, 10, 11), '$1 $2 $4 $5 $7 $8 $10 $11 $9"$3'


def parse_svn(text: Column) -> Column:
    """Access log lines; null where the line is none or its time cannot be read."""
    parted = F.split(F.regexp_replace(text, SVN + r"[\s\S]*", SVN_PARTED), " ", len(SVN_GROUPS) + 1)
    rest = lambda x: F.split(F.get(x, F.lit(len(SVN_GROUPS))), '"', 2)
    made = text_ops.let(parted, lambda x: text_ops.let(rest(x), lambda y: _svn(x, y)))
    return F.when(F.regexp_like(text, F.lit(SVN)), made)


def _svn(parted: Column, rest: Column) -> Column:
    """The event of a line's groups."""

    def g(i: int) -> Column:
        held = F.get(parted, F.lit(SVN_GROUPS.index(i))) if i in SVN_GROUPS else F.get(rest, F.lit((9, 3).index(i)))
        return F.nullif(held, F.lit(""))

    time = F.try_to_timestamp(g(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    zone = F.regexp_replace(F.regexp_extract(g(3), r"([+-]\d{4})$", 1), r"(\d{2})(\d{2})$", "$1:$2")
    local = F.regexp_extract(g(3), r"^(\S+)", 1)
    iso = F.concat(F.date_format(F.try_to_timestamp(local, F.lit("dd/MMM/yyyy:HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss"), zone)
    made = _event("svn_apache_access", 0.95, time=iso, category=F.lit("repository"), type=F.lit("access"), action=repository_action(F.coalesce(g(10), g(4))), outcome=http_outcome(g(7).try_cast("bigint")), user_name=g(2), source_ip=g(1),
                  resource_type=F.lit("repository_path"), resource_name=F.coalesce(g(11), g(5)), method=g(4), status_code=g(7).try_cast("bigint"), bytes=g(8).try_cast("bigint"), path=g(5), user_agent=g(9))
    return F.when(time.isNotNull(), made)


def _plain_time(text: Column) -> Column:
    return F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss")


def parse_sso(text: Column) -> Column:
    """Single sign-on records; null where the text is no JSON object or its time cannot be read."""
    return text_ops.let(F.try_parse_json(text), _sso)


def _sso(v: Column) -> Column:
    """The event of a record's document (a variant)."""
    f = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    login = F.coalesce(f("eventType") == "authenticateSuccess", F.lit(False))
    time = F.nullif(f("ctime"), F.lit(""))
    made = _event("sso_json", 0.98, time=_plain_time(time), category=F.lit("authentication"), type=F.when(login, "login").otherwise("redirect"), action=F.when(login, "user_login").otherwise("sso_redirect"),
                  outcome=F.when(f("status") == "0", "success").otherwise("failure"), user_name=f("shortName"), source_ip=f("userIp"), destination_ip=f("casServer"), resource_type=F.lit("application_url"), resource_name=f("appUrl"))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & (time.isNull() | _plain_time(time).isNotNull()), made)


def parse_gitlab(text: Column) -> Column:
    return text_ops.let(F.try_parse_json(text), _gitlab)


def _gitlab(v: Column) -> Column:
    """The event of a record's document (a variant)."""
    f = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    method, path = F.upper(F.coalesce(f("method"), F.lit(""))), F.coalesce(f("path"), F.lit(""))
    status = F.coalesce(f("status"), F.lit("0")).try_cast("bigint")
    action = F.when((method == "GET") & F.contains(path, F.lit("/projects")), "repo_api_read").when(method.isin("POST", "PUT", "PATCH", "DELETE"), "repo_api_write").otherwise("repo_api_access")
    made = _event("gitlab_jsonl", 0.98, time=f("time"), category=F.lit("repository"), type=F.lit("api"), action=action, outcome=http_outcome(status), user_id=f("user_id"), user_name=f("username"), source_ip=F.trim(F.split(F.coalesce(f("remote_ip"), F.lit("")), ",")[0]),
                  host=f("host"), resource_type=F.lit("gitlab_route"), resource_name=f("path"), method=f("method"), status_code=status, path=f("path"), user_agent=f("ua"))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & status.isNotNull(), made)


def loose_object(text: Column) -> Column:
    """A map of `key: value` lines; of repeated keys the last counts, null values are left out."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.regexp_replace(text_ops.strip(x), ",+$", ""))
    lines = F.filter(lines, lambda x: F.contains(x, F.lit(":")) & ~F.endswith(x, F.lit(":{")))
    value = lambda x: F.regexp_replace(text_ops.strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))), r'^"(.*)"$', "$1")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_replace(text_ops.strip(F.substring_index(x, ":", 1)), r'^"+|"+$', "").alias("k"), value(x).alias("v")))
    return F.filter(pairs, lambda p: p["v"] != "null")


def parse_hiklink(text: Column) -> Column:
    return text_ops.let(F.map_from_entries(text_ops.last_of(loose_object(text))), _hiklink)


def _hiklink(fields: Column) -> Column:
    """The event of a record's fields (a map)."""
    f = lambda n: F.try_element_at(fields, F.lit(n))
    login = F.coalesce(f("path") == "loginByPasswd", F.lit(False))
    time = F.nullif(f("createTime"), F.lit(""))
    made = _event("hiklink_json_like", 0.86, time=_plain_time(time), category=F.when(login, "authentication").otherwise("application"), type=F.when(login, "login").otherwise("behavior"), action=F.when(login, "user_login").otherwise(f("path")),
                  outcome=F.when(f("attribute3") == "SUCCESS", "success").otherwise("failure"), user_name=f("uid"), source_ip=f("attribute2"),
                  device_name=f("device"), device_type=f("action"), os_name=f("platformName"), os_version=f("platformVersion"), extensions=fields)
    return F.when(time.isNull() | _plain_time(time).isNotNull(), made)


PARSERS = {"svn": parse_svn, "sso": parse_sso, "gitlab": parse_gitlab, "hiklink": parse_hiklink}


def registry_event() -> Column:
    """The event of a record that an active parser takes (column parser of registry.select_parser)."""
    v = lambda path: F.try_element_at("parser.values", F.lit(path))
    names = {
        "time": "event.time", "category": "event.category", "type": "event.type", "action": "event.action", "outcome": "event.outcome", "user_id": "user.id", "user_name": "user.name", "source_ip": "source.ip",
        "destination_ip": "destination.ip", "host": "host.name", "resource_type": "resource.type", "resource_name": "resource.name", "method": "http.request.method", "path": "http.url.path",
        "device_name": "device.name", "device_type": "device.type",
    }
    rest = F.map_filter("parser.values", lambda k, _: ~k.isin(*registry.PLACES))
    more = F.map_concat(F.transform_keys("parser.fields", lambda k, _: F.concat(F.lit("active_parser."), k)), F.transform_keys(rest, lambda k, _: F.regexp_replace(k, r"^extensions\.", "")))
    made = _event("", 0.0, **{k: v(path) for k, path in names.items()}, status_code=v("http.response.status_code").try_cast("bigint"), extensions=more)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    bytes_ = v("network.bytes").try_cast("bigint")
    return F.struct(made.withField("time", F.coalesce(made["time"], now)).alias("p"), bytes_.alias("network_bytes"), v("resource.id").alias("resource_id"))


def parse(records: DataFrame, parsers: list[dict] | None = None) -> DataFrame:
    """records (record_id, source_id, source_type, raw_text, checksum, storage_ref, size_bytes) with event and reason.

    source_type auto is told from the text. Records that no built-in parser takes go to the active ones among parsers
    (documents of the registry). reason is null for parsed records, else no_parser or parse_error.
    """
    kind = F.when(F.col("source_type") == "auto", text_ops.detect_source(F.col("raw_text"))).otherwise(F.col("source_type"))
    rows = records.withColumn("_kind", kind)
    parsed = F.coalesce(*[F.when(F.col("_kind") == k, p(F.col("raw_text"))) for k, p in PARSERS.items()])
    rows = rows.withColumn("_p", parsed)
    shape = "struct<id:string,version:string,confidence:double,conflict:struct<candidate_count:int,selected_parser_id:string,competing_parser_ids:array<string>,resolution:string>>"
    active = [p for p in parsers or [] if p.get("status") == "active"]
    if active:
        columns = rows.columns
        rows = registry.select_parser(rows, active, F.col("_p").isNull())
        own = {p["parser_id"]: p["source_type"] for p in active if p.get("source_type")}
        known = F.create_map(*[F.lit(x) for pair in own.items() for x in pair]).cast("map<string,string>") if own else F.create_map().cast("map<string,string>")
        taken = F.col("_p").isNull() & F.col("parser").isNotNull()
        rows = rows.withColumn("_r", F.when(taken, registry_event())).withColumns({
            "_by": F.when(taken, F.struct("parser.id", "parser.version", "parser.confidence", "parser.conflict")).cast(shape), "_p": F.coalesce("_p", "_r.p"),
            "_kind": F.when(taken, F.coalesce(F.try_element_at(known, F.col("parser.id")), F.col("_kind"))).otherwise(F.col("_kind")),
        }).select(*columns, "_by", F.col("_r.network_bytes").alias("_bytes"), F.col("_r.resource_id").alias("_resource"))
    else:
        rows = rows.withColumns({"_by": F.lit(None).cast(shape), "_bytes": F.lit(None).cast("bigint"), "_resource": F.lit(None).cast("string")})
    p = lambda n: F.col(f"_p.{n}")
    by = F.col("_by")
    event = F.struct(
        _fields(id=F.col("record_id"), time=p("time"), category=p("category"), type=p("type"), action=p("action"), outcome=p("outcome")).alias("event"), _fields(id=p("user_id"), name=p("user_name")).alias("user"),
        _fields(ip=p("source_ip")).alias("source"), _fields(ip=p("destination_ip")).alias("destination"), _fields(name=p("host")).alias("host"),
        _fields(name=p("device_name"), type=p("device_type"), os_name=p("os_name"), os_version=p("os_version")).alias("device"), _fields(type=p("resource_type"), id=F.col("_resource"), name=p("resource_name")).alias("resource"),
        _fields(method=p("method"), status_code=p("status_code"), bytes=p("bytes"), path=p("path"), user_agent=p("user_agent")).alias("http"), _fields(bytes=F.col("_bytes")).alias("network"),
        _fields(id=F.coalesce(by["id"], p("parser_id")), version=F.coalesce(by["version"], F.lit("0.1.0")), status=F.lit("success"), confidence=F.coalesce(by["confidence"], p("confidence")), origin=F.when(by.isNotNull(), "registry_active"), conflict=by["conflict"]).alias("parser"),
        _fields(record_id=F.col("record_id"), source_id=F.col("source_id"), source_type=F.col("_kind"), checksum=F.col("checksum"), storage_ref=F.col("storage_ref"), size_bytes=F.col("size_bytes").cast("bigint")).alias("raw"),
        p("extensions").alias("extensions"),
    )
    reason = F.when(F.col("_p").isNotNull(), None).when(F.col("_kind").isin(*PARSERS), F.concat(F.lit("parse_error:"), F.col("_kind"))).otherwise("no_parser")
    return rows.withColumns({"event": F.when(F.col("_p").isNotNull(), event), "reason": reason}).drop("_p", "_kind", "_by", "_bytes", "_resource")


BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"({BYTE}\.){{3}}{BYTE}"


def _ipv6() -> str:
    """A pattern of IPv6 addresses: eight groups, or fewer with one gap, the last two of which may be an IPv4 address,
    and a zone."""
    group = "[0-9A-Fa-f]{1,4}"
    forms = [f"({group}:){{7}}{group}", f"({group}:){{6}}{IPV4}"]
    for left in range(8):
        head = f"{group}(:{group}){{{left - 1}}}" if left else ""
        right = 7 - left
        tails = ([f"({group}:){{0,{right - 1}}}{group}"] if right else []) + ([f"({group}:){{0,{right - 2}}}{IPV4}"] if right > 1 else [])
        forms.append(f"{head}::({'|'.join(tails)})?" if tails else f"{head}::")
    return f"({'|'.join(forms)})(%[^%/]+)?"


ADDRESS = f"^({IPV4}|{_ipv6()})$"


def validation_errors(event: str = "event") -> Column:
    """What is wrong with a canonical event (a struct column of EVENT), in a fixed order; empty for valid ones."""
    c = lambda path: F.col(f"{event}.{path}")
    checks = [F.when(F.coalesce(c(p).cast("string"), F.lit("")) == "", f"{p} is required") for p in REQUIRED]
    checks.append(F.when(~c("parser.confidence").between(0, 1), "parser.confidence must be between 0 and 1"))
    some = lambda p: F.nullif(c(p), F.lit(""))
    checks += [F.when(~some(p).isin(*allowed), f"{p} must be one of: {', '.join(allowed)}") for p, allowed in ENUMS.items()]
    from ..operators.features import parse_time_ms

    checks.append(F.when(some("event.time").isNotNull() & parse_time_ms(some("event.time")).isNull(), "event.time must be ISO-8601"))
    for p in ("source.ip", "destination.ip"):
        checks.append(F.when(~F.regexp_like(some(p), F.lit(ADDRESS)), f"{p} must be a valid IP address"))
    checks.append(F.when(~F.regexp_like(some("raw.checksum"), F.lit("^sha256:[0-9a-fA-F]{64}$")), "raw.checksum must match sha256:<64 hex chars>"))
    checks.append(F.when(~F.regexp_like(some("raw.storage_ref"), F.lit("^(file|kafka)://")), "raw.storage_ref must start with file:// or kafka://"))
    checks += [F.when(c(p) < 0, f"{p} must be a non-negative integer") for p in ("raw.size_bytes", "network.bytes")]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def routed(records: DataFrame, parsers: list[dict] | None = None, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Valid events, and the rest as unknown records with reason, errors, format and template; keep are columns of the
    records that both have too."""
    rows = parse(records, parsers)
    rows = rows.withColumn("schema_errors", F.when(F.col("event").isNotNull(), validation_errors()).otherwise(F.array().cast("array<string>")))
    if not rows.isStreaming:
        rows = settle(rows)  # both results read the records as parsed, and parse them once
    bad = F.size("schema_errors") > 0
    good = rows.where(F.col("event").isNotNull() & ~bad).select("event.*", *keep)
    reason = F.when(bad, "schema_validation_failed").otherwise(F.col("reason"))
    rest = rows.where(F.col("event").isNull() | bad).withColumn("reason", reason)
    unknown = rest.select(F.sha2(F.concat_ws(":", "record_id", "reason"), 256).alias("unknown_id"), "reason", "record_id", "source_id", "source_type", text_ops.detect_source(F.col("raw_text")).alias("suggested_source_type"), text_ops.detect_format(F.col("raw_text")).alias("detected_format"), text_ops.template_hint(F.col("raw_text")).alias("template_hint"), "schema_errors", "raw_text", *keep)
    return good, unknown
