"""One query for each operator over the test tables, and the SQL that each is held against."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import drift, httpstruct, hygiene, noise, records
from tokenloom.functions.text import float_repr, lower_ascii
from tokenloom.operators import baselines, induce, matcher, metrics, mining, validate
from tokenloom.plans import runs
from tokenloom.plans.artifact import Artifact, HygieneArtifact, Runtime, issues_of
from tokenloom.plans.config import Contract, Trainer
from tokenloom.sources import scan, shared, sink
from tokenloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(name: str, key: str, made: str, made_sql: str, rule: Callable[[Column], Column], want: str) -> Query:
    """Query of a rule over a made-up text column: made is Spark SQL, made_sql is DuckDB's, want is SQL over x."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, name).select(key, F.expr(made).alias("x")).select(key, rule(F.col("x")).alias("out"))

    run.sql = f"WITH s AS (SELECT {key}, {made_sql} AS x FROM {name}) SELECT {key}, {want} AS out FROM s"
    return run


def _beside(name: str, key: str, made: str, made_sql: str, column: str, rule: Callable[[Column], Column], want: Callable[[str], str]) -> Query:
    """Query of a rule over a made-up text, a bar, and a whole column: want is SQL of the rule over an expression."""
    return _over(name, key, f"concat({made}, ' | ', {column})", f"{made_sql} || ' | ' || {column}", rule, want("x"))


def _named(name: str, run: Query) -> None:
    run.__name__ = name
    query(run.sql)(run)


# --- scans and limits ---


@query("SELECT translate(text, chr(13) || chr(10), '  ') AS text FROM documents WHERE text <> ''")
def scan_text_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as lines and scanned again."""
    path = shared.fresh_path(spark, "lines")
    sink.write_texts(table(spark, sf_dir, "documents"), path)
    return scan.scan(spark, path, "txt").select("text")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def limit_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.first_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), 100, "doc_id")


@query("SELECT text FROM documents WHERE text IS NOT NULL")
def scan_parquet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(spark, f"{sf_dir}/documents.parquet", "parquet").select("text")


@query("SELECT text FROM documents WHERE text IS NOT NULL UNION ALL SELECT '{\"item_id\": ' || item_id::VARCHAR || '}' FROM benchmark")
def scan_jsonl_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as JSON lines, and lines without the field, which are printed anew."""
    path = shared.fresh_path(spark, "json")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.json(path)
    table(spark, sf_dir, "benchmark").select("item_id").write.mode("append").json(path)
    return scan.scan(spark, path, "jsonl").select("text")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') WHEN event_id % 3 = 1 THEN 'None' ELSE '{\"q\": ' || (event_id % 10)::VARCHAR || '}' END AS text FROM events")
def scan_jsonl_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(
        "CASE event_id % 3 WHEN 0 THEN concat('{\"text\":', get_json_object(props, '$.k'), '}') WHEN 1 THEN '{\"text\":null}' ELSE concat('{\"q\":', event_id % 10, '}') END"
    )
    return table(spark, sf_dir, "events").select("event_id", line.alias("line")).select("event_id", scan.json_field(F.col("line"), "text").alias("text"))


# --- typed replacement ---

_UUID = "concat('id ', substr(h,1,8), '-', substr(h,9,4), '-4', substr(h,14,3), '-', IF(doc_id % 4 = 0, 'c', 'a'), substr(h,18,3), '-', substr(h,21,12), ' end')"


@query(
    "WITH s AS (SELECT doc_id, md5(doc_id::VARCHAR) AS h FROM documents), t AS (SELECT doc_id, 'id ' || substr(h,1,8) || '-' || substr(h,9,4) || '-4' || substr(h,14,3) || '-' || "
    "CASE WHEN doc_id % 4 = 0 THEN 'c' ELSE 'a' END || substr(h,18,3) || '-' || substr(h,21,12) || ' end' AS x FROM s) "
    r"SELECT doc_id, regexp_replace(x, '\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b', '<UUID>', 'g') AS out FROM t"
)
def hyg_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return s.select("doc_id", hygiene.replaced(F.expr(_UUID), (hygiene.UUID, "<UUID>")).alias("out"))


_named(
    "hyg_ipv4",
    _over("documents", "doc_id", "text", "text", lambda x: hygiene.replaced(x, (hygiene.IPV4, "<IPV4>")),
          r"regexp_replace(x, '\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b', '<IPV4>', 'g')"),
)
_named(
    "hyg_ipv6",
    _over("events", "event_id", "concat('at ', lower(hex(event_id)), ':db8:', user_id % 100, ':1 up ', event_id % 24, ':', 10 + event_id % 50, ':30.')",
          "'at ' || printf('%x', event_id) || ':db8:' || (user_id % 100)::VARCHAR || ':1 up ' || (event_id % 24)::VARCHAR || ':' || (10 + event_id % 50)::VARCHAR || ':30.'",
          lambda x: hygiene.replaced(x, (hygiene.IPV6, "<IPV6>")), r"regexp_replace(x, '\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b', '<IPV6>', 'g')"),
)
_named(
    "hyg_iso_ts",
    _over("events", "event_id", "concat('t=', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), IF(event_id % 2 = 0, 'Z', '+0100'), ' d=', date_format(ts, 'yyyy-MM-dd'))",
          "'t=' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '+0100' END || ' d=' || strftime(ts, '%Y-%m-%d')",
          lambda x: hygiene.replaced(x, (hygiene.ISO_TIME, "<TS>")),
          r"regexp_replace(x, '\b\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?\b', '<TS>', 'g')"),
)
_named(
    "hyg_epoch",
    _over("orders", "o_orderkey", "concat('at ', 1500000000 + o_orderkey, ' x', 1600000000 + o_custkey, ' ', 99999 + o_orderkey)",
          "'at ' || (1500000000 + o_orderkey)::VARCHAR || ' x' || (1600000000 + o_custkey)::VARCHAR || ' ' || (99999 + o_orderkey)::VARCHAR",
          lambda x: hygiene.replaced(x, (hygiene.EPOCH, "<TS>")), r"regexp_replace(x, '\b\d{10,13}\b', '<TS>', 'g')"),
)


def _runs(inside: str, outside: str, test: str, symbol: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(x, '{inside}|{outside}'), lambda r: CASE WHEN regexp_full_match(r, '{test}') THEN '{symbol}' ELSE r END), '')"


_HEX_RUNS = ("[0-9a-fA-F]+", "[^0-9a-fA-F]+")
_named("hyg_hash", _over("documents", "doc_id", "text", "text", lambda x: hygiene.replaced(x, (hygiene.HASH, "<HASH>")), _runs(*_HEX_RUNS, "[0-9a-fA-F]{32,64}", "<HASH>")))
_named("hyg_hex", _over("documents", "doc_id", "text", "text", lambda x: hygiene.replaced(x, (hygiene.HEX, "<HEX>")), _runs(*_HEX_RUNS, "[0-9a-fA-F]{16,}", "<HEX>")))
#: Runs of the alphabet with what pads them; one that a letter follows is no whole run.
_B64_SQL = (
    "array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z0-9+/]+=*|[^A-Za-z0-9+/]+'), lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z0-9+/]{{24,}}=*$') "
    "AND regexp_matches(r, '^[A-Z+/]*[a-z0-9]|^[+/]+=*$') THEN regexp_replace(r, '^[A-Za-z0-9+/]+={{0,2}}', '<B64>') ELSE r END), '')"
)
_named(
    "hyg_b64",
    _beside("documents", "doc_id", "concat('k=', base64(cast(concat('document number ', doc_id) AS binary)), '; ', repeat('AB', doc_id % 20))",
            "'k=' || to_base64(('document number ' || doc_id::VARCHAR)::BLOB) || '; ' || repeat('AB', (doc_id % 20)::INTEGER)", "text",
            lambda x: hygiene.replaced(x, (hygiene.BASE64, "<B64>")), lambda x: _B64_SQL.format(x=x)),
)
_PORT_SQL = (
    "array_to_string(list_transform(regexp_extract_all({x}, '[0-9]+(?::[0-9]+)*|:[0-9]+(?::[0-9]+)*|[^0-9:]+|:'), "
    "lambda r: CASE WHEN regexp_full_match(r, ':[0-9]{{1,5}}(?::[0-9]+)*') THEN regexp_replace(r, '^:[0-9]+', ':<PORT>') ELSE r END), '')"
)
_named(
    "hyg_port_generic",
    _over("pages", "page_id", "html", "html", lambda x: hygiene.replaced(x, (hygiene.PORT, ":<PORT>")),
          _PORT_SQL.format(x="x")),
)
_named(
    "hyg_version",
    _over("documents", "doc_id", "text", "text", lambda x: hygiene.replaced(x, (hygiene.VERSION, "<VER>")), r"regexp_replace(x, '(?:[0-9]+\.){1,3}[0-9]+', '<VER>', 'g')"),
)
_AUTHORITY_SQL = r"regexp_replace({x}, '([A-Za-z0-9.-]+:)[0-9]{{1,5}}([/\s])', '\1<PORT>\2', 'g')"
_HOST_SQL = r"regexp_replace({x}, '(?im)^(Host:\s*[^:\s]+:)[0-9]{{1,5}}\s*$', '\1<PORT>', 'g')"
_named(
    "hyg_authority_port",
    _beside("pages", "page_id", "concat(url, ':', 8000 + page_id % 99, '/x rv:', page_id, '.0')", "url || ':' || (8000 + page_id % 99)::VARCHAR || '/x rv:' || page_id::VARCHAR || '.0'", "html",
            lambda x: hygiene.replaced(x, (hygiene.AUTHORITY_PORT, "$1<PORT>")), lambda x: _AUTHORITY_SQL.format(x=x)),
)
_named(
    "hyg_host_port",
    _beside("pages", "page_id", "concat('GET /', page_id, '\\nhost: h', page_id, '.org:', page_id % 999, '\\nport:1')",
            "'GET /' || page_id::VARCHAR || chr(10) || 'host: h' || page_id::VARCHAR || '.org:' || (page_id % 999)::VARCHAR || chr(10) || 'port:1'", "html",
            lambda x: hygiene.replaced(x, (hygiene.HOST_PORT, "$1<PORT>")), lambda x: _HOST_SQL.format(x=x)),
)
_bucket_sql = "x"
for _n in range(6, 13):
    _bucket_sql = rf"regexp_replace({_bucket_sql}, '\b\d{{{_n}}}\b', '<NUM_POW10_{_n - 1}>', 'g')"
_named(
    "hyg_num_bucket",
    _over("orders", "o_orderkey", "concat('order ', o_orderkey * 7919, ' of ', o_custkey, ', ', o_orderkey * o_custkey * 104729, '!')",
          "'order ' || (o_orderkey * 7919)::VARCHAR || ' of ' || o_custkey::VARCHAR || ', ' || (o_orderkey * o_custkey * 104729)::VARCHAR || '!'",
          hygiene.bucketed, rf"regexp_replace({_bucket_sql}, '\b\d{{13,}}\b', '<NUM_POW10_12>', 'g')"),
)
#: %hh in capitals, then a blank before a letter or digit that follows.
_PERCENT_SQL = (
    "regexp_replace(array_to_string(list_transform(regexp_extract_all({x}, '%[0-9a-fA-F]{{2}}|[^%]+|%'), lambda r: CASE WHEN regexp_full_match(r, '%[0-9a-fA-F]{{2}}') THEN upper(r) ELSE r END), ''), "
    r"'(%[0-9A-F]{{2}})([0-9A-Za-z])', '\1 \2', 'g')"
)
_named(
    "hyg_percent",
    _beside("documents", "doc_id", "concat('q=%', lower(lpad(hex(doc_id % 256), 2, '0')), 'x%', lower(lpad(hex(doc_id * 7 % 256), 2, '0')), '%zz')",
            "'q=%' || printf('%02x', doc_id % 256) || 'x%' || printf('%02x', doc_id * 7 % 256) || '%zz'", "text",
            hygiene.percent_normalized, lambda x: _PERCENT_SQL.format(x=x)),
)

#: The ordered rules up to base 64, as SQL with {x} for what they run on.
_TYPED_SQL = (
    r"regexp_replace({x}, '\b[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[1-5][0-9a-fA-F]{{3}}-[89abAB][0-9a-fA-F]{{3}}-[0-9a-fA-F]{{12}}\b', '<UUID>', 'g')",
    r"regexp_replace({x}, '\b(?:[0-9a-fA-F]{{1,4}}:){{2,7}}[0-9a-fA-F]{{1,4}}\b', '<IPV6>', 'g')",
    r"regexp_replace({x}, '\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b', '<IPV4>', 'g')",
    r"regexp_replace({x}, '\b\d{{4}}-\d{{2}}-\d{{2}}(?:[T\s]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?)?(?:Z|[+-]\d{{2}}:?\d{{2}})?\b', '<TS>', 'g')",
    r"regexp_replace({x}, '\b\d{{10,13}}\b', '<TS>', 'g')",
    _runs(*_HEX_RUNS, "[0-9a-fA-F]{32,64}", "<HASH>").replace("{32,64}", "{{32,64}}").replace("extract_all(x,", "extract_all({x},"),
    _runs(*_HEX_RUNS, "[0-9a-fA-F]{16,}", "<HEX>").replace("{16,}", "{{16,}}").replace("extract_all(x,", "extract_all({x},"),
    _B64_SQL,
)
_BUCKET_SQL = (*(rf"regexp_replace({{x}}, '\b\d{{{{{n}}}}}\b', '<NUM_POW10_{n - 1}>', 'g')" for n in range(6, 13)), r"regexp_replace({x}, '\b\d{{13,}}\b', '<NUM_POW10_12>', 'g')")


def _chain(steps: tuple[str, ...], name: str, key: str, made: str) -> str:
    """The steps one after another, each over what the one before left."""
    parts = [f"c0 AS (SELECT {key}, {made} AS x FROM {name})"]
    parts += [f"c{k} AS (SELECT {key}, {step.format(x='x')} AS x FROM c{k - 1})" for k, step in enumerate(steps, 1)]
    return f"WITH {', '.join(parts)} SELECT {key}, x AS out FROM c{len(steps)}"


_MIX = "concat('u=6fa459ea-ee8a-3ca4-894e-db77e160355e ip=10.0.', {k} % 256, '.7 h=', md5(cast({k} AS string)), ' n=', 1000000 + {k}, ' b=', repeat('deadBEEF', 9), ' p=:80', {k} % 10, ' e=15', 10000000 + {k}, ' | ', {c})"
_MIX_SQL = "'u=6fa459ea-ee8a-3ca4-894e-db77e160355e ip=10.0.' || ({k} % 256)::VARCHAR || '.7 h=' || md5({k}::VARCHAR) || ' n=' || (1000000 + {k})::VARCHAR || ' b=' || repeat('deadBEEF', 9) || ' p=:80' || ({k} % 10)::VARCHAR || ' e=15' || (10000000 + {k})::VARCHAR || ' | ' || {c}"
_REQUEST = "concat('GET http://h', {k}, '.org:', 1000 + {k} % 9000, '/a%2fb?v=', {k} % 9, '.', {k} % 7, ' rv:92.0 n=', 1000000 + {k}, ' | ', {c})"
_REQUEST_SQL = "'GET http://h' || {k}::VARCHAR || '.org:' || (1000 + {k} % 9000)::VARCHAR || '/a%2fb?v=' || ({k} % 9)::VARCHAR || '.' || ({k} % 7)::VARCHAR || ' rv:92.0 n=' || (1000000 + {k})::VARCHAR || ' | ' || {c}"


def _full(name: str, table_name: str, key: str, column: str, made: str, made_sql: str, rule: Callable[[Column], Column], steps: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, table_name).select(key, rule(F.expr(made.format(k=key, c=column))).alias("out"))

    run.sql = _chain(steps, table_name, key, made_sql.format(k=key, c=column))
    _named(name, run)


_GENERIC_STEPS = (*_TYPED_SQL, _PORT_SQL, *_BUCKET_SQL)
_HTTP_STEPS = (_PERCENT_SQL, *_TYPED_SQL, r"regexp_replace({x}, '(?:[0-9]+\.){{1,3}}[0-9]+', '<VER>', 'g')", _AUTHORITY_SQL, _HOST_SQL, *_BUCKET_SQL)
for _table, _id, _column in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
    _suffix = "" if _table == "documents" else "_pages"
    _full(f"hyg_generic_full{_suffix}", _table, _id, _column, _MIX, _MIX_SQL, hygiene.generic, _GENERIC_STEPS)
    _full(f"hyg_http_full{_suffix}", _table, _id, _column, _REQUEST, _REQUEST_SQL, hygiene.http, _HTTP_STEPS)
_named("ascii_lower", _over("documents", "doc_id", "text", "text", lower_ascii, "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))


#: A key of orders as the typed rules leave it.
_KEY_SQL = "CASE WHEN length(o_orderkey::VARCHAR) < 6 THEN o_orderkey::VARCHAR ELSE '<NUM_POW10_' || (length(o_orderkey::VARCHAR) - 1)::VARCHAR || '>' END"


@query(f"SELECT o_orderkey, '<K:o_orderkey> <SEP> ' || {_KEY_SQL} || ' <EOL> <K:o_orderstatus> <SEP> ' || o_orderstatus || ' <EOL>' AS out FROM orders")
def contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return rows.select("o_orderkey", Contract().applied_to_rows(rows).alias("out"))


@query("SELECT conv_id, turn, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS out FROM conversations")
def contract_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No typed rule fires on these texts, so only the case changes."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Contract(lowercase_mode="ascii").applied(F.col("text")).alias("out"))


# --- noise ---

_NOISY = (
    "CASE doc_id % 6 WHEN 0 THEN md5(cast(doc_id AS string)) WHEN 1 THEN concat(' ', repeat('abcdef01', 9), ' ') WHEN 2 THEN concat(md5(cast(doc_id AS string)), ' tiny') "
    "WHEN 3 THEN concat(repeat('Zy9+', 7), ' ', repeat('0f', 10), ' x') WHEN 4 THEN repeat('QWERTY', 8) ELSE text END"
)
_NOISY_SQL = (
    "CASE doc_id % 6 WHEN 0 THEN md5(doc_id::VARCHAR) WHEN 1 THEN ' ' || repeat('abcdef01', 9) || ' ' WHEN 2 THEN md5(doc_id::VARCHAR) || ' tiny' "
    "WHEN 3 THEN repeat('Zy9+', 7) || ' ' || repeat('0f', 10) || ' x' WHEN 4 THEN repeat('QWERTY', 8) ELSE text END"
)


_BOTH = "(SELECT doc_id, 'text' AS part, text FROM documents UNION ALL SELECT doc_id, 'made', " + _NOISY_SQL + " FROM documents)"


def _kind_sql(t: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({t}, '[0-9a-fA-F]{{32,64}}') THEN '<HASH>' WHEN regexp_full_match({t}, '[0-9a-fA-F]{{16,}}') THEN '<HEX>' "
        f"WHEN length({t}) >= 24 AND regexp_full_match({t}, '[A-Za-z0-9+/_-]+={{0,2}}') AND regexp_matches({t}, '[0-9+/=a-z]') "
        f"AND NOT regexp_full_match(regexp_replace({t}, '[+/=_-]', '', 'g'), '[A-Z]+') THEN '<B64>' END"
    )


def _noise_sql(result: str, x: str = "text", shown: str = "doc_id, ") -> str:
    total = "list_sum(list_transform(w, lambda t: length(t)))"
    part = lambda k: f"coalesce(list_sum(list_transform(w, lambda t: CASE WHEN {_kind_sql('t')} = '{k}' THEN length(t) ELSE 0 END)), 0)"
    return (
        f"WITH s AS (SELECT doc_id, part, {x} AS x FROM {_BOTH}), t AS (SELECT doc_id, part, x, trim(x, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM s), "
        rf"u AS (SELECT *, regexp_split_to_array(s, '\s+') AS w FROM t), v AS (SELECT *, {_kind_sql('s')} AS whole, {total} AS n, {part('<HASH>')} AS a, {part('<HEX>')} AS b, {part('<B64>')} AS c FROM u), "
        "k AS (SELECT *, CASE WHEN s = '' THEN NULL WHEN whole IS NOT NULL THEN whole WHEN len(w) > 1 AND n >= 32 AND a + b + c > 0 AND (a + b + c) / n >= 0.85 "
        "THEN CASE WHEN a >= b AND a >= c THEN '<HASH>' WHEN b >= c THEN '<HEX>' ELSE '<B64>' END END AS kind FROM v) "
        f"SELECT {shown}{result} FROM k"
    )


def _noise_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every document, and beside it a made-up string of a kind that the texts lack."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.lit("text").alias("part"), "text").unionByName(docs.select("doc_id", F.lit("made").alias("part"), F.expr(_NOISY).alias("text")))


@query(_noise_sql("part, kind"))
def noise_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise_both(spark, sf_dir).select("doc_id", "part", noise.classify(F.col("text")).alias("kind"))


@query(_noise_sql("part, coalesce(kind, x) AS out"))
def noise_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise_both(spark, sf_dir).select("doc_id", "part", noise.cleaned(F.col("text")).alias("out"))


def _cleaned_corpus(spark: SparkSession, sf_dir: str, fmt: str, out_fmt: str) -> DataFrame:
    """Texts and made-up strings as a corpus of a format, cleaned into a file and scanned."""
    source, target = shared.fresh_path(spark, f"corpus.{fmt}"), shared.fresh_path(spark, f"cleaned.{out_fmt}")
    rows = _noise_both(spark, sf_dir)
    if fmt == "txt":
        sink.write_texts(rows, source)
    elif fmt == "jsonl":
        rows.write.json(source)
    else:
        rows.write.parquet(source)
    sink.clean_corpus(spark, source, target, fmt, out_fmt=out_fmt)
    return scan.scan(spark, target, out_fmt).select("text")


@query(_noise_sql("coalesce(kind, x) AS text", "translate(text, chr(13) || chr(10), '  ')", shown=""))
def clean_corpus_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned_corpus(spark, sf_dir, "txt", "txt")


@query(_noise_sql("coalesce(kind, x) AS text", shown=""))
def clean_corpus_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned_corpus(spark, sf_dir, "jsonl", "jsonl")


@query(_noise_sql("coalesce(kind, x) AS text", shown=""))
def clean_corpus_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned_corpus(spark, sf_dir, "parquet", "parquet")


@query(_noise_sql("translate(coalesce(kind, x), chr(13) || chr(10), '  ') AS text", shown=""))
def clean_corpus_parquet_to_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned_corpus(spark, sf_dir, "parquet", "txt")


@query(r"SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[^\t\n\r -~]')) AS odd FROM documents GROUP BY lang")
def unprintable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(noise.unprintable(F.col("text"))).alias("odd"))


# --- HTTP structure ---

_VALUES = (
    "CASE o_orderkey % 11 WHEN 0 THEN '  ' WHEN 1 THEN 'café' WHEN 2 THEN 'a%20b' WHEN 3 THEN '10.1.2.3' WHEN 4 THEN '2024-01-02T03:04:05Z' WHEN 5 THEN md5(cast(o_orderkey AS string)) "
    "WHEN 6 THEN substr(md5(cast(o_orderkey AS string)), 1, 16 + o_orderkey % 9) WHEN 7 THEN base64(cast(concat('order number ', o_orderkey) AS binary)) WHEN 8 THEN cast(o_orderkey AS string) "
    "WHEN 9 THEN cast(1000000 + o_orderkey AS string) ELSE o_orderpriority END"
)
_VALUES_SQL = (
    "CASE o_orderkey % 11 WHEN 0 THEN '  ' WHEN 1 THEN 'café' WHEN 2 THEN 'a%20b' WHEN 3 THEN '10.1.2.3' WHEN 4 THEN '2024-01-02T03:04:05Z' WHEN 5 THEN md5(o_orderkey::VARCHAR) "
    "WHEN 6 THEN substr(md5(o_orderkey::VARCHAR), 1, (16 + o_orderkey % 9)::INTEGER) WHEN 7 THEN to_base64(('order number ' || o_orderkey::VARCHAR)::BLOB) WHEN 8 THEN o_orderkey::VARCHAR "
    "WHEN 9 THEN (1000000 + o_orderkey)::VARCHAR ELSE o_orderpriority END"
)


def _placeholder_sql(v: str) -> str:
    s = f"trim({v})"
    return (
        rf"CASE WHEN {s} = '' THEN '<EMPTY>' WHEN regexp_matches({s}, '[^\t\n\r -~]') THEN '<BYTES>' WHEN regexp_matches({s}, '%[0-9a-fA-F]{{2}}') THEN '<URLENC>' "
        rf"WHEN regexp_full_match({s}, '(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)') THEN '<IPV4>' "
        rf"WHEN regexp_full_match({s}, '\d{{4}}-\d{{2}}-\d{{2}}(?:[T\s]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?)?(?:Z|[+-]\d{{2}}:?\d{{2}})?|\d{{10,13}}') THEN '<TS>' "
        f"WHEN regexp_full_match({s}, '[0-9a-fA-F]{{32,}}') THEN CASE WHEN length({s}) IN (32, 40, 64) THEN '<HASH_' || length({s})::VARCHAR || '>' ELSE '<HASH>' END "
        f"WHEN regexp_full_match({s}, '[0-9a-fA-F]{{16,}}') THEN CASE WHEN length({s}) IN (16, 24) THEN '<HEX_' || length({s})::VARCHAR || '>' ELSE '<HEX>' END "
        f"WHEN {_kind_sql(s)} = '<B64>' THEN '<B64>' WHEN regexp_full_match({s}, '[0-9]+') THEN CASE WHEN length({s}) < 6 THEN '<NUM>' ELSE '<NUM_POW10_' || least(12, length({s}) - 1)::VARCHAR || '>' END "
        "ELSE '<STR>' END"
    )


@query(f"WITH s AS (SELECT o_orderkey, {_VALUES_SQL} AS v FROM orders) SELECT o_orderkey, {_placeholder_sql('v')} AS tag FROM s")
def value_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", httpstruct.value_placeholder(F.expr(_VALUES)).alias("tag"))


@query(
    f"WITH s AS (SELECT o_orderkey, {_VALUES_SQL} AS v FROM orders) SELECT o_orderkey, '<QK> id <QVAL> <NUM> <QK> flag <QVAL> <EMPTY> <QK> v <QVAL> ' || {_placeholder_sql('v')} AS tokens FROM s"
)
def query_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.lit("id=7&&flag&v="), F.expr(_VALUES))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(httpstruct.query_tokens(q), " ").alias("tokens"))


@query(
    "WITH s AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders) SELECT o_orderkey, "
    "'<COOKIE_K> sid <COOKIE_V> <HASH_32> <COOKIE_K> t_<HEX_16> <COOKIE_V> <NUM> <COOKIE_K> <URLENC>x <COOKIE_V> <EMPTY>' AS tokens FROM s"
)
def cookie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    c = F.concat(F.lit("sid="), h, F.lit("; t_"), F.left(h, F.lit(16)), F.lit("=1; %41x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(httpstruct.cookie_tokens(c), " ").alias("tokens"))


_SEG = "list_transform(string_split(p, '/'), lambda s, i: CASE WHEN s = '' THEN '' ELSE CASE WHEN {tag} IN ('<STR>', '<NUM>') THEN s ELSE {tag} END || CASE WHEN i < len(string_split(p, '/')) THEN ' /' ELSE '' END END)"


@query(
    "WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*', ''), '^[a-z]+://[^/]*', '') AS u FROM pages), t AS (SELECT page_id, CASE WHEN u LIKE '/%' THEN substr(u, 2) ELSE u END AS p, u FROM s) "
    f"SELECT page_id, array_to_string(list_filter(['<URL>', CASE WHEN u LIKE '/%' THEN '/' ELSE '' END] || {_SEG.replace('{tag}', _placeholder_sql('s'))} || ['<QK> n <QVAL> <NUM>'], lambda t: t <> ''), ' ') AS tokens FROM t"
)
def url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("?n=1#top"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(httpstruct.url_tokens(url), " ").alias("tokens"))


@query(
    f"SELECT o_orderkey, '<METHOD> GET <URL> / item / ' || {_KEY_SQL} || ' <QK> p <QVAL> <STR> <PROT> HTTP/1.1 <EOL> <HDR> host <SEP> shop.org <EOL> "
    "<HDR> authorization <SEP> <AUTH_BEARER> <HASH_32> <EOL> <BODY> <FORM> <QK> a <QVAL> <NUM> <QK> b <QVAL> <STR>' AS out FROM orders"
)
def http_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("GET https://shop.org/item/"), key, F.lit("?p=x HTTP/1.1\r\nHost: shop.org\r\nAuthorization: Bearer "), F.md5(key.cast("binary")), F.lit("\r\n\r\na=1&b=two"))
    return table(spark, sf_dir, "orders").select("o_orderkey", httpstruct.structured(text).alias("out"))


@query(
    "SELECT event_id, '<METHOD> POST <URL> api <PROT> HTTP/2 <EOL> <HDR> x-id <SEP> ' || CASE WHEN length(event_id::VARCHAR) < 6 THEN event_id::VARCHAR ELSE '<NUM_POW10_' || (length(event_id::VARCHAR) - 1)::VARCHAR || '>' END || ' <EOL> <BODY> <JSON> <K:k> <SEP> ' || "
    "CASE WHEN length(json_extract_string(props, '$.k')) < 6 THEN '<NUM>' ELSE '<NUM_POW10_' || (length(json_extract_string(props, '$.k')) - 1)::VARCHAR || '>' END || ' <EOL>' AS out FROM events"
)
def http_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<METHOD> POST\n<URL> api\n<PROT> HTTP/2\n<HDR>\nX-Id: "), F.col("event_id").cast("string"), F.lit("\n<BODY>\n"), F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", httpstruct.structured(text).alias("out"))


@query(
    f"SELECT o_orderkey, '<METHOD> PUT <URL> / item / ' || {_KEY_SQL} || ' <PROT> HTTP/1.1 <EOL> <HDR> host <SEP> shop.org <EOL> <BODY> <FORM> <QK> a <QVAL> <NUM> <QK> b <QVAL> <STR>' AS out FROM orders"
)
def http_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request whose parts are columns, its headers a map."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        "o_orderkey", F.lit("PUT").alias("method"), F.concat(F.lit("https://shop.org/item/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.lit("HTTP/1.1").alias("protocol"), F.create_map(F.lit("Host"), F.lit("shop.org")).alias("headers"), F.lit("a=1&b=two").alias("body"),
    )
    contract = Contract(structured_input_mode="http", enable_typed_hygiene=False)
    return rows.select("o_orderkey", contract.applied_to_rows(rows).alias("out"))


@query(
    "SELECT o_orderkey, '<BODY> <JSON> <K:a> <SEP> ' || CASE WHEN length(o_orderkey::VARCHAR) < 6 THEN '<NUM>' ELSE '<NUM_POW10_' || (length(o_orderkey::VARCHAR) - 1)::VARCHAR || '>' END || "
    "' <EOL> <K:b> <SEP> <NUM> <EOL> <K:c> <SEP> <STR> <EOL> <K:d> <SEP> ' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || "
    "' <EOL> <K:e> <SEP> <EMPTY> <EOL> <K:f> <SEP> <JSON> <EOL> <K:g> <SEP> <JSON> <EOL> <K:h> <SEP> <HASH_32> <EOL>' AS out FROM orders"
)
def json_body_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of JSON value: whole number, fraction, text, truth value, null, list, object, hash."""
    body = F.expr("concat('{\"b\": 1.5, \"a\": ', o_orderkey, ', \"d\": ', o_orderkey % 2 = 0, ', \"c\": \"', o_orderpriority, '\", \"e\": null, \"f\": [1, 2], \"g\": {\"x\": 1}, \"h\": \"', md5(cast(o_orderkey AS string)), '\"}')")
    tokens = httpstruct.body_tokens(body, httpstruct.Marks(), 6, 4096)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tokens, " ").alias("out"))


@query(f"SELECT o_orderkey, '<BODY> ' || CASE o_orderkey % 3 WHEN 0 THEN '<JSON> <LIST>' WHEN 1 THEN '<RAW> {{\"a\": ' || o_orderkey::VARCHAR ELSE '<FORM> <QK> a <QVAL> <STR>' END AS out FROM orders")
def other_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list, broken JSON, and a form."""
    body = F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat('[', o_orderkey, ']') WHEN 1 THEN concat('{\"a\": ', o_orderkey) ELSE 'a=b&' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(httpstruct.body_tokens(body, httpstruct.Marks(), 6, 4096), " ").alias("out"))


# --- records ---


@query(
    "SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus || ' x' AS list, '{\"k\": ' || o_orderkey::VARCHAR || ', \"t\": \"\\u00e9\"}' AS object, "
    "'a {\"k\": ' || o_orderkey::VARCHAR || '}' AS mixed, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS truth FROM orders"
)
def plain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists at every depth, objects in ASCII, and truth values as plain text."""
    made = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.array(F.array("o_orderpriority", F.lit(None)), F.array("o_orderstatus", F.lit("x"))).alias("list"),
        F.struct(F.col("o_orderkey").alias("k"), F.lit("é").alias("t")).alias("object"),
        F.array(F.create_map(F.lit("k"), F.col("o_orderkey"))).alias("maps"),
        (F.col("o_orderkey") % 2 == 0).alias("truth"),
    )
    text = lambda name: records.as_text(made, name)
    return made.select("o_orderkey", text("list").alias("list"), text("object").alias("object"), F.concat(F.lit("a "), text("maps")).alias("mixed"), text("truth").alias("truth"))


@query("SELECT '<PATH> ' || url || chr(10) || '<HTML>' || chr(10) || trim(html, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages")
def dataset_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a known data set by its formatter."""
    return scan.dataset_texts(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("text")), "phish_html").select("text")


@query("SELECT trim(html, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages")
def dataset_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unformatted texts of a data set as JSON lines, scanned again."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    path = sink.export_dataset(pages, "phish_html", shared.fresh_path(spark, "export"), formatted=False)
    return scan.scan(spark, path, "jsonl").select("text")


@query("SELECT page_id, trim(html, ' ' || chr(9) || chr(10) || chr(13)) AS out FROM pages UNION ALL SELECT -o_orderkey, '{\"o_orderkey\":' || o_orderkey::VARCHAR || '}' FROM orders")
def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usual column that is filled, else the row as JSON."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit(" ").alias("formatted"), F.col("html").alias("body"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return pages.select("page_id", records.row_text(pages).alias("out")).unionByName(orders.select((-F.col("o_orderkey")).alias("page_id"), records.row_text(orders).alias("out")))



@query(
    "SELECT o_orderkey, '<K:o_custkey> <SEP> ' || o_custkey::VARCHAR || ' <EOL> <K:o_orderpriority> <SEP> ' || o_orderpriority || ' <EOL> <K:o_totalprice> <SEP> ' || o_totalprice::VARCHAR || ' <EOL> <K:none> <SEP> <EMPTY> <EOL>' AS out FROM orders"
)
def serialize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", records.serialized(orders, order=["o_custkey", "o_orderpriority", "o_totalprice", "none"]).alias("out"))


@query("SELECT event_id, '<K:k> <SEP> ' || json_extract_string(props, '$.k') || ' <EOL>' AS out FROM events")
def serialize_events_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", records.serialized_map(F.from_json("props", "map<string,string>")).alias("out"))


@query("SELECT event_id, (value * pow(10, event_id % 9))::VARCHAR AS shown FROM events WHERE value IS NOT NULL")
def float_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") * F.pow(F.lit(10.0), (F.col("event_id") % 9).cast("double"))
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", float_repr(x).alias("shown"))


@query("SELECT page_id, rtrim('<METHOD> GET' || chr(10) || '<URL> ' || url || chr(10) || '<PROT> ' || chr(10) || '<HDR>' || chr(10) || chr(10) || '<BODY>' || chr(10) || trim(html, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AS out FROM pages")
def format_waf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit("GET").alias("method"), "url", F.lit(None).cast("string").alias("headers"), F.col("html").alias("body"))
    return rows.select("page_id", records.waf(rows).alias("out"))


@query("SELECT page_id, '<PATH> ' || url || chr(10) || '<YEAR> ' || (2000 + page_id % 20)::VARCHAR || chr(10) || '<HTML>' || chr(10) || trim(html, ' ' || chr(9) || chr(10) || chr(13)) AS out FROM pages")
def format_phish_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), (F.lit(2000) + F.col("page_id") % 20).alias("year"), F.col("html").alias("text"))
    return rows.select("page_id", records.phish_html(rows).alias("out"))


@query("SELECT event_id, '<TS> ' || strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M:%S') || chr(10) || '<LEVEL> ' || event_type || chr(10) || '<MSG> ' || props AS out FROM events")
def format_hdfs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), F.col("event_type").alias("level"), F.col("props").alias("content"))
    return rows.select("event_id", records.hdfs(rows).alias("out"))


@query("SELECT conv_id, turn, '<SUBJ> talk ' || conv_id::VARCHAR || chr(10) || '<FROM> ' || role || chr(10) || '<URLS> a.org b.org' || chr(10) || '<BODY>' || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS out FROM conversations")
def format_email_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("subject"), F.col("role").alias("sender"), F.array(F.lit("a.org"), F.lit("b.org")).alias("urls"), "text")
    return rows.select("conv_id", "turn", records.phishing_email(rows).alias("out"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS out FROM part")
def fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.lit("1").alias("label"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise("  ").alias("a"), F.col("p_brand").alias("b"))
    return rows.select("p_partkey", records.any_text(rows.drop("p_partkey")).alias("out"))


# --- mining ---

_DEFAULT_SQL = "[^ \\t\\n,:;=&?/#%()\\[\\]{}<>\"''|]+"
_SEGS = f"seg AS (SELECT s, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_DEFAULT_SQL}')) AS s FROM documents) GROUP BY s)"
_SPANS = (
    f"WITH {_SEGS}, a AS (SELECT s, n, unnest(generate_series(1, length(s) - 1)) AS i FROM seg WHERE length(s) >= 2), "
    "b AS (SELECT s, n, i, unnest(generate_series(2, least(24, length(s) - i + 1))) AS k FROM a), "
    "c AS (SELECT substr(s, i, k) AS token, CAST(sum(n) AS BIGINT) AS freq FROM b GROUP BY 1 HAVING sum(n) >= 10)"
)


def _docs_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.candidates(table(spark, sf_dir, "documents").select("text"))


@query(f"WITH {_SEGS} SELECT s AS piece, n FROM seg")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.counted(table(spark, sf_dir, "documents"), mining.segments(F.col("text"), mining.boundaries("default")))


@query(f"{_SPANS} SELECT token, freq FROM c")
def span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs_candidates(spark, sf_dir)


@query(
    "WITH r AS (SELECT s, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '[,:;=&?/#%()\\[\\]{}\"''|._\\-\\\\+*!$]+')) AS s FROM pages) GROUP BY s), "
    "a AS (SELECT s, n, unnest(generate_series(1, length(s) - 1)) AS i FROM r WHERE length(s) >= 2), b AS (SELECT s, n, i, unnest(generate_series(2, least(4, length(s) - i + 1))) AS k FROM a) "
    "SELECT substr(s, i, k) AS token, CAST(sum(n) AS BIGINT) AS freq FROM b GROUP BY 1 HAVING sum(n) >= 10"
)
def symbol_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = mining.counted(table(spark, sf_dir, "pages"), mining.symbol_runs(F.col("html"), mining.boundaries("http")))
    return mining.spans(runs, 2, 4).groupBy("token").agg(F.sum("n").alias("freq")).where("freq >= 10")


_TAG_PATTERN = "'<[A-Z][A-Z0-9_]{1,31}>'"


@query(
    f"SELECT tag, count(*) AS freq FROM (SELECT unnest(regexp_extract_all('<' || upper(event_type) || '> <TYPE> <K9_X> <a> ' || CASE WHEN event_id % 2 = 0 THEN '<EVEN>' ELSE '' END, {_TAG_PATTERN})) AS tag FROM events "
    f"UNION ALL SELECT unnest(regexp_extract_all(html, {_TAG_PATTERN})) FROM pages UNION ALL SELECT unnest(regexp_extract_all(text, {_TAG_PATTERN})) FROM documents) GROUP BY tag HAVING count(*) >= 2 ORDER BY freq DESC, tag LIMIT 64"
)
def tag_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages and documents, and made-up tags of events."""
    made = F.expr("concat('<', upper(event_type), '> <TYPE> <K9_X> <a> ', IF(event_id % 2 = 0, '<EVEN>', ''))")
    texts = table(spark, sf_dir, "events").select(made.alias("text")).unionByName(table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    return mining.tags(texts.unionByName(table(spark, sf_dir, "documents").select("text")), min_freq=2)


@query("SELECT text AS out FROM (SELECT unnest(regexp_extract_all(CASE WHEN event_id % 3 = 0 THEN 'x<' || upper(event_type) || '>y' ELSE 'z <' || event_type || '> w' END, '[xyzw]|[a-z_]{2,}')) AS text FROM events)")
def tag_interior_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments leave out what stands in a tag of capitals, and keep what stands in one of small letters."""
    made = F.expr("IF(event_id % 3 = 0, concat('x<', upper(event_type), '>y'), concat('z <', event_type, '> w'))")
    return table(spark, sf_dir, "events").select(F.explode(mining.segments(made, mining.boundaries("default"))).alias("out"))


@query("SELECT DISTINCT unnest(string_split(text || 'Q~', '')) AS ch FROM documents")
def distinct_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.characters(table(spark, sf_dir, "documents"), also="Q~")


# --- induction ---


@query(f"{_SPANS} SELECT token, freq, CAST(freq * (length(token) - 1) AS DOUBLE) AS score FROM c ORDER BY score DESC, length(token) DESC, token DESC LIMIT 1000")
def score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = induce.scored(_docs_candidates(spark, sf_dir), mining.boundaries("default"))
    return ranked.orderBy(F.desc("score"), F.desc(F.length("token")), F.desc("token")).limit(1000)


@query(
    "WITH r AS (SELECT s, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '[,:;=&?/#%()\\[\\]{}\"''|._\\-\\\\+*!$]+')) AS s FROM pages) GROUP BY s) "
    "SELECT s AS token, n AS freq, CAST(n * (length(s) - 1) AS DOUBLE) - 0.5 * (1.5 * length(s)) AS score FROM r"
)
def score_with_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = mining.boundaries("http")
    runs = mining.counted(table(spark, sf_dir, "pages"), mining.symbol_runs(F.col("html"), bounds)).select(F.col("piece").alias("token"), F.col("n").alias("freq"))
    return induce.scored(runs, bounds, 0.5, "boundary_penalty", 1.5)


_BASE = [*mining.SPECIALS, "<UUID>", "the", "of", "tion"]


@query(
    f"{_SPANS}, base AS (SELECT unnest({_BASE!r}) AS token, unnest(range({len(_BASE)})) AS id), "
    f"k AS (SELECT token, row_number() OVER (ORDER BY freq * (length(token) - 1) DESC, length(token) DESC, token DESC) AS rn FROM c WHERE token NOT IN (SELECT token FROM base)) "
    f"SELECT token, CAST(id AS INTEGER) AS id FROM base UNION ALL SELECT token, CAST(rn + {len(_BASE) - 1} AS INTEGER) FROM k WHERE rn <= {512 - len(_BASE)}"
)
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = induce.scored(_docs_candidates(spark, sf_dir), mining.boundaries("default"))
    return induce.vocabulary(ranked, _BASE, 512)


@query(f"{_SPANS} SELECT token, freq FROM c WHERE token NOT IN ({', '.join(map(repr, _BASE))})")
def base_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs_candidates(spark, sf_dir).join(F.broadcast(induce.numbered(spark, _BASE).select("token")), "token", "left_anti")


# --- encoding ---


def _doc_vocab(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """512 best tokens after all characters of the corpus."""
    chars = [r.ch for r in mining.characters(table(spark, sf_dir, "documents")).collect()]  # bounded by the alphabet
    base = induce.base_tokens([], [], chars)
    ranked = induce.scored(_docs_candidates(spark, sf_dir), mining.boundaries("default"))
    return {r.token: r.id for r in induce.vocabulary(ranked, base, len(base) + 512).collect()}


@query()
def encode_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", matcher.encoded(F.col("text"), _doc_vocab(spark, sf_dir)).alias("ids"))


@query("SELECT doc_id, text, true AS same FROM documents")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = _doc_vocab(spark, sf_dir)
    ids = table(spark, sf_dir, "documents").select("doc_id", "text", matcher.encoded(F.col("text"), vocab).alias("ids"))
    shown = ids.select("doc_id", matcher.decoded(F.col("ids"), vocab).alias("out"), "text")
    return shown.select("doc_id", F.col("out").alias("text"), (F.col("out") == F.col("text")).alias("same"))


_WORDS = {"[PAD]": 0, "[UNK]": 1, "tion": 2, "ti": 3, "on": 4, "the": 5, "th": 6, "he": 7, "e": 8}


@query(
    "SELECT doc_id, [CASE p WHEN 'tion' THEN 2 WHEN 'ti' THEN 3 WHEN 'on' THEN 4 WHEN 'the' THEN 5 WHEN 'th' THEN 6 WHEN 'he' THEN 7 WHEN 'e' THEN 8 ELSE 1 END "
    "FOR p IN regexp_extract_all(text, '(?s)tion|ti|on|the|th|he|e|.')] AS ids FROM documents"
)
def encode_small_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", matcher.encoded(F.col("text"), _WORDS).alias("ids"))


@query(
    "SELECT doc_id, [CASE p WHEN 'tion' THEN 2 WHEN 'ti' THEN 3 WHEN 'on' THEN 4 WHEN 'the' THEN 5 WHEN 'th' THEN 6 WHEN 'he' THEN 7 WHEN 'e' THEN 8 ELSE 1 END "
    "FOR p IN regexp_extract_all(text, '(?s)tion|ti|on|the|th|he|e|.')] AS ids FROM documents"
)
def encode_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", matcher.encoded_arrow(_WORDS)("text").alias("ids"))


def _vocab_of(spark: SparkSession, sf_dir: str, size: int) -> dict[str, int]:
    """The best tokens of the documents after all their characters, size in all."""
    chars = [r.ch for r in mining.characters(table(spark, sf_dir, "documents")).collect()]  # bounded by the alphabet
    ranked = induce.scored(_docs_candidates(spark, sf_dir), mining.boundaries("default"))
    return {r.token: r.id for r in induce.vocabulary(ranked, induce.base_tokens([], [], chars), size).collect()}


@query("SELECT doc_id, text AS out FROM documents")
def encode_8192(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary of the default size: the ids decode to the text, as all characters are tokens."""
    vocab = _vocab_of(spark, sf_dir, 8192)
    ids = table(spark, sf_dir, "documents").select("doc_id", matcher.encoded(F.col("text"), vocab).alias("ids"))
    return ids.select("doc_id", matcher.decoded(F.col("ids"), vocab).alias("out"))


@query("SELECT doc_id, text AS out FROM documents")
def encode_32768(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = _vocab_of(spark, sf_dir, 32768)
    ids = table(spark, sf_dir, "documents").select("doc_id", matcher.encoded(F.col("text"), vocab).alias("ids"))
    return ids.select("doc_id", matcher.decoded(F.col("ids"), vocab).alias("out"))


_BARE = Contract(enable_typed_hygiene=False)
_WORDS_SQL = (
    "[CASE p WHEN 'tion' THEN 2 WHEN 'ti' THEN 3 WHEN 'on' THEN 4 WHEN 'the' THEN 5 WHEN 'th' THEN 6 WHEN 'he' THEN 7 WHEN 'e' THEN 8 ELSE 1 END "
    "FOR p IN regexp_extract_all(text, '(?s)tion|ti|on|the|th|he|e|.')]"
)


def _small_artifact() -> Artifact:
    """Written out and read again."""
    with tempfile.TemporaryDirectory() as folder:  # small files of the driver, gone before any job runs
        Artifact({"schema_version": "vocabulary.v1"}, dict(_WORDS), _BARE, list(mining.SPECIALS)).save(folder)
        return Artifact.load(folder)


@query(f"SELECT doc_id, {_WORDS_SQL} AS ids FROM documents")
def artifact_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding by an artifact that went through its files."""
    return table(spark, sf_dir, "documents").select("doc_id", Runtime(_small_artifact()).encoded(F.col("text")).alias("ids"))


@query(f"WITH e AS (SELECT doc_id, list_concat([2], ({_WORDS_SQL})[1:14], [3]) AS f FROM documents) SELECT doc_id, list_concat(f, list_transform(range(0, 16), lambda i: 0))[1:16] AS input_ids, list_transform(range(0, 16), lambda i: CASE WHEN i < len(f) THEN 1 ELSE 0 END) AS attention_mask, list_transform(range(0, 16), lambda i: 0) AS token_type_ids FROM e")
def artifact_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", Runtime(_small_artifact()).batch(F.col("text"), 16).alias("x")).select("doc_id", "x.*")


@query(f"WITH e AS (SELECT text, {_WORDS_SQL} AS ids FROM documents) SELECT text, len(ids)::INTEGER AS tokens, len(list_filter(ids, lambda i: i = 1))::INTEGER AS unknown, len(list_filter(ids, lambda i: i = 1)) / greatest(1, len(ids)) AS rate FROM e")
def encode_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on how a corpus is encoded, over all of its texts."""
    texts = scan.scan(spark, f"{sf_dir}/documents.parquet", "parquet")
    return runs.verified(texts, _small_artifact())[0].select("text", "tokens", "unknown", "rate")


@query("SELECT conv_id, turn, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS out FROM conversations")
def hygiene_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract by way of an artifact of its own, written out and read again."""
    with tempfile.TemporaryDirectory() as folder:
        HygieneArtifact(Contract(lowercase_mode="ascii"), "h1", "t1").save(folder)
        hygiene_only = HygieneArtifact.load(folder)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", hygiene_only.normalized(F.col("text")).alias("out"))


@query("SELECT translate(text, chr(13) || chr(10) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '  abcdefghijklmnopqrstuvwxyz') AS text FROM conversations WHERE text <> ''")
def contract_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus under a contract, written as lines and scanned."""
    source, target = f"{sf_dir}/conversations.parquet", shared.fresh_path(spark, "contracted")
    sink.write_contracted(spark, source, Contract(lowercase_mode="ascii"), target, "parquet")
    return scan.scan(spark, target, "txt").select("text")


# --- streams ---


def _streamed(spark: SparkSession, sf_dir: str, name: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table read as a stream, changed, and written out until there is no more; read again as a table."""
    schema = table(spark, sf_dir, name).schema
    stream = change(jobs.read(spark, f"{sf_dir}/{name}.parquet*", schema))
    target = shared.fresh_path(spark, "stream")
    jobs.write(stream, target, shared.fresh_path(spark, "offsets")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


@query(f"SELECT doc_id, {_WORDS_SQL} AS ids FROM documents")
def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "documents", lambda df: jobs.encoded(df, _small_artifact())).select("doc_id", "ids")


@query("SELECT conv_id, turn, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM conversations")
def stream_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "conversations", lambda df: jobs.normalized(df, Contract(lowercase_mode="ascii"))).select("conv_id", "turn", "text")


@query(r"SELECT doc_id, length(regexp_replace(text, '[ -~\t\n\r]', '', 'g')) / greatest(1, length(text)) AS rate FROM documents")
def unk_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = {t: i for i, t in enumerate([*mining.SPECIALS, *mining.ASCII])}
    plain = {t: i for t, i in vocab.items() if len(t) == 1 or t == "[PAD]"}
    ids = matcher.encoded(F.col("text"), {**plain, "[UNK]": 1})
    return table(spark, sf_dir, "documents").select("doc_id", matcher.unknown_rate(ids).alias("rate"))


_A, _B = "[l_partkey % 90 + 5, l_suppkey % 90 + 5, l_linenumber + 5]", "[l_linenumber + 9, 7]"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.expr("array(l_partkey % 90 + 5, l_suppkey % 90 + 5, l_linenumber + 5)").alias("a"), F.expr("array(l_linenumber + 9, 7)").alias("b"))


@query(f"SELECT l_orderkey, l_linenumber, [2] || {_A} || [3] || {_B} || [3] AS ids FROM lineitem")
def frame_cls_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", matcher.framed(F.col("a"), F.col("b")).alias("ids"))


#: Two sequences of 0 to 6 and of 1 to 3 ids.
_A_VARIED, _B_VARIED = "range(5, 5 + l_partkey % 7)", "range(9, 10 + l_linenumber % 3)"


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    none = "cast(array() AS array<int>)"
    a = f"IF(l_partkey % 7 = 0, {none}, sequence(5, cast(4 + l_partkey % 7 AS int)))"
    return line.select("l_orderkey", "l_linenumber", F.expr(a).alias("a"), F.expr("sequence(9, cast(9 + l_linenumber % 3 AS int))").alias("b"))


@query(f"SELECT l_orderkey, l_linenumber, list_concat(list_transform(range(0, len({_A_VARIED}) + 2), lambda i: 0), list_transform(range(0, len({_B_VARIED}) + 1), lambda i: 1)) AS ids FROM lineitem")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir).select("l_orderkey", "l_linenumber", matcher.segment_ids(F.col("a"), F.col("b")).alias("ids"))


@query(
    f"WITH f AS (SELECT l_orderkey, l_linenumber, list_concat([2], ({_A_VARIED})[1:4], [3]) AS f FROM lineitem) SELECT l_orderkey, l_linenumber, "
    "list_concat(f, [0, 0, 0, 0])[1:6] AS input_ids, list_transform(range(0, 6), lambda i: CASE WHEN i < len(f) THEN 1 ELSE 0 END) AS attention_mask, list_transform(range(0, 6), lambda i: 0) AS token_type_ids FROM f"
)
def pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length 6: up to 4 ids between the marks, longer sequences cut, shorter ones padded."""
    return _varied(spark, sf_dir).select("l_orderkey", "l_linenumber", matcher.batch(F.col("a"), 6).alias("x")).select("l_orderkey", "l_linenumber", "x.*")


# --- validation ---

_TYPED = Contract().typed_symbols()
_VOCAB_SQL = "v AS (SELECT DISTINCT t AS token FROM (SELECT unnest([md5(doc_id::VARCHAR), '<' || substr('UUID> IPV4> PORT>', (1 + doc_id % 9)::INTEGER, 3), to_base64(('token number ' || (doc_id % 30)::VARCHAR)::BLOB), '<UUID>', 'w' || doc_id::VARCHAR, source]) AS t FROM documents))"


def _suspect_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr(
        "explode(array(md5(cast(doc_id AS string)), concat('<', substr('UUID> IPV4> PORT>', 1 + doc_id % 9, 3)), base64(cast(concat('token number ', doc_id % 30) AS binary)), '<UUID>', concat('w', doc_id), source))"
    )
    return table(spark, sf_dir, "documents").select(made.alias("token")).distinct()


@query(
    f"WITH {_VOCAB_SQL}, s AS (SELECT unnest({_TYPED!r}) AS symbol) SELECT 'typed_symbol_substring' AS code, "
    "'token ''' || min(token) || ''' is a piece of the typed symbol ''' || symbol || '''' AS message FROM v JOIN s ON token <> symbol AND length(token) >= 2 AND (contains(token, '<') OR contains(token, '>')) AND contains(symbol, token) GROUP BY symbol"
)
def typed_integrity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.broken_symbols(_suspect_vocab(spark, sf_dir), _TYPED)


_ENTROPY_SQL = (
    f"WITH {_VOCAB_SQL}, e AS (SELECT token, token IN ({', '.join(map(repr, _TYPED))}) OR (token LIKE '<%' AND token LIKE '%>') OR (token LIKE '[%' AND token LIKE '%]') AS exempt FROM v WHERE token <> ''), "
    "c AS (SELECT count(*) AS tokens, count(*) FILTER (NOT exempt AND regexp_full_match(token, '[0-9a-fA-F]{16,}')) AS long_hex, count(*) FILTER (NOT exempt AND regexp_full_match(token, '[A-Za-z0-9+/]{24,}={0,2}')) AS b64 FROM e)"
)


@query(f"{_ENTROPY_SQL} SELECT * FROM c")
def entropy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.entropy_counts(_suspect_vocab(spark, sf_dir), _TYPED)


@query(
    f"{_ENTROPY_SQL} SELECT 'entropy_hex_overflow' AS code, long_hex::VARCHAR || ' of ' || tokens::VARCHAR || ' tokens: of them look like random blobs' AS message FROM c WHERE long_hex > 32 OR long_hex / tokens > 0.005 "
    "UNION ALL SELECT 'entropy_b64_overflow', b64::VARCHAR || ' of ' || tokens::VARCHAR || ' tokens: of them look like random blobs' FROM c WHERE b64 > 16 OR b64 / tokens > 0.002 "
    "UNION ALL SELECT 'typed_hygiene_leak_hex', long_hex::VARCHAR || ' of ' || tokens::VARCHAR || ' tokens: raw hex tokens remain beside the typed symbol' FROM c WHERE long_hex > 5 "
    "UNION ALL SELECT 'typed_hygiene_leak_b64', b64::VARCHAR || ' of ' || tokens::VARCHAR || ' tokens: raw base-64 tokens remain beside the typed symbol' FROM c WHERE b64 > 3"
)
def entropy_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.entropy_issues(_suspect_vocab(spark, sf_dir), _TYPED)


@query(
    f"{_ENTROPY_SQL}, i AS (SELECT 'entropy_hex_overflow' AS code, long_hex::VARCHAR || ' of ' || tokens::VARCHAR || ' tokens: of them look like random blobs' AS message FROM c WHERE long_hex > 32 OR long_hex / tokens > 0.005 "
    "UNION ALL SELECT 'entropy_b64_overflow', b64::VARCHAR || ' of ' || tokens::VARCHAR || ' tokens: of them look like random blobs' FROM c WHERE b64 > 16 OR b64 / tokens > 0.002 "
    "UNION ALL SELECT 'typed_hygiene_leak_hex', long_hex::VARCHAR || ' of ' || tokens::VARCHAR || ' tokens: raw hex tokens remain beside the typed symbol' FROM c WHERE long_hex > 5 "
    "UNION ALL SELECT 'typed_hygiene_leak_b64', b64::VARCHAR || ' of ' || tokens::VARCHAR || ' tokens: raw base-64 tokens remain beside the typed symbol' FROM c WHERE b64 > 3), "
    f"s AS (SELECT unnest({_TYPED!r}) AS symbol) SELECT * FROM i UNION ALL SELECT 'typed_symbol_substring', 'token ''' || min(token) || ''' is a piece of the typed symbol ''' || symbol || '''' "
    "FROM v JOIN s ON token <> symbol AND length(token) >= 2 AND (contains(token, '<') OR contains(token, '>')) AND contains(symbol, token) GROUP BY symbol"
)
def artifact_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All guardrails over an artifact's vocabulary, which grows with the documents and so stays a table."""
    return issues_of(_suspect_vocab(spark, sf_dir), Contract())


# --- baselines ---

_WORD_SQL = r"w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+')) AS word FROM documents) GROUP BY word)"


@query(f"WITH {_WORD_SQL} SELECT word, n FROM w")
def ws_pretokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.word_counts(table(spark, sf_dir, "documents"))


@query(
    f"WITH {_WORD_SQL}, a AS (SELECT word, n, unnest(generate_series(1, length(word) - 1)) AS i FROM w WHERE length(word) > 1) "
    'SELECT substr(word, i, 1) AS "left", substr(word, i + 1, 1) AS "right", CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY 1, 2'
)
def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.pair_counts(baselines.word_counts(table(spark, sf_dir, "documents")))


@query()
def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, merges = baselines.bpe(baselines.word_counts(table(spark, sf_dir, "documents")), Trainer().vocab_size)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank int, left string, right string")


@query()
def wordpiece_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = baselines.wordpiece(baselines.word_counts(table(spark, sf_dir, "documents")), Trainer().vocab_size)
    return spark.createDataFrame(list(vocab.items()), "token string, id int")


@query()
def unigram_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    logp = baselines.unigram(baselines.word_counts(table(spark, sf_dir, "documents")), Trainer().vocab_size)
    return spark.createDataFrame(list(logp.items()), "token string, logp double")


# --- drifts and metrics ---

_named("ws_normalize", _over("pages", "page_id", "html", "html", drift.blanks_folded, r"trim(regexp_replace(x, '\s+', ' ', 'g'))"))
_named(
    "delim_spaces",
    _over("pages", "page_id", "html", "html", drift.delimiters_spaced, r"trim(regexp_replace(regexp_replace(x, '([,:;=\[\]{}()<>])', ' \1 ', 'g'), '\s+', ' ', 'g'))"),
)
_named(
    "json_sort_keys",
    _over("orders", "o_orderkey", "concat('{\"b\": ', o_orderkey, ', \"a\": [1.0, {\"z\": null, \"y\": \"', o_orderkey % 7, '\"}]}')", "''", drift.keys_sorted,
          "'{\"a\":[1.0,{\"y\":\"' || (o_orderkey % 7)::VARCHAR || '\",\"z\":null}],\"b\":' || o_orderkey::VARCHAR || '}'"),
)


_TWO_ATTRS = "concat('<a href=\"', url, '\" class=\"c', page_id, '\" id=\"x\">', page_id, '</a>', html)"


@query(
    "WITH h AS (SELECT page_id, '<a href=\"' || url || '\" class=\"c' || page_id::VARCHAR || '\" id=\"x\">' || page_id::VARCHAR || '</a>' || html AS h FROM pages) "
    r"SELECT page_id, list_sort(list_filter(regexp_split_to_array(replace(h, '>', ' > '), '\s+'), lambda p: p <> '')) AS pieces FROM h"
)
def html_attr_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffling only moves pieces within their tags, so that the sorted pieces stay what they were."""
    shuffled = drift.attributes_shuffled(F.expr(_TWO_ATTRS))
    pieces = F.filter(F.split(F.replace(shuffled, F.lit(">"), F.lit(" > ")), r"\s+"), lambda p: p != "")
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(pieces).alias("pieces"))


@query("SELECT o_orderkey, levenshtein(o_orderpriority, o_orderstatus || o_orderpriority || 'x') AS d FROM orders")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda c: F.transform(F.split(c, ""), lambda ch: F.ascii(ch))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", metrics.edit_distance(ids(F.col("o_orderpriority")), ids(F.concat("o_orderstatus", "o_orderpriority", F.lit("x")))).alias("d")
    )


@query(
    "WITH s AS (SELECT o_orderpriority AS p, ' ' || o_orderstatus || '  ' || o_orderpriority AS a FROM orders), t AS (SELECT length(a) AS la, length(trim(regexp_replace(a, ' +', ' ', 'g'))) AS lb, levenshtein(a, trim(regexp_replace(a, ' +', ' ', 'g'))) AS d FROM s) "
    "SELECT 'ws' AS drift, count(*) AS n, avg(la) AS avg_len, avg(lb) AS avg_len_pert, avg(abs(la - lb)) AS avg_abs_len_jitter, avg(d) AS avg_edit_distance FROM t"
)
def len_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), "o_orderstatus", F.lit("  "), "o_orderpriority")
    vocab = {t: i for i, t in enumerate([*mining.SPECIALS, *mining.ASCII])}
    rows = table(spark, sf_dir, "orders").select(matcher.encoded(text, vocab).alias("base"), matcher.encoded(drift.blanks_folded(text), vocab).alias("ws"))
    return metrics.drift_report(rows, "base", {"ws": "ws"})


@query("SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 = 1 THEN 1 WHEN event_id % 5 = 2 THEN 7 WHEN event_id % 5 = 3 THEN 1 ELSE 0 END AS y, count(*) AS n FROM events GROUP BY 1, 2")
def label_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN ' Benign' WHEN 1 THEN 'PHISH' WHEN 2 THEN '7.9' WHEN 3 THEN 'odd' END")
    return table(spark, sf_dir, "events").select("event_type", metrics.label_value(raw).alias("y")).groupBy("event_type", "y").agg(F.count("*").alias("n"))


@query("SELECT toxic AS y, count(*) AS n FROM labels GROUP BY toxic")
def label_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label column found by its usual name, in any case."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("Is_Attack"))
    return rows.groupBy(metrics.label_value(F.col(metrics.label_column(rows))).alias("y")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 1 AS one, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS some FROM orders")
def edit_distance_large_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids beyond the characters: one changed, and one or two changed."""
    big = lambda *ids: F.array(*(F.col("o_orderkey") + F.lit(i) for i in ids))
    some = F.when(F.col("o_orderkey") % 2 == 0, big(70000, 70002)).otherwise(big(70003))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", metrics.edit_distance(big(70000), big(70001)).alias("one"), metrics.edit_distance(big(70000, 2_000_000), some).alias("some")
    )


@query(
    "WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels), "
    "r AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS \"precision\", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c) "
    "SELECT *, CASE WHEN \"precision\" + recall > 0 THEN 2 * \"precision\" * recall / (\"precision\" + recall) ELSE 0 END AS f1 FROM r"
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(table(spark, sf_dir, "labels"), F.col("toxic"), 1 - F.col("quality"))


@query("WITH r AS (SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS running FROM documents) SELECT * FROM r WHERE running <= 500000")
def token_budget_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.within_budget(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 500_000, "doc_id")


# --- flagship ---


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract, mining, scoring: the thousand best candidate tokens of the documents."""
    docs = table(spark, sf_dir, "documents").select(Contract().applied(F.col("text")).alias("text"))
    ranked = induce.scored(mining.candidates(docs), mining.boundaries("default"))
    return ranked.orderBy(F.desc("score"), F.desc(F.length("token")), F.desc("token")).limit(1000)


@query()
def vocabulary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)
